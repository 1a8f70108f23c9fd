"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``concord.llm.queries`` holds the
thin queries that ``__spark_entry__.py`` registers.
"""
