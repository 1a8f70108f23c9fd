"""A corpus pipeline: five stages, each written as Parquet and read by the next.

Quality rules drop documents, the n-gram join keeps one document of each group
of near copies, suffix-array dedup cuts repeated passages out, mixing draws
documents towards target weights, packing lays what is left out in batches.

Defined cases: documents are rows, told apart by a 64-bit hash of id and text,
so ids may repeat or be null (rows equal in both are one document to the n-gram
join, and others share a stage's verdict at worst if their hashes collide); null
and empty texts fail the quality rules; texts of any length are read in whole; an
empty table gives an empty result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from concord.llm.common import materialize, read_table
from concord.llm.queries import MIX_WEIGHTS, mix_levels

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Passages of more than 50 words are cut; 51 words of one byte each have 101 bytes.
PASSAGE_WORDS = 50
PASSAGE_BYTES, PASSAGE_GRAM = 2 * PASSAGE_WORDS + 1, 32


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one whose row has the least hashed name."""
    return ngram_join.keep_one_of_each(docs, n=5, percent=80)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs, PASSAGE_BYTES, PASSAGE_GRAM, words=PASSAGE_WORDS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document is drawn twice here, so the result is a part of the documents."""
    return mixing.keep_drawn(docs, mix_levels(), budget=0.8, weights=MIX_WEIGHTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where each document lies, with its text and the other columns."""
    return packing.pack(docs, keep=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("ngram_join", near_copies_stage),
    ("suffix_dedup", passages_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Estimation, hashing and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
