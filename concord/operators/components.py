"""Connected components of a table of links, by repeated contraction.

In each round every vertex points to the least of itself and its neighbours,
and links are drawn anew between what their ends point to. Odd rounds compare
ids, which contracts stars around their least member at once; even rounds
compare hashed ids, which halves chains in expectation. Links shrink until none
is left; each round is written to the shared folder, and the tables of the round
before are removed from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import discard, store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; ``component`` is the least node of its component."""
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct()
    edges, where, turn = store(edges, "links"), None, 0
    while not edges.isEmpty():
        turn += 1
        rank = F.lit(0).cast("long") if turn % 2 else F.xxhash64(F.lit(turn), F.col("v"))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
        own = both.select("u", F.struct(rank.alias("r"), F.col("v")).alias("m")).groupBy("u").agg(F.min("m").alias("m"))
        self_rank = F.lit(0).cast("long") if turn % 2 else F.xxhash64(F.lit(turn), F.col("u"))
        least = F.least(F.col("m"), F.struct(self_rank.alias("r"), F.col("u").alias("v")))
        points = store(own.select("u", least["v"].alias("to")), "points")
        ends = edges.join(points.select(F.col("u").alias("a"), F.col("to").alias("x")), "a").join(points.select(F.col("u").alias("b"), F.col("to").alias("y")), "b")
        drawn = ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if where is None:
            at = points.select(F.col("u").alias("node"), F.col("to").alias("at"))
            at._stored_at = points._stored_at
        else:
            moved = points.select(F.col("u").alias("at"), F.col("to").alias("_to"))
            at = store(where.join(moved, "at", "left").select("node", F.coalesce("_to", "at").alias("at")), "where")
        left = store(drawn, "links")
        discard(edges, *([where, points] if where is not None else []))
        edges, where = left, at
    if where is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = where.groupBy("at").agg(F.min("node").alias("component"))
    return where.join(least, "at").select("node", "component")
