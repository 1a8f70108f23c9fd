"""Exact cosine self-join of embeddings by an epsilon grid order.

Vectors of unit length have a cosine of t or more exactly if they lie within
epsilon = sqrt(2 - 2 t) of each other, and so do their projections on any
orthonormal axes. The leading principal axes of each vector size (fitted on a
bounded sample; any axes give the same result, only at another speed) carry a
grid of cells of epsilon. In the lexicographic order of the cells, consecutive
cells are put together into intervals of about ``block_bytes`` of vectors; a
cell that holds more is dealt over several.

Two intervals are joined only if nothing that is known of them as a whole keeps
them apart: their cells are neighbours, their boxes on further axes are not more
than epsilon from each other, nor their centres more than epsilon and both
radii. Only then vectors are moved. A task joins one pair of intervals: it sorts
both in grid order and halves them recursively, skips halves whose boxes are
provably distant, and computes cosines in double precision in the leaves.

Equal vectors of a label are one vector with a count. A task returns one row per
vector: its number of linked vectors, and one link that connects it to its
component inside the task; pairs are never put out.

Vectors without any structure give the bounds nothing to hold on to (in 64
dimensions, boxes of random vectors overlap on every axis): an exact join then
compares all of a label, and each interval is sent to all others of its label.
Large intervals keep that factor low: it is a label's bytes over ``block_bytes``.

Defined cases: vectors that are null, empty, zero or hold a null or a non-finite
component, and vectors without a label, link with nothing; very large and very
small components are scaled by powers of two, which changes no cosine; vectors
of different sizes are not compared; repeated rows are linked as equal vectors;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_one_of_each, materialize, spread
from ..operators.components import components

#: Axes of the grid, and axes on which boxes are held in all.
AXES, BOX_AXES = 4, 16
LEAF = 512


def unit_rows(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled by powers of two, their lengths): neither over- nor underflows whatever is finite and not zero."""
    x = np.array(vectors.tolist(), dtype=np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def principal_axes(x: np.ndarray, n_axes: int = BOX_AXES) -> np.ndarray:
    """Orthonormal rows: the leading principal directions of unit vectors."""
    x = x - x.mean(axis=0)
    _, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, ::-1][:, :n_axes].T.copy()


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sample of one size to its axes, flat."""
    x, norms = unit_rows(pdf["embedding"])
    return pd.DataFrame({"size": [int(pdf["size"].iloc[0])], "axes": [principal_axes(x / norms[:, None]).ravel().tolist()]})


def _placed(epsilon: float):
    """Vectors of one size, with its axes, to their grid cells and projections."""

    def run(pdf: pd.DataFrame, axes: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        cells, along = np.zeros((len(pdf), AXES), dtype=np.int64), np.zeros((len(pdf), BOX_AXES), dtype=np.float32)
        if len(pdf) and len(axes):
            x, norms = unit_rows(pdf["embedding"])
            found = (x / norms[:, None]) @ np.array(axes["axes"].iloc[0]).reshape(-1, x.shape[1]).T
            along[:, : found.shape[1]] = found
            cells[:, : found.shape[1]] = np.floor(found[:, :AXES] / epsilon)
        return pdf[["node", "count", "embedding", "label", "size"]].assign(**{f"c{k}": cells[:, k] for k in range(AXES)}, along=list(along))

    return run


def _pair_links(cosine: float):
    """Links between the vectors of one pair of intervals (or inside one interval)."""
    epsilon = math.sqrt(2 - 2 * cosine) + SLACK

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, norms = unit_rows(pdf["embedding"])
        along = np.array(pdf["along"].tolist(), dtype=np.float64)
        order = np.lexsort(np.floor(along[:, :AXES] / epsilon).T[::-1])
        x, norms, along = x[order], norms[order], along[order]
        node, count, right = (pdf[c].to_numpy()[order] for c in ("node", "count", "side"))
        sides = [np.flatnonzero(right == s) for s in np.unique(right)]
        alone = len(sides) == 1
        met = np.zeros(len(x), dtype=np.int64)
        parent = np.arange(len(x))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def leaf(a: np.ndarray, b: np.ndarray, same: bool) -> None:
            hits = (x[a] @ x[b].T) / np.outer(norms[a], norms[b]) >= cosine
            if same:
                np.fill_diagonal(hits, False)
            met[a] += hits @ count[b]
            if not same:
                met[b] += hits.T @ count[a]
            # Each row is joined to its first hit, and each column of that row to the row: a forest of the leaf.
            for i in np.flatnonzero(hits.any(axis=1)):
                ends = b[np.flatnonzero(hits[i])]
                roots = np.unique(parent[ends])
                own = top(int(a[i]))
                for r in roots:
                    r = top(int(r))
                    if r != own:
                        parent[max(r, own)] = min(r, own)
                        own = min(r, own)

        def join(a: np.ndarray, b: np.ndarray, same: bool) -> None:
            if not same:
                gap = np.maximum(along[a].min(axis=0) - along[b].max(axis=0), along[b].min(axis=0) - along[a].max(axis=0))
                if (np.maximum(gap, 0) ** 2).sum() > epsilon**2:
                    return
            if len(a) <= LEAF and len(b) <= LEAF:
                leaf(a, b, same)
            elif same:
                h = len(a) // 2
                join(a[:h], a[:h], True)
                join(a[h:], a[h:], True)
                join(a[:h], a[h:], False)
            elif len(a) >= len(b):
                h = len(a) // 2
                join(a[:h], b, False)
                join(a[h:], b, False)
            else:
                h = len(b) // 2
                join(a, b[:h], False)
                join(a, b[h:], False)

        if alone and pdf["lone"].iloc[0]:
            join(sides[0], sides[0], True)
        elif not alone:
            join(sides[0], sides[1], False)
        linked = np.flatnonzero(met > 0)
        return pd.DataFrame({"node": node[linked], "met": met[linked], "root": node[[top(int(i)) for i in linked]]})

    return run


def _extents(pdf: pd.DataFrame) -> pd.DataFrame:
    """Part of an interval to its box, its sum and what its radius follows from."""
    x, norms = unit_rows(pdf["embedding"])
    x, along = x / norms[:, None], np.array(pdf["along"].tolist(), dtype=np.float64)
    return pd.DataFrame({
        "interval": [pdf["interval"].iloc[0]], "label": [pdf["label"].iloc[0]], "size": [pdf["size"].iloc[0]],
        "low_cell": [[int(pdf[f"c{k}"].min()) for k in range(AXES)]], "high_cell": [[int(pdf[f"c{k}"].max()) for k in range(AXES)]],
        "low": [along.min(axis=0).tolist()], "high": [along.max(axis=0).tolist()], "centre": [x.mean(axis=0).tolist()],
        "radius": [float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1)).max())],
    })


#: What rounding may add to a distance: projections travel in single precision.
SLACK = 1e-5


def link_vectors(
    vectors: DataFrame, cosine: float = 0.93, block_bytes: int = 4 << 20, sample: int = 4_000, key: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    ``block_bytes`` bounds what a task holds: two intervals of so many bytes in double precision.
    """
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"), F.col(label).cast("string").alias("label"))
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    nonzero = F.exists("embedding", lambda v: v != 0)
    usable = F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & finite & nonzero, F.lit(False))
    # Copies are one node, named by what they hold.
    rows = materialize(rows.withColumn("node", F.when(usable, F.xxhash64("label", "embedding"))), "vectors")
    distinct = rows.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("count"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    distinct = materialize(distinct.withColumn("size", F.size("embedding")), "distinct-vectors")

    # About ``sample`` vectors of each size, by their hashed names, are fitted in a task of their own.
    sizes = materialize(distinct.groupBy("size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # A row for each length of a vector: all vectors may share one, so the table goes to them, unless there are very many.
    sizes = F.broadcast(sizes) if sizes.count() <= 100_000 else sizes
    drawn = distinct.select("size", "embedding", "node").join(sizes, "size").filter(F.shiftrightunsigned(F.xxhash64(F.lit(7), "node"), 1) / F.lit(float(2**63)) * F.col("n") < sample)
    axes = drawn.groupBy("size").applyInPandas(_fitted, "size int, axes array<double>")
    epsilon = math.sqrt(2 - 2 * cosine) + SLACK
    named = [f"c{k}" for k in range(AXES)]
    schema = f"node long, count long, embedding {kind}, label string, size int, " + ", ".join(f"{c} long" for c in named) + ", along array<float>"
    bundles = sizes.withColumn("_bundles", F.ceil(F.col("n") / 8192).cast("int")).drop("n")
    bundled = distinct.join(bundles, "size").withColumn("_bundle", spread(F.col("node"), F.col("_bundles")).cast("int"))
    told = materialize(axes.join(bundles, "size").select("size", "axes", F.explode(F.sequence(F.lit(0), F.col("_bundles") - 1)).alias("_bundle")), "axes")
    placed = bundled.groupBy("size", "_bundle").cogroup(told.groupBy("size", "_bundle")).applyInPandas(_placed(epsilon), schema)
    placed = materialize(placed, "placed")

    # Intervals: runs of cells in grid order. Cells number at most (2 / epsilon + 2) ** AXES for each label.
    group, block = ["label", "size"], F.greatest(F.floor(F.lit(block_bytes) / (8 * F.col("size"))), F.lit(1))
    ahead = Window.partitionBy(*group).orderBy(*named).rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy(*group, *named).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("_run", F.floor(F.coalesce(F.sum("n").over(ahead), F.lit(0)) / block)).withColumn("_parts", F.ceil(F.col("n") / block).cast("int"))
    cells = materialize(cells.withColumn("_run", F.when(F.col("_parts") > 1, -F.xxhash64(*named).bitwiseAND(2**40 - 1) - 1).otherwise(F.col("_run"))).drop("n"), "cells")
    dealt = placed.join(cells, [*group, *named]).withColumn("_part", spread(F.col("node"), F.col("_parts")).cast("int"))
    dealt = materialize(dealt.withColumn("interval", F.xxhash64("label", "size", "_run", "_part")).drop("_run", "_part", "_parts"), "intervals")

    box = "low_cell array<long>, high_cell array<long>, low array<double>, high array<double>, centre array<double>, radius double"
    boxes = materialize(dealt.groupBy("interval").applyInPandas(_extents, f"interval long, label string, size int, {box}"), "boxes")
    near = boxes.withColumn("_at", F.explode(F.sequence(F.col("low_cell")[0] - 1, F.col("high_cell")[0] + 1))).alias("x")
    cover = boxes.withColumn("_at", F.explode(F.sequence(F.col("low_cell")[0], F.col("high_cell")[0]))).alias("y")
    met = near.join(cover, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*group, "_at")] + [F.col("x.interval") <= F.col("y.interval")])
    squares = lambda a, b, f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, v: s + v * v)
    gap = squares(F.arrays_zip(F.col("x.low").alias("low"), F.col("x.high").alias("high")), F.arrays_zip(F.col("y.low").alias("low"), F.col("y.high").alias("high")), lambda a, b: F.greatest(a["low"] - b["high"], b["low"] - a["high"], F.lit(0.0)))
    apart = F.sqrt(squares("x.centre", "y.centre", lambda a, b: a - b)) - F.col("x.radius") - F.col("y.radius")
    pairs = met.filter((gap <= (epsilon + SLACK) ** 2) & (apart <= epsilon + SLACK)).select(F.col("x.interval").alias("i"), F.col("y.interval").alias("j")).distinct()
    pairs = materialize(pairs, "interval-pairs")

    told = ["i", "j", "side", "lone", "node", "count", "embedding", "along"]
    first = dealt.join(pairs.withColumn("interval", F.col("i")), "interval").withColumns({"side": F.lit(0), "lone": F.col("i") == F.col("j")}).select(*told)
    second = dealt.join(pairs.filter("i <> j").withColumn("interval", F.col("j")), "interval").withColumns({"side": F.lit(1), "lone": F.lit(False)}).select(*told)
    met = materialize(first.unionAll(second).groupBy("i", "j").applyInPandas(_pair_links(cosine), "node long, met long, root long"), "met")

    # What a row takes from its node, and a node from its component; hot ones are broadcast.
    counts = met.groupBy("node").agg(F.sum("met").alias("met"))
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    nodes = nodes.join(counts, "node", "left").join(components(met, "node", "root"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = materialize(nodes, "nodes")
    least = nodes.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    known = join_one_of_each(nodes.select("node", "component", "met", "n", (F.col("n") - 1).alias("copies")).withColumnRenamed("n", "_n"), least, "component")
    known = known.select("node", "component_id", (F.col("copies") + F.coalesce("met", F.lit(0))).alias("n_links"), F.col("_n").alias("n"))
    linked = join_one_of_each(rows.filter("node IS NOT NULL").select("vec_id", "node"), known, "node").select("vec_id", "n_links", "component_id")
    alone = rows.filter("node IS NULL").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionAll(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
