"""Sharding by vector bin packing over bytes, tokens and rows.

Documents with equal texts form a group, and a group is placed as a whole:
groups go, largest first, to the shard whose residual capacity vector has the
highest dot product with the group's vector among those with room.

Groups that are alike by what is packed, their bytes, tokens and rows, are
interchangeable. So the packer sees *kinds* of groups, alike to within ``grain``
in each of the three, with how many groups there are of a kind and their sums,
and deals a kind out over the shards; which of its groups go where follows from
their order. The number of kinds grows with the logarithm of the sizes, not with
the corpus.

Only a group that no shard can hold, as it has more than a shard's share of the
bytes, tokens or rows, is split, into as few pieces as fit: no law of near equal
shards could be met with it in one.

Only the kinds' sums reach the driver; texts are never shuffled, only narrow
rows are.

Defined cases: a null text has no bytes and is in one group with empty texts; repeated rows are rows of one group, each with a slot; texts of any
length are one row, and one above a shard's share fills a shard of its own; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gapless_slots, join_one_of_each, materialize, spread, words_of

ROW_BYTES = 8


def pack_vectors(items: list[tuple[int, tuple[float, ...]]], n_bins: int) -> dict[int, int]:
    """Item -> bin: largest first, to the highest dot product with what is left."""
    return {k: next(b for b, n in enumerate(counts) if n) for k, counts in pack_kinds([(k, 1, v) for k, v in items], n_bins).items()}


def pack_kinds(kinds: list[tuple[int, int, tuple[float, ...]]], n_bins: int) -> dict[int, list[int]]:
    """Kind -> how many of its items each bin gets; ``kinds``: name, number of items, sum of their vectors.

    Largest item first, each to the bin with the highest dot product of its
    vector with what is left, among bins with room in every dimension, which are
    scaled to their totals: a bin's capacity is 1 / n_bins in each. If none has
    room, the bin whose fullest dimension stays lowest takes it. Ties: the lower
    bin. The many items of a kind are placed by portions of at most one in
    ``4 * n_bins`` of them.
    """
    if not kinds:
        return {}
    many, load = np.array([n for _, n, _ in kinds]), np.array([v for _, _, v in kinds], dtype=np.float64)
    total = load.sum(axis=0)
    share = load / np.where(total > 0, total, 1.0) * n_bins / many[:, None]
    keys = np.array([k for k, _, _ in kinds])
    left, placed = np.ones((n_bins, share.shape[1])), {}
    for i in np.lexsort((keys, -share.max(axis=1))):
        counts, rest = [0] * n_bins, int(many[i])
        portion = max(1, rest // (4 * n_bins))
        while rest:
            n = min(portion, rest)
            v = share[i] * n
            room = (left >= v - 1e-12).all(axis=1)
            score = np.where(room, left @ v, -np.inf) if room.any() else (left - v).min(axis=1)
            best = int(score.argmax())
            left[best] -= v
            counts[best] += n
            rest -= n
        placed[int(keys[i])] = counts
    return placed


def assign_shards(docs: DataFrame, n_shards: int = 24, grain: float = 0.03, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, n_tokens, ``group``, ``shard`` and ``slot``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
            F.size(words_of(F.col(text))).cast("long").alias("n_tokens"),
            F.md5(body.cast("binary")).alias("group"),
        ),
        "shard-rows",
    )
    sums = {"b": F.sum("size"), "t": F.sum("n_tokens"), "r": F.count(F.lit(1))}
    total = rows.agg(*sums.values()).first()
    if not total[2]:
        empty = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
        return rows.sparkSession.createDataFrame([], empty)
    share = F.greatest(*[F.col(n) / F.lit(max(float(t or 0), 1.0)) for n, t in zip(sums, total, strict=True)])
    large = rows.groupBy("group").agg(*[c.alias(n) for n, c in sums.items()]).filter(share * n_shards > 1).select("group", F.ceil(share * n_shards).cast("int").alias("_pieces"))
    large = F.broadcast(materialize(large, "large-groups"))  # fewer than 3 * n_shards
    piece = F.concat("group", F.lit("/"), spread(F.struct("doc_id"), F.col("_pieces")).cast("string"))
    cut = rows.join(large, "group").withColumn("unit", piece).select(*rows.columns, "unit")
    rows = materialize(rows.join(large, "group", "left_anti").withColumn("unit", F.col("group")).select(*cut.columns).unionAll(cut), "shard-units")
    groups = rows.groupBy("unit").agg(*[c.alias(n) for n, c in sums.items()], F.count(F.lit(1)).alias("n"))
    kind = F.xxhash64(*[F.floor(F.log(F.greatest(F.col(n), F.lit(1))) / F.lit(math.log(1 + grain))) for n in sums])
    groups = materialize(groups.withColumn("kind", kind), "shard-groups")
    kinds = [(r["kind"], r["m"], (r["b"], r["t"], r["r"])) for r in groups.groupBy("kind").agg(F.count(F.lit(1)).alias("m"), *[F.sum(n).alias(n) for n in ("b", "t", "r")]).collect()]
    placed = pack_kinds(kinds, n_shards)
    # A kind's groups in their order: the first so many to the first shard that takes some, and so on.
    spans, at = [], 0
    for k, counts in placed.items():
        at = 0
        for shard, n in enumerate(counts):
            if n:
                spans.append((k, at, at + n, shard))
                at += n
    spans = rows.sparkSession.createDataFrame(spans, "kind long, first long, stop long, shard int")
    numbered = gapless_slots(groups, ["kind"], ["unit"], name="place")
    meets = (numbered["kind"] == spans["kind"]) & (numbered["place"] >= spans["first"]) & (numbered["place"] < spans["stop"])
    homes = numbered.join(F.broadcast(spans), meets).select("unit", "n", "shard")  # at most n_shards rows a kind
    dealt = materialize(join_one_of_each(rows, homes, "unit").drop("unit"), "shard-placed")
    return gapless_slots(dealt, ["shard"], ["doc_id", "group"])
