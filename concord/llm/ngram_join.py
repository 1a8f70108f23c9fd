"""Exact Jaccard self-join on word shingles, by universe partition and pigeonhole.

Two sets whose Jaccard similarity reaches t differ in at most
H = (|s| + |r|) (1 - t) / (1 + t) elements. Hash the universe into segments: if
there are more segments than H, some segment holds the same subset of both.
Sets are joined inside bands of sizes; the scheme of a band is made for pairs
whose smaller set lies in it, so a set uses its own band's scheme and those of
the bands its smaller partners may lie in.

*Cost-based allocation.* A scheme has either exact segments, one key each, or
fewer and larger segments with their one-deletion neighbourhood (a segment
matches if it differs in one element). For each band both are costed and the
cheaper is taken that leaves few nearly empty segments. A scheme has ``c - 1``
segments to spare, so a partner shares ``c`` keys at least, and each set may
drop its ``c - 1`` most frequent keys without losing a pair. That is what keeps
a passage shared by very many texts from making candidates.

*Verification* computes the intersection of both whole sets and compares
integers. Sets with equal elements are one node. A key's members are compared
with the key's least member; where all are linked to it they are connected,
whatever their number. Only where some are not are the pairs of members in
different components compared: single pairs for small keys, blocks of members
inside tasks for large ones. So links between different texts are never lost,
while a large group of near copies does not give all its pairs.

Sets are told apart by a 64-bit sum over their elements' hashes, shingles by
64-bit hashes.

Defined cases: null, empty and blank texts have an empty set and are their own
component; texts of fewer words than a shingle have their whole sequence as
one; repeated texts link by equal sets; repeated ids are one document each row,
with the least id of the component; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import components
from ..operators.stored import discard
from .common import free_name, join_one_of_each, materialize, row_key
from .shingles import U, mix, shingle_sets

_P = U(0x9E3779B97F4A7C15)
#: Members of a key that are compared pair by pair; of larger keys, blocks of so many are compared inside tasks.
SMALL, BLOCK = 64, 256
#: One document in ``PART`` is looked at for frequent keys; those on more than one in ``SHARE`` of them are dealt over ``SALTS`` tasks.
PART, SHARE, SALTS = 64, 256, 32
#: More bands than any size needs: the last one begins beyond 10 ** 8 elements.
BANDS = 64


@dataclass(frozen=True)
class Scheme:
    """How sets are cut for pairs whose smaller set has ``low`` to ``high`` elements."""

    band: int
    low: int
    high: int
    differ: int
    segments: int
    deletions: bool
    shared: int  # keys that any pair has in common at least


class Schemes:
    """All bands of a threshold ``percent`` / 100."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.widening = (100 / percent) ** (2 if percent < 90 else 3)

    @lru_cache(maxsize=None)  # noqa: B019  one object per task
    def edge(self, band: int) -> int:
        """The smallest size in ``band``."""
        return 1 if band == 0 else max(self.edge(band - 1) + 1, math.floor(self.edge(band - 1) * self.widening) + 1)

    @lru_cache(maxsize=None)  # noqa: B019
    def band_of(self, size: int) -> int:
        band = 0
        while band < BANDS - 1 and self.edge(band + 1) <= size:
            band += 1
        return band

    @lru_cache(maxsize=None)  # noqa: B019
    def scheme(self, band: int) -> Scheme:
        low, high, p = self.edge(band), self.edge(band + 1) - 1, self.percent
        differ = max((s + r) * (100 - p) // (100 + p) for s in (high,) for r in (s * 100 // p,))
        found = [x for x in (self._fit(low, differ, False), self._fit(low, differ, True)) if x]
        keys = lambda x: x[0] + (high if x[2] else 0)
        segments, shared, deletions = min(found, key=keys) if found else (max(1, -(-(differ + 1) // 2)), 1, True)
        return Scheme(band, low, high, differ, segments, deletions, shared)

    @staticmethod
    def _fit(low: int, differ: int, deletions: bool) -> tuple[int, int, bool] | None:
        """(segments, shared keys, kind): enough to spare for the segments expected to be nearly empty."""
        shared = 2
        for _ in range(60):
            segments = -(-(differ + 2 * shared - 1) // 2) if deletions else differ + shared
            mean = low / segments
            light = segments * math.exp(-mean) * (1 + mean * deletions)
            wanted = 2 + math.ceil(light + 2 * math.sqrt(light) + 0.04 * segments)
            if wanted <= shared:
                return segments, shared, deletions
            if wanted > low:
                return None
            shared = wanted
        return None

    def of(self, size: int) -> list[Scheme]:
        """The schemes that a set of this size takes part in."""
        last = self.band_of(size)
        first = self.band_of(max(1, -(-size * self.percent // 100)))
        return [s for b in range(first, last + 1) if (s := self.scheme(b)).differ > 0]


def node_id(items: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(mix(items + _P).sum(keepdims=True) + U(len(items)))[0].astype(np.int64))


def keys_of(items: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The keys of a set under a scheme."""
    at = ((items >> U(32)) * U(scheme.segments) >> U(32)).astype(np.int64)
    values = mix(items ^ _P)
    sums = np.zeros(scheme.segments, dtype=np.uint64)
    np.add.at(sums, at, values)
    base = mix(np.arange(scheme.segments, dtype=np.uint64) + U(scheme.band << 32) + _P)
    found = mix(sums + base)
    if scheme.deletions:
        found = np.unique(np.concatenate((found, mix(sums[at] - values + base[at]))))
    # The low bits name the band, so that a key tells its scheme.
    return ((found & ~U(BANDS - 1)) | U(scheme.band)).astype(np.int64)


def _identities(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), n))
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "node": pa.array([node_id(x) if len(x) else None for x in sets], pa.int64()), "n_shingles": pa.array([len(x) for x in sets], pa.int64())}
            )

    return run


def _signatures(n: int, percent: int, rows: int = 200_000):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes = Schemes(percent)
        for batch in batches:
            seen: set[int] = set()
            keys: list[np.ndarray] = []
            nodes: list[np.ndarray] = []
            waiting = 0
            for items in shingle_sets(batch.column("text"), n):
                if not len(items) or (node := node_id(items)) in seen:
                    continue
                seen.add(node)
                for scheme in schemes.of(len(items)):
                    keys.append(keys_of(items, scheme))
                    nodes.append(np.full(len(keys[-1]), node, dtype=np.int64))
                    waiting += len(keys[-1])
                if waiting >= rows:
                    yield pa.record_batch({"key": np.concatenate(keys), "node": np.concatenate(nodes)})
                    keys, nodes, waiting = [], [], 0
            if waiting:
                yield pa.record_batch({"key": np.concatenate(keys), "node": np.concatenate(nodes)})

    return run


def _verified(n: int):
    """Rows (a, b, text_a, text_b) to (a, b, inter, total)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = list(shingle_sets(batch.column("text_a"), n))
            two = list(shingle_sets(batch.column("text_b"), n))
            inter = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two, strict=True)]
            total = [len(x) + len(y) - i for x, y, i in zip(one, two, inter, strict=True)]
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "inter": pa.array(inter, pa.int64()), "total": pa.array(total, pa.int64())})

    return run


def _block_links(n: int, percent: int):
    """Links between a block of members outside a key's main component (side 0) and a block of all members."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingle_sets(pa.array(pdf["text"], pa.string()), n))
        key, nodes, comp = int(pdf["key"].iloc[0]), pdf["node"].tolist(), pdf["comp"].tolist()
        keys = [frozenset(k) for k in pdf["keys"]]
        one, other = ([i for i, s in enumerate(pdf["side"]) if s == side] for side in (0, 1))
        root = {c: c for c in comp}

        def top(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        out = []
        for i in one:
            for j in other:
                small, large = sorted((len(sets[i]), len(sets[j])))
                if 100 * small < percent * large or (x := top(comp[i])) == (y := top(comp[j])) or min(keys[i] & keys[j]) != key:
                    continue  # the last: another key compares them
                inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * inter >= percent * (small + large - inter):
                    root[x] = y
                    out.append((nodes[i], nodes[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs with ``linked``, verified on the whole sets."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    counted = both.mapInArrow(_verified(n), "a long, b long, inter long, total long")
    return counted.select("a", "b", (100 * F.col("inter") >= percent * F.col("total")).alias("linked"))


def similarity_groups(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    sets = materialize(whole.mapInArrow(_identities(n), "doc_id long, row long, node long, n_shingles long"), "sets")

    # One exchange by key serves the counts and the join back to them. Keys that are frequent in a part of the documents are dealt over tasks.
    # For the exchange to be one, nothing may be pushed below it on one side alone: null tests come first, and counts are told apart by ``_dealt``.
    texts = whole.filter("text IS NOT NULL")
    signed = texts.select("text").mapInArrow(_signatures(n, percent), "key long, node long").filter("key IS NOT NULL")
    hot = F.broadcast(_frequent(texts, sets, n, percent).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(F.coalesce(F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"), F.lit(0)))
    signed = signed.join(hot, "key", "left").select("key", "node", salt.alias("_salt")).repartition("key", "_salt")
    met = signed.groupBy("key", "_salt").agg(F.min("node").alias("_low"), F.max("node").alias("_high"), F.count(F.lit(1)).alias("n"), F.max("_salt").alias("_dealt"))
    met = met.filter("_dealt >= 0 OR _low <> _high").groupBy("key").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("n").alias("n"), F.max("_dealt").alias("_dealt"))
    salts = F.when(F.col("_dealt") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    shared = met.filter("_low <> _high").select("key", F.explode(salts).alias("_salt"), "n")
    # Distinct while the salt is there, so that the rows stay where they are.
    met_rows = materialize(signed.join(shared.hint("shuffle_hash"), ["key", "_salt"]).select("key", "_salt", "node", "n").distinct().drop("_salt"), "shared-keys")
    kept = materialize(_without_frequent(met_rows, Schemes(percent)), "rare-keys")
    discard(met_rows)  # here and below: what has been read for the last time
    # A key's pivot is the member that meets most others over all its keys: of near copies, what they were copied from.
    counts = kept.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met_often = materialize(join_one_of_each(kept, counts.withColumn("n", F.col("members")), "key"), "kept-keys")
    discard(kept)
    ranked = met_often.join(met_often.groupBy("node").agg(F.sum("members").alias("met")), "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("met", "node")).alias("_top"), F.count(F.lit(1)).alias("n")).select("key", F.col("_top.node").alias("pivot"), "n")
    cands = materialize(join_one_of_each(met_often, pivots, "key").select("key", "node", "pivot", "members"), "candidates")
    discard(met_often)

    # By row, as an id may be null or stand for several texts.
    first = sets.groupBy("node").agg(F.min("row").alias("row"))
    needed = cands.select("node").distinct().join(first, "node").select("row", "node")
    texts = materialize(whole.select("row", "text").join(needed, "row").dropDuplicates(["row"]).select("node", "text"), "texts")

    pairs = cands.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    checked = materialize(_links(pairs, texts, n, percent), "checked")
    links = checked.filter("linked").select("a", "b")
    known = materialize(components(links), "known")

    # Keys whose members are not all connected, and were not all compared with each other.
    placed = cands.filter("members > 2").join(known, "node", "left").select("key", "node", "members", F.coalesce("component", "node").alias("comp"))
    placed = materialize(placed, "placed-keys")
    discard(cands)
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count(F.lit(1)).alias("n")).filter("_low <> _high").select("key", "n")
    opened = materialize(join_one_of_each(placed, open_keys, "key"), "open-keys")
    discard(placed)
    small = opened.filter(F.col("members") <= SMALL)
    pair = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")))
    pair = pair.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
    more = _links(pair, texts, n, percent).filter("linked").select("a", "b")

    # In a large key most members are connected by now: only the others are compared with all.
    large = opened.filter(F.col("members") > SMALL)
    main = large.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("_main"), F.sum("n").alias("_all"))
    main = main.select("key", F.col("_all").alias("n"), F.col("_main.comp").alias("_main"), F.ceil(F.col("_all") / BLOCK).cast("int").alias("_blocks"), F.ceil((F.col("_all") - F.col("_main.n")) / BLOCK).cast("int").alias("_others"))
    own = lambda count: F.pmod(F.xxhash64("node", F.lit(5)), F.col(count)).cast("int")
    dealt = join_one_of_each(large, main, "key").join(large.groupBy("node").agg(F.collect_list("key").alias("keys")), "node")
    told = ["key", "node", "comp", "keys"]
    outside = dealt.filter("comp <> _main").select(*told, F.lit(0).alias("side"), own("_others").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("j"))
    inside = dealt.select(*told, F.lit(1).alias("side"), own("_blocks").alias("j"), F.explode(F.sequence(F.lit(0), F.col("_others") - 1)).alias("i")).select(*outside.columns)
    across = outside.unionAll(inside).join(texts, "node").groupBy("key", "i", "j").applyInPandas(_block_links(n, percent), "a long, b long")

    found = components(links.unionAll(more).unionAll(across))
    # From a component's least id to its nodes, and from these to their rows.
    nodes = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("_n"))
    nodes = materialize(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "nodes")
    least = nodes.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_one_of_each(nodes, least, "component").select("node", "component_id", F.col("_n").alias("n"))
    grouped = join_one_of_each(sets.filter("node IS NOT NULL"), named, "node").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return grouped.unionAll(sets.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, and with every row whose set is empty but for repeated ones."""
    row = free_name(docs)
    named = docs.withColumn(row, row_key(key, text))
    groups = similarity_groups(named.select(row, text), n, percent, key=row, text=text)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(row)).distinct()
    return named.join(kept, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def _frequent(texts: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Keys on more than one in ``SHARE`` of a part of the documents, to be dealt over tasks; which they are changes no result.

    There are fewer of them than ``SHARE`` times the keys of a document.
    """
    part = F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(PART)) == 0
    least = max(sets.filter(part).count() // SHARE, 8)
    found = texts.filter(part).select("text").mapInArrow(_signatures(n, percent), "key long, node long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return materialize(found.filter(F.col("n") > least).select("key"), "frequent-keys")


def _without_frequent(met: DataFrame, schemes: Schemes) -> DataFrame:
    """Each set's keys but its ``shared - 1`` most frequent ones of each scheme."""
    spare = F.element_at(F.array(*[F.lit(schemes.scheme(b).shared - 1) for b in range(BANDS)]), (F.col("key").bitwiseAND(BANDS - 1) + 1).cast("int"))
    ranked = Window.partitionBy("node", F.col("key").bitwiseAND(BANDS - 1)).orderBy(F.desc("n"), "key")
    return met.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") > spare).select("key", "node")
