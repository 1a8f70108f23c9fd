"""How sources of a language differ in their words: an exact recount by minimal perfect hashes.

*First pass.* The documents that hold a term are counted by language and term;
the terms of at least ``min_docs`` documents are kept.

*Perfect hashes.* A language's kept terms are dealt by hash to shards of about
``SHARD`` terms. In each shard a minimal perfect hash is made by hashing to
buckets and displacing these, largest first, until all terms have slots of their
own. A shard stores its displacements and its terms in the order of their slots.

*Second pass.* The shards are broadcast and each task counts the words of its
documents: a word is hashed, and where the term that is stored in its slot is
this word, the slot is raised in the dense array of its language and source.
Broadcasts are bounded: shards of more than ``WAVE_BYTES`` in all are taken in
waves, each with a pass of its own.

The counts of all groups meet by shard, and a task gives the sums of absolute
differences between all sources of a language over its shard, and its shard's
best terms of each source. All arithmetic is in whole numbers.

Defined cases: a null text, language or source is the empty string; rows that
repeat are documents of their own; a group without any kept term counts 0 of
each; a language without kept terms gives pairs of value 0 and no terms, one
with a single source no pairs; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Terms of a shard, and of a bucket in it, on average.
SHARD, BUCKET = 128, 4
#: Bytes of shards that are broadcast at once.
WAVE_BYTES = 64 << 20
#: Distinct words, and slots of dense arrays, that a task holds before it passes them on.
HELD_WORDS, HELD_SLOTS = 400_000, 16_000_000
SMOOTHING, SCALE = 5, 1_000_000_000

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: Upper case ASCII to lower case, all other ASCII but letters to a space; bytes of other characters stay.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() and chr(b).islower() else b + 32 if chr(b).isalpha() else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters, in lower case, and of characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_LETTERS).split()


def _document_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, term, n): in how many of the rows seen so far."""
    seen: dict[str, Counter] = defaultdict(Counter)

    def told() -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            if counts:
                yield pa.record_batch({"lang": pa.array([lang] * len(counts)), "term": pa.array(list(counts), pa.binary()).cast(pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            seen[lang].update(set(terms_of(text.as_py())))
        if sum(map(len, seen.values())) > HELD_WORDS:
            yield from told()
            seen.clear()
    yield from told()


# --- minimal perfect hashes ---------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit hash of each word: by the first a word finds its shard, by both its slot."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def _slot(high: np.ndarray, low: np.ndarray, moved: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return _mix(low ^ _mix(high + moved * _ODD)) % np.asarray(n, np.uint64)


def n_buckets(n: np.ndarray | int) -> np.ndarray | int:
    return -(-n // BUCKET)


def perfect_hash(terms: list[bytes], tries: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by bucket, and each term's slot: 0 to len(terms) - 1, each once."""
    n = len(terms)
    high, low = digests(terms)
    bucket = (low % _U(n_buckets(n))).astype(np.int64)
    moved, slots, taken = np.zeros(n_buckets(n), np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    sizes = np.bincount(bucket, minlength=n_buckets(n))
    members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(sizes)[:-1])
    for b in np.argsort(-sizes, kind="stable"):
        own = members[b]
        if not len(own):
            break
        for first in range(0, tries, 256):
            at = np.arange(first, first + 256, dtype=np.uint64)
            tried = _slot(high[own][None, :], low[own][None, :], at[:, None], n).astype(np.int64)
            free = ~taken[tried].any(axis=1)
            if len(own) > 1:
                ordered = np.sort(tried, axis=1)
                free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if free.any():
                hit = int(free.argmax())
                moved[b], slots[own] = first + hit, tried[hit]
                taken[tried[hit]] = True
                break
        else:
            raise ValueError("two terms of one shard have the same 128-bit hash")
    return moved, slots


def _dealt(n_shards: dict[str, int]):
    """(lang, term) with its shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            high, _ = digests([t.encode() for t in batch.column("term").to_pylist()])
            shard = (high % np.array([n_shards[x] for x in langs], np.uint64)).astype(np.int32)
            yield pa.record_batch({"lang": batch.column("lang"), "term": batch.column("term"), "shard": pa.array(shard)})

    return run


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's terms to (lang, shard, moved, terms by slot, bytes)."""
    terms = [t.encode() for t in pdf["term"]]
    moved, slots = perfect_hash(terms)
    by_slot = pdf["term"].to_numpy()[np.argsort(slots)]
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "moved": [moved.tobytes()], "terms": [list(by_slot)], "bytes": [moved.nbytes + sum(map(len, terms))]})


class PerfectHashes:
    """The shards of one language that are at hand."""

    def __init__(self, n_shards: int, rows: list[tuple[int, bytes, list[str]]]) -> None:
        """``rows``: shard, displacements, terms by slot."""
        rows = sorted(rows)
        self.n, self.first, self.moved_at = (np.zeros(n_shards, np.int64) for _ in range(3))
        shards = [s for s, _, _ in rows]
        self.n[shards] = [len(t) for _, _, t in rows]
        self.first = np.cumsum(self.n) - self.n
        self.moved = np.frombuffer(b"".join(m for _, m, _ in rows), np.uint32).astype(np.uint64)
        self.moved_at = np.cumsum(n_buckets(self.n)) - n_buckets(self.n)
        self.terms = np.empty(int(self.n.sum()), object)
        self.terms[:] = [t.encode() for _, _, ts in rows for t in ts]

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's slot among all at hand, -1 for what is no kept term."""
        high, low = digests(words)
        shard = (high % _U(len(self.n))).astype(np.int64)
        n = self.n[shard]
        out, here = np.full(len(words), -1, np.int64), np.flatnonzero(n)
        if len(here):
            high, low, shard, n = high[here], low[here], shard[here], n[here]
            bucket = (low % n_buckets(n).astype(np.uint64)).astype(np.int64)
            slot = self.first[shard] + _slot(high, low, self.moved[self.moved_at[shard] + bucket], n).astype(np.int64)
            asked = np.empty(len(here), object)
            asked[:] = [words[i] for i in here]
            same = self.terms[slot] == asked
            out[here[same]] = slot[same]
        return out

    def place(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot in it."""
        shard = np.searchsorted(self.first, slots, side="right") - 1
        return shard, slots - self.first[shard]


def _recounted(shared):
    """(lang, source, text) to (lang, source, shard, place, n)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, PerfectHashes] = shared.value
        words: dict[tuple[str, str], Counter] = defaultdict(Counter)
        dense: dict[tuple[str, str], np.ndarray] = {}

        def raise_slots() -> None:
            for group, counts in words.items():
                own = hashes[group[0]]
                if group not in dense:
                    dense[group] = np.zeros(len(own.terms), np.int64)
                slots, n = own.find(list(counts)), np.fromiter(counts.values(), np.int64, len(counts))
                dense[group][slots[slots >= 0]] += n[slots >= 0]  # each word is there once
            words.clear()

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                if len(slots := np.flatnonzero(counts)):
                    shard, place = hashes[lang].place(slots)
                    yield pa.record_batch({
                        "lang": pa.array([lang] * len(slots)), "source": pa.array([source] * len(slots)), "shard": pa.array(shard.astype(np.int32)), "place": pa.array(place.astype(np.int32)), "n": pa.array(counts[slots]),
                    })
            dense.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                if lang in hashes and (found := terms_of(text.as_py())):
                    words[lang, source].update(found)
            if sum(map(len, words.values())) > HELD_WORDS:
                raise_slots()
                if sum(map(len, dense.values())) > HELD_SLOTS:
                    yield from told()
        raise_slots()
        yield from told()

    return run


# --- differences ----------------------------------------------------------------


def per_billion(counts: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (total + 5 * n_terms)), exactly."""
    whole = total + SMOOTHING * n_terms
    if counts.size and int(counts.max()) + SMOOTHING >= np.iinfo(np.int64).max // SCALE:
        counts = counts.astype(object)
    return (1 + (counts + SMOOTHING) * SCALE // whole).astype(np.int64)


def _compared(top: int):
    """All that is known of one shard of a language to (lang, source, part, item, value)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, groups = pdf["lang"].iloc[0], pdf[pdf["kind"] == "group"].sort_values("source")
        sources, totals, n_terms, all_lang = list(groups["source"]), [int(x) for x in groups["n"]], int(groups["n_terms"].iloc[0]), int(groups["all_lang"].iloc[0])
        listed = pdf[pdf["kind"] == "terms"]["terms"]
        terms = [t.encode() for t in listed.iloc[0]] if len(listed) else []
        counts, rows = np.zeros((len(sources), len(terms)), np.int64), pdf[pdf["kind"] == "count"]
        counts[pd.Index(sources).get_indexer(rows["source"]), rows["place"]] = rows["n"]
        order = np.array(sorted(range(len(terms)), key=terms.__getitem__), np.int64)  # so that ties are in order
        counts, named = counts[:, order], [terms[i].decode() for i in order]
        shares = np.array([per_billion(c, t, n_terms) for c, t in zip(counts, totals, strict=True)]).reshape(counts.shape) if terms else counts
        out = {"source": [], "part": [], "item": [], "value": []}

        def add(source: str, part: str, items: list[str], values: np.ndarray) -> None:
            out["source"] += [source] * len(items)
            out["part"] += [part] * len(items)
            out["item"] += items
            out["value"] += values.tolist()

        for i, source in enumerate(sources):
            far = np.abs(shares - shares[i]).sum(axis=1)
            others = [j for j in range(len(sources)) if j != i]
            add(source, "pair", [sources[j] for j in others], far[others])
        if terms:
            over = shares - per_billion(counts.sum(axis=0), all_lang, n_terms)
            for i, source in enumerate(sources):
                hits = np.flatnonzero((counts[i] > 0) & (over[i] > 0))
                best = hits[np.argsort(-over[i][hits], kind="stable")[:top]]
                add(source, "term", [named[j] for j in best], over[i][best])
        return pd.DataFrame({"lang": [lang] * len(out["value"])} | out, dtype=object).astype({"value": "int64"})

    return run


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term of the terms in at least ``min_docs`` rows of a language; ``docs``: lang, source, text, without nulls."""
    found = docs.select("lang", "text").mapInArrow(_document_terms, "lang string, term string, n long")
    return materialize(found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term"), "kept-terms")


def recount(docs: DataFrame, hashes: DataFrame, n_shards: dict[str, int], wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """lang, source, shard, place, n: how often each group has the term in each slot, where it has it at all."""
    context = docs.sparkSession.sparkContext
    size = hashes.agg(F.sum("bytes")).first()[0] or 0
    waves = max(1, -(-size // wave_bytes))
    out: DataFrame | None = None
    for wave in range(waves):
        of_wave = hashes.filter(F.pmod(F.xxhash64("lang", "shard"), F.lit(waves)) == wave)
        by_lang: dict[str, list] = defaultdict(list)
        for r in of_wave.select("lang", "shard", "moved", "terms").collect():  # about ``wave_bytes``
            by_lang[r["lang"]].append((r["shard"], bytes(r["moved"]), r["terms"]))
        shared = context.broadcast({lang: PerfectHashes(n_shards[lang], rows) for lang, rows in by_lang.items()})
        found = docs.select("lang", "source", "text").mapInArrow(_recounted(shared), "lang string, source string, shard int, place int, n long")
        counted = materialize(found.groupBy("lang", "source", "shard", "place").agg(F.sum("n").alias("n")), "slot-counts")
        shared.destroy()
        out = counted if out is None else out.unionAll(counted)
    return out


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source", wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = kept_terms(docs, min_docs)
    n_terms = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    n_shards = {k: -(-n // SHARD) for k, n in n_terms.items()}
    dealt = kept.mapInArrow(_dealt(n_shards), "lang string, term string, shard int")
    hashes = materialize(dealt.groupBy("lang", "shard").applyInPandas(_built, "lang string, shard int, moved binary, terms array<string>, bytes long"), "perfect-hashes")
    counts = recount(docs, hashes, n_shards, wave_bytes)

    sizes = hashes.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_terms"), F.count(F.lit(1)).alias("_shards"), F.max("shard").alias("_last"))
    groups = docs.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = groups.groupBy("lang").agg(F.sum("n").alias("all_lang"))
    groups = groups.join(whole, "lang").join(sizes, "lang", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0)))))
    no = {"terms": F.lit(None).cast("array<string>"), "source": F.lit(""), "place": F.lit(-1), "n": F.lit(0).cast("long"), "n_terms": F.lit(0).cast("long"), "all_lang": F.lit(0).cast("long")}
    columns = ["lang", "shard", "kind", *no]
    as_rows = lambda df, kind: df.withColumns({"kind": F.lit(kind)} | {c: v for c, v in no.items() if c not in df.columns}).select(*columns)
    groups = groups.withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    met = as_rows(counts, "count").unionAll(as_rows(groups, "group")).unionAll(as_rows(hashes, "terms"))
    compared = met.groupBy("lang", "shard").applyInPandas(_compared(top), "lang string, source string, part string, item string, value long")
    compared = materialize(compared.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "compared")
    ranked = compared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    of_part = lambda part: ranked.filter(F.col("part") == part)
    return of_part("pair").unionAll(of_part("term").filter(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
