"""Repeated byte strings, found by a distributed enhanced suffix array.

A string of ``length`` bytes that occurs twice must be seen without comparing
every suffix with every other. Each text is winnowed: of all ``gram``-byte
strings inside any ``length`` consecutive bytes, the one with the least hash is
an *anchor*. Equal strings have equal anchors, so two occurrences of a string
share an anchor at the same place inside it. Around an anchor its context is
all that a string holding it can reach.

Anchors with equal grams form a bucket. Contexts that are equal as a whole are
one class (a class of two or more is repeated as a whole, nothing to compare).
For the classes of a bucket the suffixes from the anchor are sorted, with the
longest common prefixes of neighbours; a stack scan over them gives the
common-prefix intervals. In each interval the members are put in the order of
their reversed left contexts, and a second scan gives the sets of members that
agree to the left. Such a set is a maximal repeat if it is left-diverse (its
left extension ends there) and its members come from different children of the
interval (so is its right one); it is put out with all its occurrences.

A bucket of very many classes is split instead: the window offsets around the
anchor are cut into ranges, each range with the core that all its windows hold,
and classes are formed anew by core; what is still mixed is told apart by the
single windows. Both steps are counts with partial aggregation, so no bucket is
ever gathered in one task.

Defined cases: a null text is empty; texts below ``length`` bytes keep all;
overlapping occurrences count; repeated rows are occurrences of each other;
strings are judged on the input; extra columns are ignored by
:func:`repeat_digests` and kept by :func:`remove_repeats`; an empty table gives
an empty result. Grams, contexts and rows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import discard
from .common import join_one_of_each, materialize, row_key
from .shingles import U, _power_tables, chunks, mix, text_buffers

LENGTH, GRAM = 400, 64
#: Classes of a bucket that are compared as one suffix array; larger buckets are split.
BUCKET = 8192
#: Window offsets in a range of a split bucket.
RANGE = 17


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` consecutive entries."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def _prefix(data: np.ndarray) -> np.ndarray:
    powers, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers[: len(data)], out=sums[1:])
    return sums


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), whatever stands before."""
    _, inverse = _power_tables(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def _anchors(length: int, gram: int):
    """Rows (row, text) to (gram, ctx, row, pos): anchors, with a hash of their whole context."""
    width = length - gram + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            whole, offsets = text_buffers(batch.column("text"))
            for a, b in chunks(offsets):
                data, at = whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if len(data) < length:
                    continue
                sums = _prefix(data)
                starts = np.arange(len(data) - gram + 1)
                hashes = _hash(sums, starts, starts + gram) | U(1)
                least = _slide(hashes, width, np.minimum)
                # Windows that leave their text count for nothing.
                ends_at = at[np.searchsorted(at, np.arange(len(least)), "right")]
                least[np.arange(len(least)) + length > ends_at] = 0
                pad = np.zeros(width - 1, dtype=np.uint64)
                chosen = np.flatnonzero(_slide(np.concatenate((pad, least, pad)), width, np.maximum) == hashes)
                if not len(chosen):
                    continue
                text = np.searchsorted(at, chosen, "right") - 1
                left, right = np.maximum(at[text], chosen - (length - gram)), np.minimum(at[text + 1], chosen + length)
                ctx = mix(_hash(sums, left, right) + (chosen - left).astype(np.uint64))
                yield pa.record_batch({
                    "gram": hashes[chosen].astype(np.int64), "ctx": ctx.astype(np.int64), "row": rows[a + text],
                    "pos": (chosen - at[text]).astype(np.int32),
                })

    return run


def _common(order: list[int], texts: list[bytes]) -> np.ndarray:
    """Longest common prefix of each text with the one before it in ``order``; the first has 0."""
    sizes = np.array([len(texts[i]) for i in order])
    wide = max(1, int(sizes.max(initial=1)))
    matrix = np.frombuffer(b"".join(texts[i].ljust(wide, b"\0") for i in order), dtype=np.uint8).reshape(len(order), wide)
    out = np.zeros(len(order), dtype=np.int64)
    differ = matrix[1:] != matrix[:-1]
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
    """The common-prefix intervals of a sorted list, children first.

    ``lcp[i]`` belongs to entries i - 1 and i. Yields (value, first, last,
    children), children being the (first, last) of the maximal sub-intervals;
    entries outside them are children of their own.
    """
    stack: list[list] = [[0, 0, []]]  # value, first, children
    for i in range(1, len(lcp) + 1):
        value, first = lcp[i] if i < len(lcp) else -1, i - 1
        closed: tuple[int, int] | None = None
        while stack and stack[-1][0] > value:
            top = stack.pop()
            if closed:
                top[2].append(closed)
            yield top[0], top[1], i - 1, top[2]
            first, closed = top[1], (top[1], i - 1)
        if not stack or stack[-1][0] < value:
            if value >= 0:
                stack.append([value, first, [closed] if closed else []])
        elif closed:
            stack[-1][2].append(closed)


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left extension, right extension, members) of every maximal repeat of at least ``length`` bytes.

    ``lefts`` are reversed; a repeat is left + right around the anchor.
    """
    n = len(rights)
    by_right, by_left = sorted(range(n), key=rights.__getitem__), sorted(range(n), key=lefts.__getitem__)
    right_lcp, left_lcp = _common(by_right, rights).tolist(), _common(by_left, lefts).tolist()
    place = {m: k for k, m in enumerate(by_left)}
    reach = max(left_lcp)
    for value, first, last, children in intervals(right_lcp):
        if first == last or value + reach < length:
            continue
        child = {}
        for k, (a, b) in enumerate(children):
            child |= {by_right[i]: -1 - k for i in range(a, b + 1)}
        members = sorted(by_right[first : last + 1], key=place.__getitem__)
        agree = [0] * len(members)
        for k in range(1, len(members)):
            agree[k] = min(left_lcp[place[members[k - 1]] + 1 : place[members[k]] + 1])
        for left, a, b, inner in intervals(agree):
            # The root stands at 0 even where all members agree further.
            if a < b and inner != [(a, b)] and left + value >= length and len({child.get(m, m) for m in members[a : b + 1]}) > 1:
                yield left, value, members[a : b + 1]


def _range_minima(values: list[int]) -> list[list[int]]:
    """Sparse table: row k holds the least of every 2 ** k consecutive values."""
    table, have = [np.array(values)], 1
    while 2 * have <= len(values):
        table.append(np.minimum(table[-1][:-have], table[-1][have:]))
        have *= 2
    return [t.tolist() for t in table]


def reaches(lefts: list[bytes], rights: list[bytes], length: int) -> tuple[list[int], list[int]]:
    """How far left and right of the anchor each member is covered by maximal repeats.

    The common-prefix intervals are visited from the deepest up, and the members
    of each stand in the order of their left contexts. Where children meet, the
    smaller is put into the larger: members that become neighbours come from
    different children, so the repeat is right-diverse, and it ends on the left
    where their left contexts part. All other repeats of a member in the
    interval reach less far left, and those found before reach further right.
    """
    n = len(rights)
    by_right, by_left = sorted(range(n), key=rights.__getitem__), sorted(range(n), key=lefts.__getitem__)
    right_lcp, left_lcp = _common(by_right, rights).tolist(), _common(by_left, lefts).tolist()
    place = [0] * n
    for k, m in enumerate(by_left):
        place[m] = k
    minima = _range_minima(left_lcp)

    def agree(a: int, b: int) -> int:
        """Common left context of the members at places a < b."""
        k = (b - a).bit_length() - 1
        return min(minima[k][a + 1], minima[k][b + 1 - (1 << k)])

    left, right, best = [0] * n, [0] * n, max(left_lcp)
    held: dict[int, list[int]] = {}  # first entry of an interval -> places of its members, in order
    for value, first, last, children in intervals(right_lcp):
        if first == last:
            continue
        parts, at = [], first
        for a, b in sorted(children):
            parts += [[place[by_right[i]]] for i in range(at, a)]
            parts.append(held.pop(a) if a in held else [place[by_right[i]] for i in range(a, b + 1)])
            at = b + 1
        parts += [[place[by_right[i]]] for i in range(at, last + 1)]
        whole = max(parts, key=len)
        for part in parts:
            if part is whole:
                continue
            for p in part:
                i = bisect_left(whole, p)
                if value + best >= length:
                    for q in whole[max(i - 1, 0) : i + 1]:
                        shared = agree(min(p, q), max(p, q))
                        if shared + value >= length:
                            for m in (by_left[p], by_left[q]):
                                left[m], right[m] = max(left[m], shared), max(right[m], value)
                whole.insert(i, p)
        held[first] = whole
    return left, right


def _buckets(batches: Iterable[pa.RecordBatch], least: int = 2) -> Iterator[tuple[int, list[tuple]] | None]:
    """(gram, rows) of each bucket of ``least`` rows and more, from rows in order of their gram; None after each batch."""
    gram, waiting = None, []
    for batch in batches:
        for key, *rest in zip(*[batch.column(c).to_pylist() for c in ("gram", "row", "pos", "n", "left", "right")], strict=True):
            if key != gram:
                if len(waiting) >= least:
                    yield gram, waiting
                gram, waiting = key, []
            waiting.append(tuple(rest))
        yield None
    if len(waiting) >= least:
        yield gram, waiting
    yield None


def _reaches(length: int):
    """Whole buckets to (row, start, stop): what all repeats around an anchor cover together.

    All of them hold the anchor, so their union is one run. Classes of more
    than one context are covered as a whole anyway and are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[int, int, int]] = []
        for bucket in _buckets(batches):
            if bucket is None:
                if made:
                    yield pa.record_batch({n: pa.array(list(c), pa.int64()) for n, c in zip(("row", "start", "stop"), zip(*made, strict=True), strict=True)})
                    made = []
                continue
            rows = bucket[1]
            lefts, rights = reaches([r[3][::-1] for r in rows], [r[4] for r in rows], length)
            made += [(r[0], r[1] - a, r[1] + b) for r, a, b in zip(rows, lefts, rights, strict=True) if r[2] == 1 and a + b]
    return run


def _anchored(sums: np.ndarray, before: int, gram: int) -> tuple[int, int]:
    """How many bytes left and right of a context's anchor there are before a gram of lesser hash.

    A string chooses the anchor by itself, and so in each of its occurrences,
    if the anchor's hash is the least of a window inside the string. Other
    strings around it are found at the anchors that are their own.
    """
    starts = np.arange(len(sums) - gram)
    hashes = _hash(sums, starts, starts + gram) | U(1)
    less = np.flatnonzero(hashes < hashes[before])
    k = int(np.searchsorted(less, before))
    return before - (int(less[k - 1]) + 1 if k else 0), (int(less[k]) if k < len(less) else len(hashes)) - 1 - before


def _groups(length: int, gram_size: int):
    """Whole buckets to (group, gram, row, pos, before, size): a row per class that holds a maximal repeat, named by its first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches, 1):
            if bucket is None:
                continue
            gram, rows = bucket
            # A class of more than one context stands twice, so that what only its own contexts share is a repeat as well.
            rows = [r for r in rows for _ in range(min(r[2], 2))]
            if len(rows) < 2:
                continue
            free: dict[int, tuple[int, int]] = {}
            for k, (left, right, members) in enumerate(maximal_repeats([r[3][::-1] for r in rows], [r[4] for r in rows], length)):
                one = members[0]
                if one not in free:
                    free[one] = _anchored(_prefix(np.frombuffer(rows[one][3] + rows[one][4], dtype=np.uint8)), len(rows[one][3]), gram_size)
                if min(free[one][0], left) + min(free[one][1], right - gram_size) < length - gram_size:
                    continue
                group = int(mix(np.array([gram], dtype=np.int64).astype(np.uint64) + U(k))[0].astype(np.int64))
                out = [(group, gram, row, pos, left, left + right) for row, pos in {rows[m][:2] for m in members}]
                yield pa.record_batch({n: pa.array(list(c), pa.int64()) for n, c in zip(("group", "gram", "row", "pos", "before", "size"), zip(*out, strict=True), strict=True)})

    return run


def _each_context(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    for r in batch.to_pylist():
        yield r, _prefix(np.frombuffer(r["left"] + r["right"], dtype=np.uint8))


def _cores(length: int, gram: int):
    """Contexts of split buckets to a row per range of offsets: (core, ctx, row, pos, n, part, start, size)."""
    span = length - gram + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[pa.RecordBatch] = []
            for r, sums in _each_context(batch):
                before, after = len(r["left"]), len(r["right"])
                low = np.arange(0, span, RANGE)
                high = np.minimum(low + RANGE, span) - 1
                ok = (np.maximum(low, length - after) <= np.minimum(high, before))
                low, high = low[ok], high[ok]
                core = _hash(sums, before - low, before - high + length)
                start, end = np.maximum(before - high, 0), np.minimum(before - low + length, before + after)
                key = mix(core + mix(low.astype(np.uint64) + np.array([r["gram"]], dtype=np.int64).astype(np.uint64)))
                ctx = mix(_hash(sums, start, end) + (before - start).astype(np.uint64))
                out.append(pa.record_batch({
                    "core": key.astype(np.int64), "ctx": ctx.astype(np.int64), "row": np.full(len(low), r["row"]), "pos": np.full(len(low), r["pos"]), "n": np.full(len(low), r["n"]),
                    "part": low.astype(np.int64), "start": r["pos"] - before + start, "size": end - start,
                }))
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()

    return run


def _windows(length: int, gram: int):
    """Contexts and a range of offsets to a row per window: (window, row, n, start)."""
    span = length - gram + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[pa.RecordBatch] = []
            for r, sums in _each_context(batch):
                before, after = len(r["left"]), len(r["right"])
                x = np.arange(max(r["part"], length - after), min(r["part"] + RANGE, span, before + 1))
                key = mix(_hash(sums, before - x, before - x + length) + mix(x.astype(np.uint64) + np.array([r["gram"]], dtype=np.int64).astype(np.uint64)))
                out.append(pa.record_batch({"window": key.astype(np.int64), "row": np.full(len(x), r["row"]), "n": np.full(len(x), r["n"]), "start": r["pos"] - x}))
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()

    return run


def _left_windows(length: int, gram: int):
    """Contexts of split buckets to a row per window: (window, gram, row, pos, n, x, l), ``l`` the byte before it, -1 where the context begins."""
    span = length - gram + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[pa.RecordBatch] = []
            for r, sums in _each_context(batch):
                before, after = len(r["left"]), len(r["right"])
                x = np.arange(max(0, length - after), min(span, before + 1))
                key = mix(_hash(sums, before - x, before - x + length) + mix(x.astype(np.uint64) + np.array([r["gram"]], dtype=np.int64).astype(np.uint64)))
                ahead = np.concatenate(([-1], np.frombuffer(r["left"], dtype=np.uint8).astype(np.int64)))[before - x]
                same = {c: np.full(len(x), r[c]) for c in ("gram", "row", "pos", "n")}
                out.append(pa.record_batch({"window": key.astype(np.int64), **same, "x": x, "l": ahead}))
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()

    return run


def _extended(length: int, gram: int):
    """Contexts and the offsets ``xs`` of their windows to a row per longer string that begins with the window.

    (group, gram, row, pos, n, before, size, l, r), ``l`` and ``r`` the bytes around it, -1 where the context ends.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, sums in _each_context(batch):
                before, after = len(r["left"]), len(r["right"])
                xs = np.array(r["xs"], dtype=np.int64)
                x = np.repeat(xs, after - (length - xs) + 1)
                b = np.concatenate([np.arange(length - v, after + 1) for v in xs])
                free = _anchored(sums, before, gram)
                own = np.minimum(x, free[0]) + np.minimum(b - gram, free[1]) >= length - gram
                x, b = x[own], b[own]
                key = mix(_hash(sums, before - x, before + b) + mix(x.astype(np.uint64) + np.array([r["gram"]], dtype=np.int64).astype(np.uint64)))
                left = np.concatenate(([-1], np.frombuffer(r["left"], dtype=np.uint8).astype(np.int64)))[before - x]
                right = np.concatenate((np.frombuffer(r["right"], dtype=np.uint8).astype(np.int64), [-1]))[b]
                same = {c: np.full(len(x), r[c]) for c in ("gram", "row", "pos", "n")}
                yield pa.record_batch({"group": key.astype(np.int64), **same, "before": x, "size": x + b, "l": left, "r": right})

    return run


def _split_groups(split: DataFrame, length: int, gram: int) -> DataFrame:
    """As :func:`_groups`, of buckets of any size, by counts with partial aggregation.

    A string that reaches ``before`` bytes left of the anchor begins with the
    window of that offset. It is a maximal repeat if it occurs again and neither
    the bytes before it nor those after it are all the same, the ends of
    contexts being unlike any byte. Windows that fail this on the left are no
    repeat's first window, so only the others are made longer.
    """
    ends = lambda c: F.min(c).eqNullSafe(-1) | (F.min(c) < F.max(c))
    windows = materialize(split.mapInArrow(_left_windows(length, gram), "window long, gram long, row long, pos long, n long, x long, l long"), "left-windows")
    begins = windows.groupBy("window").agg(F.sum("n").alias("_n"), ends("l").alias("_l")).filter("_n > 1 AND _l").select("window")
    offsets = windows.join(begins, "window").groupBy("gram", "row", "pos").agg(F.collect_list("x").alias("xs"))  # one context's windows
    longer = split.join(offsets, ["gram", "row", "pos"]).select("gram", "row", "pos", "n", "left", "right", "xs")
    longer = materialize(longer.mapInArrow(_extended(length, gram), "group long, gram long, row long, pos long, n long, before long, size long, l long, r long"), "longer")
    found = longer.groupBy("group").agg(F.sum("n").alias("_n"), ends("l").alias("_l"), ends("r").alias("_r")).filter("_n > 1 AND _l AND _r").select("group")
    return longer.join(found, "group").select("group", "gram", "row", "pos", "before", "size")


def _classes(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(anchors whose gram occurs again, classes of equal contexts in them) of ``docs``: row, text."""
    anchors = docs.filter(F.octet_length("text") >= length).mapInArrow(_anchors(length, gram), "gram long, ctx long, row long, pos int")
    anchors = materialize(anchors, "anchors")
    again = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(join_one_of_each(anchors, again, "gram"), "shared-anchors")
    discard(anchors)
    whole = materialize(shared.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "pos")).alias("first")), "whole-classes")
    buckets = whole.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")).withColumn("n", F.col("classes"))
    classes = materialize(join_one_of_each(whole, buckets, "gram").select("gram", "ctx", "n", "classes", "first.*"), "classes")
    discard(whole)
    return shared, classes


def _contexts(docs: DataFrame, classes: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, row, pos, n, classes, left, right): the contexts of the first of each class."""
    asked = classes.groupBy("row").agg(F.collect_list(F.struct("gram", "n", "classes", "pos")).alias("asked"))  # one text's anchors
    body, before = F.col("text").cast("binary"), F.least(F.col("a.pos"), F.lit(length - gram))
    return docs.join(asked, "row").dropDuplicates(["row"]).select("row", "text", F.explode("asked").alias("a")).select(
        "a.gram", "row", F.col("a.pos").cast("long").alias("pos"), "a.n", "a.classes",
        F.substring(body, F.col("a.pos") - before + 1, before).alias("left"), F.substring(body, F.col("a.pos") + 1, F.lit(length)).alias("right"),
    )


def _in_buckets(contexts: DataFrame) -> DataFrame:
    return contexts.filter(F.col("classes") <= BUCKET).drop("classes").repartition("gram").sortWithinPartitions("gram", "row", "pos")


def _reached(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans (row, start, stop) of ``docs``: row, text that occur again; a stop may lie beyond the text's end."""
    shared, classes = _classes(docs, length, gram)
    copied = join_one_of_each(shared, classes.filter("n > 1").select("gram", "ctx", "n"), ["gram", "ctx"])
    copied = copied.select("row", F.greatest(F.col("pos") - (length - gram), F.lit(0)).cast("long").alias("start"), (F.col("pos") + length).cast("long").alias("stop"))

    contexts = materialize(_contexts(docs, classes.filter("classes > 1"), length, gram), "contexts")
    single = _in_buckets(contexts).mapInArrow(_reaches(length), "row long, start long, stop long")

    split = contexts.filter(F.col("classes") > BUCKET)
    cores = materialize(split.mapInArrow(_cores(length, gram), "core long, ctx long, row long, pos long, n long, part long, start long, size long"), "cores")
    alike = materialize(cores.groupBy("core", "ctx").agg(F.sum("n").alias("n"), F.min(F.struct("row", "pos", "part")).alias("first")), "core-classes")
    told = join_one_of_each(cores.filter("n = 1"), alike.filter("n > 1").select("core", "ctx", "n"), ["core", "ctx"]).select("row", "start", (F.col("start") + F.col("size")).alias("stop"))
    mixed = join_one_of_each(alike, alike.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "core").select("first.*", "n")
    windows = split.drop("n").join(mixed, ["row", "pos"]).select("gram", "row", "pos", "n", "left", "right", "part").mapInArrow(_windows(length, gram), "window long, row long, n long, start long")
    windows = materialize(windows, "windows")
    twice = windows.groupBy("window").agg(F.sum("n").alias("n")).filter("n > 1")
    last = join_one_of_each(windows.filter("n = 1"), twice, "window").select("row", "start", (F.col("start") + length).alias("stop"))
    return copied.unionAll(single).unionAll(told).unionAll(last)


def _merged(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Disjoint runs inside ``size`` bytes, ascending; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], min(s["stop"], size)) for s in spans or []):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _left_over(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, stop in runs:
        kept.append(body[at:start])
        at = stop
    return b"".join([*kept, body[at:]])


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        bodies = [(t or "").encode() for t in texts]
        runs = [_merged(s, len(b)) for s, b in zip(batch.column("spans").to_pylist(), bodies, strict=True)]
        left = [_left_over(b, r) for b, r in zip(bodies, runs, strict=True)]
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(b) for b in bodies], pa.int64()),
            "n_removed": pa.array([sum(e - s for s, e in r) for r in runs], pa.int64()), "n_spans": pa.array([len(r) for r in runs], pa.int64()),
            "kept_sha256": [hashlib.sha256(x).hexdigest() for x in left], "n_kept": pa.array([len(x) for x in left], pa.int64()),
            "text": pa.array([None if t is None else x.decode(errors="ignore") for t, x in zip(texts, left, strict=True)], pa.string()),
        })


def _cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        kept = [t if not s else _left_over(body := t.encode(), _merged(s, len(body))).decode(errors="ignore") for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True)]
        names = [n for n in batch.schema.names if n not in ("text", "spans")]
        yield pa.record_batch([*[batch.column(n) for n in names], pa.array(kept, pa.string())], names=[*names, "text"])


def _word_cores(words: int):
    """Rows (row, text, spans) to (core, row, start, stop): all strings of more than ``words`` words in the spans.

    A string of so many words holds, from the last byte of its first word to the
    first byte of its last, what any such string has in common with its copies
    (its outer words may be cut). Those bytes are named by ``core``; start and
    stop are those of the outer words, as far as they lie in the span.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, spans in zip(*[batch.column(c).to_pylist() for c in ("row", "text", "spans")], strict=True):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                sums, told = _prefix(data), (data != 32) & ((data < 9) | (data > 13))
                for first, last in _merged(spans, len(data)):
                    edges = np.diff(np.concatenate(([0], told[first:last].view(np.int8), [0])))
                    starts, stops = first + np.flatnonzero(edges == 1), first + np.flatnonzero(edges == -1)
                    if len(starts) > words:
                        core = _hash(sums, stops[:-words] - 1, starts[words:] + 1)
                        yield pa.record_batch({"core": core.astype(np.int64), "row": np.full(len(core), row), "start": starts[:-words], "stop": stops[words:]})

    return run


def _with_spans(docs: DataFrame, length: int, gram: int, words: int = 0) -> DataFrame:
    """``docs`` with what is repeated in ``length`` bytes and more, or only, of that, in more than ``words`` words."""
    by_row = _reached(docs.select("row", "text"), length, gram).distinct().groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # one text's spans
    if words:
        cores = docs.select("row", "text").join(by_row, "row").mapInArrow(_word_cores(words), "core long, row long, start long, stop long")
        cores = materialize(cores, "word-cores")
        twice = cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        by_row = join_one_of_each(cores, twice, "core").select("row", "start", "stop").distinct().groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.join(by_row, "row", "left")


def repeat_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept and what is left of the text, for every row."""
    named = docs.select(F.col(key).alias("doc_id"), row_key(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return _with_spans(named, length, gram).select("doc_id", "text", "spans").mapInArrow(_digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, text string")


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal repeats around each anchor: group, row, start, size, with a row per occurrence.

    They are maximal in the anchors' contexts: a repeat that is longer than
    these gives a group of its part in the context for each of its anchors.
    """
    named = docs.select(row_key(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    shared, classes = _classes(named, length, gram)
    contexts = materialize(_contexts(named, classes, length, gram), "contexts")
    schema = "group long, gram long, row long, pos long, before long, size long"
    held = _in_buckets(contexts).mapInArrow(_groups(length, gram), schema).unionAll(_split_groups(contexts.filter(F.col("classes") > BUCKET), length, gram))
    # From the first of a class to all its members.
    by_class = held.join(classes.select("gram", "row", "pos", "ctx"), ["gram", "row", "pos"]).select("gram", "ctx", "group", "before", "size")
    return by_class.join(shared, ["gram", "ctx"]).select("group", "row", (F.col("pos") - F.col("before")).alias("start"), "size")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", words: int = 0) -> DataFrame:
    """``docs`` with the repeated bytes cut out of its text; bytes of a character cut in two go as well.

    With ``words`` only repeats of more than so many words are cut; for all of
    them to be found, ``length`` must be at most 2 * words + 1.
    """
    if words and length > 2 * words + 1:
        raise ValueError(f"{words + 1} words may have less than {length} bytes")
    others = [c for c in docs.columns if c != text]
    renamed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], row_key(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    made = _with_spans(renamed, length, gram, words).select(*[f"c{i}" for i in range(len(others))], "text", "spans")
    schema = ", ".join([*[f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)], "text string"])
    clean = made.mapInArrow(_cleaned, schema)
    back = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(others)} | {text: F.col("text").alias(text)}
    return clean.select(*[back[c] for c in docs.columns])
