"""JSON array files that are read in splits.

Where a record begins cannot be seen from the middle of a file: a brace may stand
in a string. But Spark's text reader splits a file at any separator, here the
closing brace, and what a split does to the state (in a string or not, how deep)
is a function of the state it begins in: quotes flip it whatever it is, and for
either state the brackets outside strings add up to a change of depth. A first
pass gives that function for each split; taken one after the other they give the
state in which each split begins; a second pass, now in a known state, cuts the
records out. A record that crosses splits leaves a piece in each, which meet by
their number.

What reaches the driver or all tasks is a row for each split. A file that is no
array of objects raises, as the second pass sees what stands between records and
each record is parsed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.stored import store

QUOTE, ESCAPE, CLOSE = 34, 92, 125
_STEPS = np.zeros(256, np.int8)
_STEPS[[91, 123]], _STEPS[[93, 125]] = 1, -1
SPLIT = "path string, block long"


def _escaped(data: bytes, at: int) -> bool:
    """Whether an odd number of escapes stands before a place."""
    first = at
    while first and data[first - 1] == ESCAPE:
        first -= 1
    return bool((at - first) % 2)


def _structure(data: bytes, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether a string is open behind it, and how deep it leaves off."""
    text = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(text == QUOTE)
    if len(quotes):
        doubtful = (quotes > 0) & (text[quotes - 1] == ESCAPE)
        escaped = [q for q in quotes[doubtful].tolist() if _escaped(data, q)]
        quotes = np.setdiff1d(quotes, escaped, assume_unique=True) if escaped else quotes
    flips = np.zeros(len(text), np.int8)
    flips[quotes] = 1
    open_ = (np.cumsum(flips, dtype=np.int64) + inside) & 1
    steps = np.where(open_ == 1, 0, _STEPS[text])
    return open_, depth + np.cumsum(steps, dtype=np.int64)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, bool]]:
    """(split's columns, text, whether it is the split's last) of each run of rows of one split; every row ends with a brace that the reader took off."""
    held: tuple[tuple, bytes] | None = None
    for batch in batches:
        names = [n for n in batch.schema.names if n != "value"]
        keys = list(zip(*[batch.column(n).to_pylist() for n in names], strict=True))
        values, first = batch.column("value").to_pylist(), 0
        while first < len(keys):
            last = first
            while last < len(keys) and keys[last] == keys[first]:
                last += 1
            if held:
                yield *held, held[0] != keys[first]
            held = (keys[first], ("}".join(values[first:last]) + "}").encode())
            first = last
    if held:
        yield *held, True


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does: whether it flips the state of strings, and the change of depth for either."""
    flip, deeper = 0, [0, 0]
    for (path, block), data, last in _parts(batches):
        for start in (0, 1):
            open_, depth = _structure(data, start ^ flip, 0)
            deeper[start] += int(depth[-1])
        flip = int(open_[-1]) ^ 1  # begun in state 1
        if last:
            yield pa.record_batch({"path": pa.array([path]), "block": pa.array([block]), "flip": pa.array([flip]), "deeper_out": pa.array([deeper[0]]), "deeper_in": pa.array([deeper[1]])})
            flip, deeper = 0, [0, 0]


def _between(text: bytes, first: bool) -> bytes | None:
    """A record's own text, without what separates it from the one before; None if that is not as it should be."""
    text = text.lstrip(b" \t\r\n")
    if not text.startswith(b"[" if first else b","):
        return None
    text = text[1:].lstrip(b" \t\r\n")
    return text if text.startswith(b"{") else None


def _records(pieces: bool):
    """Rows of known splits to their whole records, or to the pieces before the first and behind the last end of a record."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, seen, inside, depth, begun = b"", 0, 0, 0, False
        for (path, block, in_string, at_depth, final), data, last in _parts(batches):
            if not begun:
                carry, seen, inside, depth, begun = b"", 0, in_string, at_depth, True
            if last and final:
                data = data[:-1]  # nothing closes behind the file's end
            open_, level = _structure(data, inside, depth)
            ends = np.flatnonzero((np.frombuffer(data, np.uint8) == CLOSE) & (open_ == 0) & (level == 1)) + 1
            cuts = [0, *ends.tolist()]
            texts, out = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], []
            if texts:
                texts[0] = carry + texts[0]
                carry = b""
            head = 1 if not seen and texts else 0
            if pieces and head:
                out.append((0, True, texts[0]))
            if not pieces:
                for text in texts[head:]:
                    record = _between(text, False)
                    if record is None:
                        raise ValueError(f"{path}: not a JSON array of objects")
                    out.append((0, True, record))
            seen, carry = seen + len(texts), carry + data[cuts[-1] :]
            if len(data):
                inside, depth = int(open_[-1]), int(level[-1])
            if last:
                if pieces:
                    out.append((1, False, carry))
                begun = False
            if out:
                n = len(out)
                yield pa.record_batch({
                    "path": pa.array([path] * n), "block": pa.array([block] * n), "pos": pa.array([p for p, _, _ in out], pa.int32()), "done": pa.array([d for _, d, _ in out]), "text": pa.array([t for _, _, t in out], pa.binary()),
                })

    return run


def _stitched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, number, texts, done) of records in pieces to records; the last of a file is what stands behind its records."""
    for batch in batches:
        out = []
        for path, number, texts, done in zip(*[batch.column(c).to_pylist() for c in ("path", "number", "texts", "done")], strict=True):
            text = b"".join(texts)
            if done:
                record = _between(text, number == 0)
            else:  # behind the last record: the end of the array, or all of an empty one
                record, rest = None, text.strip(b" \t\r\n")
                if (rest == b"]") if number else (rest[:1] + rest[-1:] == b"[]" and not rest[1:-1].strip(b" \t\r\n")):
                    continue
            if record is None:
                raise ValueError(f"{path}: not a JSON array of objects")
            out.append(record.decode())
        yield pa.record_batch({"raw": pa.array(out, pa.string())})


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """``raw``: the own text of each object of the array files at ``path``."""
    rows = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    done = store(rows.mapInArrow(_summaries, f"{SPLIT}, flip long, deeper_out long, deeper_in long"), "splits")
    order = Window.partitionBy("path").orderBy("block")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    states = done.withColumn("in_string", F.coalesce(F.sum("flip").over(ahead), F.lit(0)) % 2)
    states = states.withColumn("_deeper", F.when(F.col("in_string") == 1, F.col("deeper_in")).otherwise(F.col("deeper_out")))
    states = states.select("path", "block", "in_string", F.coalesce(F.sum("_deeper").over(ahead), F.lit(0)).alias("at_depth"), F.lead("block").over(order).isNull().alias("final"))
    states = F.broadcast(store(states, "split-states"))  # a row for each split; rows keep their order in this join
    known = rows.join(states, ["path", "block"]).select("value", "path", "block", "in_string", "at_depth", "final")
    shape = f"{SPLIT}, pos int, done boolean, text binary"
    pieces = store(known.mapInArrow(_records(True), shape), "pieces")
    # Every end of a record begins the next one: pieces of one number are one record, two rows for each split in all.
    numbered = pieces.withColumn("number", F.coalesce(F.sum(F.col("done").cast("long")).over(Window.partitionBy("path").orderBy("block", "pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gathered = numbered.groupBy("path", "number").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "pos", "text"))), lambda x: x["text"]).alias("texts"), F.max("done").alias("done"))
    crossing = gathered.mapInArrow(_stitched, "raw string")
    whole = known.mapInArrow(_records(False), shape).select(F.col("text").cast("string").alias("raw"))
    checked = F.when(F.json_object_keys("raw").isNotNull(), F.col("raw")).otherwise(F.raise_error(F.lit("a record is not JSON")).cast("string"))
    return whole.unionAll(crossing).select(checked.alias("raw"))
