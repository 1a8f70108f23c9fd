"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes.

Features are the character n-grams (lower case, 3 to 6 code points, hashed) that
a text holds, each valued by its naive Bayes log-count ratio: how much more
often toxic texts hold it than others. A logistic regression with an L2 penalty
is trained on these values. The ratio and the weight of a feature multiply to
one number, so scoring a text adds up one table entry per feature it holds.

Training takes the labelled rows, at most ``max_rows`` of them (those least in a
hashed order), and of their features the ``max_features`` that tell the classes
apart best among those in ``min_texts`` texts of the sample: these two are
settings of the model and say how large it is; all n-grams of the sample are
counted for that choice. Counting is distributed; the driver fits the weights
on the sample's lists of chosen features, two bytes each: at most
2 * ``max_rows`` * ``max_features`` bytes, 164 MB. Scoring reads every whole text.

Defined cases: texts of any length are read in whole, run by run; null and empty
texts hold no n-gram and get the score of the
intercept; ids with several labels train once for each; labels that are null or
without a document are ignored; without labels of both classes every score is
the smoothed share of toxic labels; repeated rows are scored alike; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ORDERS, BITS = (3, 4, 5, 6), 20
CHUNK = 1 << 17


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, code points, start of each text) of runs of texts; a zero stands between texts."""
    texts = [f"\0 {t.lower()} " if t else "\0" for t in column.to_pylist()]
    sizes = np.cumsum([0, *map(len, texts)])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK, "right")) - 1)
        points = np.frombuffer("".join(texts[at:end]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        yield at, end, points, sizes[at : end + 1] - sizes[at]
        at = end


def _grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the feature of the n-gram that begins at each place; n-grams over a border get the last one, which none else has."""
    zeros = np.concatenate(([0], np.cumsum(points == 0)))
    h = points * np.uint32(0x85EBCA6B)
    for k in range(1, ORDERS[-1]):
        if len(h) <= 1:
            return
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x01000193) + points[k:] * np.uint32(0x85EBCA6B)
        if k + 1 in ORDERS:
            found = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
            found[found == (1 << BITS) - 1] = 0
            found[zeros[k + 1 :] != zeros[: -k - 1]] = (1 << BITS) - 1
            yield found


def held_features(column: pa.Array, chosen: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct features with ``chosen`` set that each text holds."""
    chosen = chosen.copy()
    chosen[-1] = False
    for a, b, points, starts in _texts(column):
        owners, found = [], []
        for feature in _grams(points):
            at = np.flatnonzero(chosen[feature])
            owners.append(np.searchsorted(starts, at, "right") - 1)
            found.append(feature[at])
        if not found:
            yield from (np.zeros(0, dtype=np.int64) for _ in range(b - a))
            continue
        keys = np.unique((np.concatenate(owners).astype(np.int64) << BITS) | np.concatenate(found))
        cuts = np.searchsorted(keys >> BITS, np.arange(b - a + 1))
        for k in range(b - a):
            yield keys[cuts[k] : cuts[k + 1]] & ((1 << BITS) - 1)


@dataclass
class Model:
    """``table[f]``: ratio times weight of feature f; 0 for features that were not chosen."""

    intercept: float
    features: np.ndarray
    weights: np.ndarray

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        chosen, value = np.zeros(1 << BITS, dtype=bool), np.zeros(1 << BITS)
        chosen[self.features], value[self.features] = True, self.weights
        return chosen, value


def _counted(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) to (feature, with, without): texts of each class that hold it."""
    counts, everything = np.zeros((2, 1 << BITS), dtype=np.int64), np.ones(1 << BITS, dtype=bool)
    for batch in frames:
        for toxic, held in zip(batch.column("toxic").to_pylist(), held_features(batch.column("text"), everything), strict=True):
            counts[toxic, held] += 1
    seen = np.flatnonzero(counts.sum(axis=0))
    if len(seen):
        yield pa.record_batch({"feature": seen, "toxic_texts": counts[1, seen], "other_texts": counts[0, seen]})


def _listed(chosen: np.ndarray, place: np.ndarray):
    """Texts to the places of the chosen features that they hold, as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            held = held_features(pa.array(pdf["text"], pa.string()), chosen)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "held": [place[x].tobytes() for x in held]})

    return run


def fit_weights(held: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, penalty: float = 1e-4, rounds: int = 300, rate: float = 0.05) -> tuple[float, np.ndarray]:
    """Logistic regression by Adam over whole passes; ``held`` are places in ``ratio``."""
    n = len(toxic)
    flat = np.concatenate([*held, np.zeros(0, dtype=np.uint16)])
    owner = np.repeat(np.arange(n), [len(x) for x in held])
    scale = ratio[flat]
    share = (toxic.sum() + 1) / (n + 2)
    b, w = float(np.log(share / (1 - share))), np.zeros(len(ratio))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(owner, weights=scale * w[flat], minlength=n)
        err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic
        grad = np.append(np.bincount(flat, weights=scale * err[owner], minlength=len(ratio)) / n + penalty * w, err.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= float(step[-1])
    return b, w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 4096, min_texts: int = 5) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``max_features`` up to 65,536."""
    sample = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    rows = materialize(docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic"), "toxicity-sample")  # at most max_rows labels
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    share = (n_toxic + 1) / (n_toxic + n_other + 2)
    nothing = Model(float(np.log(share / (1 - share))), np.zeros(0, dtype=np.int64), np.zeros(0))
    if not n_toxic or not n_other:
        return nothing
    counts = rows.select("text", "toxic").mapInArrow(_counted, "feature long, toxic_texts long, other_texts long").groupBy("feature").agg(F.sum("toxic_texts").alias("p"), F.sum("other_texts").alias("q"))
    p, q = (F.col("p") + 1) / F.lit(n_toxic + 2.0), (F.col("q") + 1) / F.lit(n_other + 2.0)
    both = (F.col("p") + F.col("q") + 2) / F.lit(n_toxic + n_other + 4.0)
    apart = F.abs(p - q) / F.sqrt(both * (1 - both) * F.lit(1 / (n_toxic + 2) + 1 / (n_other + 2)))
    best = counts.filter(F.col("p") + F.col("q") >= min_texts).select("feature", F.log(p / q).alias("ratio"), apart.alias("apart")).orderBy(F.desc("apart"), "feature").limit(max_features).collect()
    if not best:
        return nothing
    features, ratio = np.array([r["feature"] for r in best]), np.array([r["ratio"] for r in best])
    chosen, place = np.zeros(1 << BITS, dtype=bool), np.zeros(1 << BITS, dtype=np.uint16)
    chosen[features], place[features] = True, np.arange(len(features))
    told = rows.mapInPandas(_listed(chosen, place), "doc_id long, toxic int, held binary").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("held", "ascending")])
    intercept, weights = fit_weights([np.frombuffer(x.as_buffer(), dtype=np.uint16) for x in told.column("held")], told.column("toxic").to_numpy().astype(np.float64), ratio)
    return Model(intercept, features, weights * ratio)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``score`` (0 to 1) for every row, from the whole text alone."""
    told = docs.sparkSession.sparkContext.broadcast((model.intercept, model.features, model.weights))  # at most max_features entries

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intercept, features, weights = told.value
        chosen, value = Model(intercept, features, weights).table()
        for batch in batches:
            sums = np.array([value[held].sum() for held in held_features(batch.column("text"), chosen)])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(sums + intercept, -40, 40)))})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def held_out(key: Column) -> Column:
    """The third of all ids that training never sees."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1
