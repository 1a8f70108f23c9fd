"""Packing into optimal length buckets.

The lengths of all documents form one histogram, with a bin for each length that
occurs. Dynamic programming over it chooses the bucket boundaries that minimise
padding; a document goes to the first bucket whose boundary is not below its
length, and is padded to it. Inside a bucket, batches take as many documents as
the token budget allows.

The histogram has as many bins as there are different lengths: no more than the
longest text has words, and with lengths of N tokens in all fewer than
sqrt(2 N). The best cut before a bin never moves back as the bin moves on, so
each of the buckets is found by halving, in n log n steps.

Defined cases: null, empty and blank texts have length 0 and cost no padding;
a document above the budget is a batch of its own, whatever its length; repeated
rows are packed one by one; an empty table gives an empty result; the text and
the other columns are kept by :func:`pack` with ``keep``, but for those named
like an output column, which are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_slots, materialize, words_of


def bucket_boundaries(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """The boundaries, ascending, of the ``n_buckets`` buckets with least padding.

    ``lengths`` ascend. A last bucket over bins i..j costs lengths[j] for each
    of its documents. Padding is that cost less the tokens themselves, which are
    the same for any boundaries. There are fewer buckets if there are fewer
    lengths.
    """
    if not lengths:
        return []
    size, before = np.array(lengths, dtype=np.int64), np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
    n = len(lengths)
    best, cuts = size * before[1:], []
    for _ in range(min(n_buckets, n) - 1):
        # found[j]: least cost of bins 0..j with one bucket more; start[j]: where its last bucket begins.
        found, start = best.copy(), np.zeros(n, dtype=np.int64)
        spans = [(1, n - 1, 1, n - 1)]  # bins, and where their last bucket may begin
        while spans:
            first, last, low, high = spans.pop()
            if first > last:
                continue
            j = (first + last) // 2
            at = np.arange(low, min(high, j) + 1)
            cost = best[at - 1] + size[j] * (before[j + 1] - before[at])
            i = int(at[cost.argmin()])
            if cost.min() < found[j]:
                found[j], start[j] = cost.min(), i
            spans += [(first, j - 1, low, i), (j + 1, last, i, high)]
        cuts.append(start)
        best = found
    ends, j = [n - 1], n - 1
    for cut in reversed(cuts):
        if (i := int(cut[j])) > 0:
            j = i - 1
            ends.append(j)
    return sorted(int(lengths[j]) for j in ends)


def pack(docs: DataFrame, budget: int = 8192, n_buckets: int = 16, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, padded_tokens, batch_id, batch_slot; with ``keep`` also the columns of ``docs``."""
    n_tokens = F.size(words_of(F.col(text))).cast("long")
    made = ["doc_id", "n_tokens", "bucket", "padded_tokens", "batch_id", "batch_slot"]
    kept = [c for c in docs.columns if c != key and c not in made] if keep else []
    # Under names that nothing here uses, until the end.
    rows = docs.select(F.col(key).alias("doc_id"), n_tokens.alias("n_tokens"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)])
    rows = materialize(rows.withColumn("_whole", F.xxhash64(*rows.columns)), "lengths")
    histogram = sorted((r["n_tokens"], r["n"]) for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each length
    ends = bucket_boundaries([x for x, _ in histogram], [n for _, n in histogram], n_buckets)
    if not ends:
        return _laid_out(rows.withColumns({"bucket": F.lit(0), "padded_tokens": F.lit(0).cast("long"), "slot": F.lit(0).cast("long")}), budget, kept)
    bucket, width = F.lit(len(ends) - 1), F.lit(ends[-1]).cast("long")
    for k in range(len(ends) - 2, -1, -1):
        fits = F.col("n_tokens") <= ends[k]
        bucket, width = F.when(fits, F.lit(k)).otherwise(bucket), F.when(fits, F.lit(ends[k]).cast("long")).otherwise(width)
    placed = rows.withColumns({"bucket": bucket, "padded_tokens": width})
    return _laid_out(gapless_slots(placed, ["bucket"], ["doc_id", "n_tokens", "_whole"]), budget, kept)


def _laid_out(slotted: DataFrame, budget: int, kept: list[str]) -> DataFrame:
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_tokens"), F.lit(1)))).cast("long")
    return slotted.withColumn("_rows", rows).select(
        "doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "padded_tokens",
        F.floor(F.col("slot") / F.col("_rows")).cast("long").alias("batch_id"), (F.col("slot") % F.col("_rows")).cast("long").alias("batch_slot"), *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
    )
