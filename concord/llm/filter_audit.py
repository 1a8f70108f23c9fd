"""How filters interact: what each removes, under every order in which they could be applied.

A document fails some of the filters: its *mask*. Under an order of the filters
it is removed at the first one that is in its mask. Orders stand in
lexicographic order, numbered by their Lehmer rank; those that begin with the
same filters are an interval of ranks. So the orders under which a mask is
removed at step k are the intervals of all beginnings of k filters of which the
last is in the mask and no other is. That is a table of fixed size
(:func:`intervals`), made from the number of filters alone.

Documents are counted by part and mask, at most 2 ** n_filters rows a part. A
count is added where an interval begins and taken off where it ends; the sum of
these differences along the ranks is what each order removes at that step. All
that is reported follows: kept, redundant, lost labels, and the sum over all
orders, which is the Shapley value times their number.

The last filter, a text identical to that of a smaller id anywhere in the table,
needs no group of copies in one place: the smallest id of each text is an
aggregate, and the rows that bear it are found by joining on text and id
together, so that copies of one text are spread by their ids.

Defined cases: a null text is empty, a null part the empty string; texts are
told apart by their SHA-256; rows that repeat an id and its text are counted one
by one and are no copies of each other, as no id is smaller; a row without an id
is no copy, and no row is a copy of it; an id with several labels is good or
toxic if one of them says so; ids without labels are neither; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, words_of

#: The filters in the order of their bits.
FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")


def intervals(n_filters: int = len(FILTERS)) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last): under these orders a document of ``mask`` is removed at ``step``.

    A mask's intervals do not overlap and cover all ranks, but for mask 0, which
    has none.
    """
    out = []
    for mask in range(1, 1 << n_filters):
        begun = [(tuple(range(n_filters)), 0)]  # filters still to come in order, first rank of this beginning
        while begun:
            rest, first = begun.pop()
            width = math.factorial(len(rest) - 1)
            for i, f in enumerate(rest):
                start = first + i * width
                if mask >> f & 1:
                    out.append((mask, n_filters - len(rest) + 1, start, start + width))
                else:
                    begun.append((rest[:i] + rest[i + 1 :], start))
    return out


def conditions(text: Column, words: Column) -> list[Column]:
    """What fails filters A to D, from a text that is not null and its words."""
    n_words = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n_words < 200, 100 * F.size(F.array_distinct(words)) < 50 * n_words, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail."""
    body = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(text).alias("text"))
    read = read.withColumns({"_body": body, "_words": words_of(F.col("text"))})
    bits = reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("_body"), F.col("_words")))])
    rows = materialize(read.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2("_body", 256)).alias("digest")), "failures")

    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    told = labels.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    seen = rows.join(first, ["digest", "doc_id"], "left").join(told, "doc_id", "left")
    copy = F.when(F.col("_first").isNull() & F.col("doc_id").isNotNull(), 1 << (len(FILTERS) - 1)).otherwise(0)
    counted = {"n": F.count(F.lit(1)), "good": F.coalesce(F.sum("good"), F.lit(0)), "toxic": F.coalesce(F.sum("toxic"), F.lit(0))}
    return seen.groupBy("part", (F.col("bits") + copy).alias("mask")).agg(*[c.alias(n) for n, c in counted.items()])


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step, from ``counts`` (part, mask, n, good, toxic; bit i of a mask is filter i)."""
    spark, n, n_orders = counts.sparkSession, len(filters), math.factorial(len(filters))
    spans = spark.createDataFrame(intervals(n), "mask int, step int, first int, stop int")  # as many as the number of filters gives
    named = [(rank, step + 1, f, "".join(filters[i] for i in order)) for rank, order in enumerate(itertools.permutations(range(n))) for step, f in enumerate(order)]
    orders = spark.createDataFrame(named, "rank int, step int, filter int, filter_order string")

    zero = [F.lit(0).cast("long").alias(c) for c in COUNTS]
    ends = F.explode(F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign"))))
    changes = counts.join(F.broadcast(spans), "mask").select("part", "step", ends.alias("e"), *COUNTS).select("part", "step", "e.rank", *[(F.col("e.sign") * F.col(c)).alias(c) for c in COUNTS])
    every = counts.select("part").distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(n_orders - 1)))).select("part", "step", "rank", *zero)
    # All that follows is of one part; so its rows are dealt once.
    along = Window.partitionBy("part", "step").orderBy("rank")
    removed = changes.unionAll(every).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in COUNTS]).repartition("part")
    removed = removed.withColumns({c: F.sum(c).over(along) for c in COUNTS}).filter(F.col("rank") < n_orders)

    has = lambda i: F.shiftright("mask", i).bitwiseAND(1) == 1
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    totals = counts.groupBy("part").agg(F.sum("n").alias("_all"), F.array(*[total(has(i)) for i in range(n)]).alias("_fails"), F.array(*[total(F.col("mask") == 1 << i) for i in range(n)]).alias("_alone"))
    out = removed.join(totals, "part").join(F.broadcast(orders), ["rank", "step"])
    so_far = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step"))
    return out.select(
        "part", "filter_order", "step", (F.col("_all") - so_far).alias("kept"), F.col("n").alias("removed"), (F.get("_fails", F.col("filter")) - F.col("n")).alias("redundant"),
        F.get("_alone", F.col("filter")).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(materialize(masks(docs, labels, key, text, part), "masks"))
