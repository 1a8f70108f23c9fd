"""Small helpers shared by the operators: tables, stored intermediates, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.stored import store

#: What the contracts call a word: a run of characters other than these six.
ASCII_SPACE = " \t\n\v\f\r"
WORDS_SPLIT = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the folder that ``spark.checkpoint.dir`` names and read it back: a table that outlives a lost executor."""
    return store(df, tag)


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array for null or blank text."""
    trimmed = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(
        F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, WORDS_SPLIT)
    ).otherwise(F.array().cast(T.ArrayType(T.StringType())))


def row_key(*columns: Column | str) -> Column:
    """A 64-bit name of a row by what it holds, so that repeated ids do not mix."""
    return F.xxhash64(*columns)


def free_name(df: DataFrame, name: str = "_row") -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def spread(key: Column, n: Column | int) -> Column:
    """A cell number in [0, n) that depends on ``key`` only."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(F.xxhash64(key, F.lit(11)), n)


def join_one_of_each(left: DataFrame, right: DataFrame, key: str | list[str], parts: int = 1000) -> DataFrame:
    """``left`` joined (inner) with ``right``, which has one row for each ``key`` and in ``n`` how many rows of ``left`` bear it at most.

    Keys on more than one of ``parts`` of the rows are fewer than ``parts``: those
    are broadcast, so that no task gets all rows of one of them. ``left`` should
    be a stored table, as it is read twice; ``right`` is stored here.
    """
    right = materialize(right, "one-of-each")
    total = right.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.broadcast(right.filter(F.col("n") * parts > total).drop("n"))  # fewer than ``parts`` rows
    rare = left.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(right.filter(F.col("n") * parts <= total).drop("n"), key)
    return left.join(hot, key).unionByName(rare)


def running_sums(cells: DataFrame, groups: list[str], at: str, value: str, name: str, width: int = 1024) -> DataFrame:
    """``cells`` (one row for each group and number ``at``) with ``name``: the sum of ``value`` over the group's cells of lower number.

    Taken in two levels, over ``width`` cells and over the sums of these, so that
    the cells of a group are no task of their own.
    """
    cells = cells.withColumn("_block", F.floor(F.col(at) / width))
    blocks = cells.groupBy(*groups, "_block").agg(F.sum(value).alias("_all"))
    over = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_ahead", F.coalesce(F.sum("_all").over(over(groups, "_block")), F.lit(0)))
    inside = cells.withColumn("_within", F.coalesce(F.sum(value).over(over([*groups, "_block"], at)), F.lit(0)))
    on = [F.col(f"i.{g}").eqNullSafe(F.col(f"b.{g}")) for g in (*groups, "_block")]
    kept = [c for c in cells.columns if c != "_block"]
    return inside.alias("i").join(blocks.alias("b"), on).select(*[f"i.{c}" for c in kept], (F.col("i._within") + F.col("b._ahead")).alias(name))


def gapless_slots(df: DataFrame, groups: list[str], order: list[str], cell_rows: int = 512, name: str = "slot") -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each group, without a task per group.

    Rows are spread over hashed cells of about ``cell_rows`` rows; each cell is
    numbered by itself, and a running sum over the cells' counts (one row per
    group and cell, summed in two levels) gives each cell its offset. So a group
    that holds a third of all rows is numbered by many tasks. The slot depends
    on the rows only, not on the partitioning; rows equal in ``order`` are
    interchangeable. ``df`` should be a stored table, as it is read twice.
    """
    cells = max(1, -(-df.count() // cell_rows))
    df = df.withColumn("_cell", spread(F.struct(*order), cells))
    keys = [*groups, "_cell"]
    offsets = running_sums(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), groups, "_cell", "_n", "_offset").drop("_n")
    inner = Window.partitionBy(*keys).orderBy(*order)
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    numbered = df.withColumn("_inner", F.row_number().over(inner) - 1)
    return (
        numbered.alias("l").join(offsets.alias("r"), on)
        .select("l.*", (F.col("r._offset") + F.col("l._inner")).cast("long").alias(name))
        .drop("_cell", "_inner")
    )
