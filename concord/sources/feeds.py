"""Reading the two feeds: JSON arrays, JSON Lines or Parquet, with each record's own JSON kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CALENDAR_SCHEMA, CRM_SCHEMA
from . import json_arrays


def read_json_array(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """One row per object of a JSON array file: ``raw``, the object's own text.

    A file that is missing, is not JSON or holds no array raises. A file is one
    row here, unless one of them is larger than ``split_bytes``: then all are read
    in splits (:mod:`.json_arrays`).
    """
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length").alias("n")).first()["n"]  # the listing alone
    if (largest or 0) > split_bytes:
        return json_arrays.read_split(spark, path)
    whole = spark.read.text(path, wholetext=True)
    first = F.substring(F.regexp_replace("value", r"^\s+", ""), 1, 1)
    items = F.from_json("value", "array<string>")
    checked = F.when((first == "[") & items.isNotNull(), items).otherwise(F.raise_error(F.lit("not a JSON array of objects")).cast("array<string>"))
    rows = whole.select(F.explode(checked).alias("raw"))
    return rows.select(F.when(F.col("raw").rlike(r"^\s*\{"), F.col("raw")).otherwise(F.raise_error(F.lit("an element is no object")).cast("string")).alias("raw"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: ``raw``."""
    return spark.read.text(path).select(F.col("value").alias("raw")).filter("trim(raw) <> ''")


def write_json_arrays(feed: DataFrame, path: str, rows: int = 10_000) -> None:
    """The ``raw`` records of a feed as JSON arrays, a file for about ``rows`` of them."""
    cells = max(1, -(-feed.count() // rows))
    arrays = feed.groupBy(F.pmod(F.xxhash64("raw"), F.lit(cells)).alias("_cell")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("raw"), ",\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


def parsed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns and ``raw``, which also keeps unknown keys."""
    return raw.select(F.from_json("raw", schema).alias("_r"), "raw").select("_r.*", "raw")


def with_raw(table: DataFrame, schema: T.StructType) -> DataFrame:
    """A typed table with a ``raw`` column made from its own fields."""
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    if "raw" in table.columns:
        return table.select(*fields, "raw")
    return table.select(*fields, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("raw"))


def _read(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    if kind == "parquet":
        return with_raw(spark.read.parquet(path), schema)
    raw = {"array": read_json_array, "split": json_arrays.read_split, "lines": read_json_lines}[kind]
    return parsed(raw(spark, path), schema)


def read_crm(spark: SparkSession, path: str, kind: str = "lines") -> DataFrame:
    """The CRM feed; ``kind`` is *lines*, *array*, *split* (arrays read in splits, whatever their size) or *parquet*."""
    return _read(spark, path, kind, CRM_SCHEMA)


def read_calendar(spark: SparkSession, path: str, kind: str = "lines") -> DataFrame:
    """The calendar feed; ``kind`` as for :func:`read_crm`."""
    return _read(spark, path, kind, CALENDAR_SCHEMA)
