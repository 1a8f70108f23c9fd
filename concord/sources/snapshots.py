"""Publishing whole snapshots: readers see the old one or the new one, never a mix, and none that breaks a rule.

A run is written below a folder of its own: meetings by month, the summary, the
tables by which meetings are found, and the result of its audit. The manifest,
a small table of runs, is written last.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import identity_key
from ..operators import checks
from ..operators.filters import between, chronological
from ..operators.stored import remove, store

MANIFEST = "run string, at string, columns string"
#: Keys of owners up to which they are handed to the index as constants; above, it is joined.
OWNERS_AT_ONCE = 1_000


class SnapshotRejected(ValueError):
    """A run that breaks a rule; ``found`` is how many violations each check gave."""

    def __init__(self, found: dict[str, int]) -> None:
        super().__init__("not published: " + ", ".join(f"{n} of {c}" for c, n in found.items() if n))
        self.found = found


def publish(meetings: DataFrame, summary: DataFrame, root: str, run_id: str | None = None, events: DataFrame | None = None) -> str:
    """Write a run below ``root``, audit what has been written, and make it the current one as the last step.

    Rules that a meeting breaks by itself are counted in the pass that writes
    (:class:`Observation`); those on ids look at the ids of the written files
    alone. With ``events``, the run's normalized records, each of them must be in
    exactly one meeting. A run that breaks any rule raises
    :class:`SnapshotRejected`, its files are removed, and readers keep the
    snapshot they had, as they do if the run fails before the end.
    """
    spark = meetings.sparkSession
    run = run_id or uuid.uuid4().hex
    home = f"{root}/run_id={run}"
    seen = Observation()
    dated = meetings.withColumn("month", F.date_format("event_date", "yyyy-MM"))
    # By month first, so that the writer keeps the order inside a file. Observed behind the exchange, which looks at its rows twice.
    ordered = dated.repartitionByRange("month", "event_date", "id").sortWithinPartitions("month", *chronological())
    ordered = ordered.observe(seen, *[F.count_if(broken).alias(name) for name, broken in checks.by_row().items()])
    ordered.write.option("parquet.bloom.filter.enabled#id", "true").partitionBy("month").parquet(f"{home}/meetings")
    found = dict(seen.get)

    written = spark.read.schema(ordered.schema).parquet(f"{home}/meetings")
    found["ids"] = checks.repeated_ids(written.select("id")).count()
    if events is not None:
        found["event_date"] = checks.wrong_date(events.select("source_id", "event_date", "start"), "source_id").count()
        found["conservation"] = checks.lost_or_repeated(events.select("source", "source_id"), written.select("crm_ids", "calendar_ids")).count()
    if any(found.values()):
        remove(spark, home)
        raise SnapshotRejected(found)
    spark.createDataFrame(list(found.items()), "check string, n_violations long").coalesce(1).write.parquet(f"{home}/audit")
    summary.write.parquet(f"{home}/summary")
    written.select("id", "month").repartitionByRange("id").sortWithinPartitions("id").write.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{home}/ids")
    owners = store(written.select(F.explode("owner_keys").alias("owner"), "id", "month").distinct(), "owners")
    owners.repartitionByRange("owner", "id").sortWithinPartitions("owner", "id").write.parquet(f"{home}/owner-index")
    owners.select("owner").distinct().write.parquet(f"{home}/owners")
    at = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    spark.createDataFrame([(run, at, ordered.schema.json())], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return run


def _latest(spark: SparkSession, root: str) -> Row:
    latest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy(F.desc("at"), F.desc("run")).first()
    if latest is None:
        raise LookupError(f"nothing has been published below {root}")
    return latest


def current_run(spark: SparkSession, root: str) -> str:
    return _latest(spark, root)["run"]


def _current(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/run_id={current_run(spark, root)}/{table}")


def _meetings(spark: SparkSession, root: str, run: Row | None = None) -> DataFrame:
    """The meetings of a run by the schema they were written with, so that months are text."""
    run = run or _latest(spark, root)
    return spark.read.schema(T.StructType.fromJson(json.loads(run["columns"]))).parquet(f"{root}/run_id={run['run']}/meetings")


def read_meetings(spark: SparkSession, root: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """The current meetings, in order; with ``first`` or ``last`` (inclusive) those of the period, without reading other months."""
    found = _meetings(spark, root)
    if first is not None:
        found = found.filter(F.col("month") >= first.strftime("%Y-%m"))
    if last is not None:
        found = found.filter(F.col("month") <= last.strftime("%Y-%m"))
    if first is not None or last is not None:
        found = found.filter(between(first, last))
    return found.orderBy(*chronological())


def _of_month(month: str | None) -> Column:
    return F.col("month").isNull() if month is None else F.col("month") == month


def read_meeting(spark: SparkSession, root: str, meeting_id: str) -> DataFrame:
    """The meeting of an id: its month is looked up in the sorted table of ids, and that month alone is read."""
    run = _latest(spark, root)
    known = spark.read.parquet(f"{root}/run_id={run['run']}/ids").filter(F.col("id") == meeting_id).select("month").first()
    found = _meetings(spark, root, run)
    return found.limit(0) if known is None else found.filter(_of_month(known["month"])).filter(F.col("id") == meeting_id)


def read_owner(spark: SparkSession, root: str, text: str) -> DataFrame:
    """The current meetings whose owner the text names, in order.

    The text is looked for in the dictionary of distinct owners; the index, which
    is sorted by owner, gives the meetings of its hits and their months, and the
    meetings are met by month and id. A text without a key finds nothing.
    """
    run = _latest(spark, root)
    read = lambda table: spark.read.parquet(f"{root}/run_id={run['run']}/{table}")
    hits = read("owners").filter(_named(text))
    keys = [r["owner"] for r in hits.limit(OWNERS_AT_ONCE + 1).collect()]
    index = read("owner-index")
    index = index.filter(F.col("owner").isin(keys)) if len(keys) <= OWNERS_AT_ONCE else index.join(hits, "owner", "left_semi")
    index = index.select(F.col("id").alias("_id"), F.col("month").alias("_month")).distinct()
    meetings = _meetings(spark, root, run)
    return meetings.join(index, (F.col("id") == F.col("_id")) & F.col("month").eqNullSafe(F.col("_month")), "left_semi").orderBy(*chronological())


def _named(text: str) -> Column:
    key = identity_key(F.lit(text))
    return (key != "") & F.contains("owner", key)


def read_summary(spark: SparkSession, root: str) -> DataFrame:
    return _current(spark, root, "summary")


def read_audit(spark: SparkSession, root: str) -> DataFrame:
    """check, n_violations of the current snapshot: all zero."""
    return _current(spark, root, "audit")
