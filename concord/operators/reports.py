"""Summaries of a run: counts, quality flags, conflicts, gaps and vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import FLAG_CODES, SEVERITIES
from .merge import FIELDS

FLAG_LINKS = 6

#: Provenance field -> (keys in CRM records, keys in calendar records).
SOURCE_KEYS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "title": (("subject",), ("title",)), "start_time": (("meeting_date", "meeting_time"), ("start_time",)), "end_time": ((), ("end_time",)),
    "location": (("location",), ("location",)), "participants": (("client_name",), ("attendees", "organizer")),
    "client_name": (("client_name",), ()), "client_company": (("client_company",), ()), "owner_name": (("relationship_owner",), ("organizer",)),
    "meeting_type": (("meeting_type",), ()), "notes": (("notes",), ("description",)), "status": (("status",), ("status",)),
}


def severity_rank(severity: Column) -> Column:
    """0 for info, 1 for warning, 2 for error."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def flag_rows(events: DataFrame, *keys: str) -> DataFrame:
    """One row per flag with the keys of its row."""
    return events.select(*keys, F.explode("flags").alias("_f")).select(*keys, "_f.*")


def records_in(*feeds: DataFrame) -> DataFrame:
    """Rows by source of raw or normalized feeds that have a ``source`` column."""
    return reduce(DataFrame.unionByName, [f.select("source") for f in feeds]).groupBy("source").agg(F.count(F.lit(1)).alias("records"))


def outcome_counts(meetings: DataFrame) -> DataFrame:
    """Meetings by origin, pairs, and pairs of low confidence, in one pass."""
    of = lambda o: F.count_if(F.col("origin") == o)
    return meetings.agg(
        F.count(F.lit(1)).alias("meetings_out"), of("both").alias("matched_pairs"), of("crm_only").alias("crm_only"), of("calendar_only").alias("calendar_only"),
        F.count_if(F.col("match_evidence.confidence") == "low").alias("low_confidence"),
    )


def field_rows(meetings: DataFrame, *keys: str) -> DataFrame:
    """One row per meeting and provenance field: field, kind, conflict."""
    stacked = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.conflict_kind").alias("kind"), F.col(f"{f}.conflict").alias("conflict")) for f in FIELDS])
    return meetings.select(*keys, F.explode(stacked).alias("_f")).select(*keys, "_f.*")


def conflicts_by_kind(meetings: DataFrame) -> DataFrame:
    return field_rows(meetings).filter("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def conflicts_by_field(meetings: DataFrame) -> DataFrame:
    """Contradictions only."""
    return field_rows(meetings).filter("conflict").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def flags_by_code(events: DataFrame) -> DataFrame:
    return flag_rows(events).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def flags_by_severity(events: DataFrame) -> DataFrame:
    return flag_rows(events).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def flag_dimension(df: DataFrame) -> DataFrame:
    """code, severity, message: one row per known code."""
    rows = [(c, s, m) for c, (s, m) in FLAG_CODES.items()]
    return df.sparkSession.createDataFrame(rows, "code string, severity string, message string")


def flag_report(meetings: DataFrame, links: int = FLAG_LINKS) -> DataFrame:
    """Per code: flags, meetings, the first meeting ids in list order and how many more there are.

    The first ids are found in two steps, so that a code on most meetings is
    cut down inside hashed cells before one task sees it.
    """
    rows = flag_rows(meetings, "id", "event_date", "start")
    counts = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n_flags"))
    once = rows.select("code", "id", "event_date", "start").distinct().withColumn("_cell", F.pmod(F.xxhash64("id"), F.lit(256)))
    order = [F.col("event_date").asc_nulls_last(), F.col("start").asc_nulls_first(), F.col("id").asc()]
    cells = once.withColumn("_r", F.row_number().over(Window.partitionBy("code", "_cell").orderBy(*order)))
    first = cells.filter(F.col("_r") <= links).withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy(*order))).filter(F.col("_r") <= links)
    listed = first.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("_r", "id")))["id"].alias("first_ids"))
    distinct = once.groupBy("code").agg(F.count(F.lit(1)).alias("n_meetings"))
    joined = counts.join(distinct, "code").join(listed, "code").join(F.broadcast(flag_dimension(meetings)), "code")  # as many rows as codes
    return joined.withColumn("more", F.greatest(F.col("n_meetings") - links, F.lit(0))).orderBy(severity_rank(F.col("severity")).desc(), F.desc("n_flags"), "code")


def conflict_report(meetings: DataFrame, links: int = FLAG_LINKS) -> DataFrame:
    """Per field in conflict: meetings, and the first ids in list order."""
    order = [F.col("event_date").asc_nulls_last(), F.col("start").asc_nulls_first(), F.col("id").asc()]
    rows = field_rows(meetings, "id", "event_date", "start").filter("conflict")
    cells = rows.withColumn("_cell", F.pmod(F.xxhash64("id"), F.lit(256))).withColumn("_r", F.row_number().over(Window.partitionBy("field", "_cell").orderBy(*order)))
    first = cells.filter(F.col("_r") <= links).withColumn("_r", F.row_number().over(Window.partitionBy("field").orderBy(*order))).filter(F.col("_r") <= links)
    listed = first.groupBy("field").agg(F.sort_array(F.collect_list(F.struct("_r", "id")))["id"].alias("first_ids"))
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n_meetings")).join(listed, "field").orderBy("field")


def conflict_meetings(meetings: DataFrame) -> DataFrame:
    """field, id of every contradiction: the whole report, as rows."""
    return field_rows(meetings, "id").filter("conflict").select("field", "id")


def conflict_keys(meetings: DataFrame) -> DataFrame:
    """id, source, key: the raw keys behind each field in conflict."""
    rows = [(f, source, key) for f, keys in SOURCE_KEYS.items() for source, own in zip(("crm", "calendar"), keys, strict=True) for key in own]
    keys = meetings.sparkSession.createDataFrame(rows, "field string, source string, key string")
    return conflict_meetings(meetings).join(F.broadcast(keys), "field").select("id", "source", "key").distinct()  # as many rows as keys


def gap_census(source: str, feed: DataFrame) -> DataFrame:
    """Per field of a raw feed: rows, and rows where it is null, empty or an empty list."""
    gap = lambda f, kind: F.col(f).isNull() | ((F.size(f) == 0) if kind.startswith("array") else (F.col(f).cast("string") == ""))
    stacked = F.array(*[F.struct(F.lit(f).alias("field"), gap(f, k).alias("gap")) for f, k in feed.dtypes if f != "raw"])
    rows = feed.select(F.explode(stacked).alias("_g")).select("_g.*")
    return rows.groupBy("field").agg(F.count_if("gap").alias("n_gaps"), F.count(F.lit(1)).alias("n_rows")).withColumn("source", F.lit(source))


def vocabulary(events: DataFrame) -> DataFrame:
    """Distinct raw statuses by source."""
    return events.select("source", "status_raw").distinct()
