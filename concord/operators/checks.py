"""Integrity checks: each gives the rows that break a rule, so an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import FIELDS


def origin_broken() -> Column:
    """Origin and ids disagree."""
    crm, calendar = F.size("crm_ids") > 0, F.size("calendar_ids") > 0
    expected = F.when(crm & calendar, "both").when(crm, "crm_only").when(calendar, "calendar_only")
    return ~F.col("origin").eqNullSafe(expected)


def score_broken(tolerance: float = 1e-6) -> Column:
    """A score that is not the sum of its contributions, or a number outside 0 to 1."""
    signals, score = F.col("match_evidence.signals"), F.col("match_evidence.score")
    total = F.aggregate(signals, F.lit(0.0), lambda s, x: s + x["contribution"])
    outside = F.exists(signals, lambda x: ~x["score"].between(0, 1) | ~x["weight"].between(0, 1))
    broken = (F.abs(score - total) > tolerance) | outside | ~score.between(0, 1)
    return F.col("match_evidence").isNotNull() & F.coalesce(broken, F.lit(True))  # a number that is missing is none in range


def broken_fields() -> Column:
    """Fields in conflict that are no contradiction, or the other way round."""
    return F.array_compact(F.array(*[F.when(F.col(f"{f}.conflict") != F.coalesce(F.col(f"{f}.conflict_kind") == "contradiction", F.lit(False)), f) for f in FIELDS]))


def date_broken() -> Column:
    """A start on another date than the row's."""
    return F.col("start").isNotNull() & ~F.to_date("start").eqNullSafe(F.col("event_date"))


def by_row() -> dict[str, Column]:
    """Check -> whether a meeting breaks it, for the checks that look at one meeting alone."""
    return {"origin": origin_broken(), "score": score_broken(), "conflict": F.size(broken_fields()) > 0, "date": date_broken()}


def wrong_origin(meetings: DataFrame) -> DataFrame:
    return meetings.filter(origin_broken()).select("id", "origin")


def wrong_score(meetings: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    return meetings.filter(score_broken(tolerance)).select("id", F.col("match_evidence.score").alias("score"))


def wrong_conflict(meetings: DataFrame) -> DataFrame:
    return meetings.withColumn("_fields", broken_fields()).filter(F.size("_fields") > 0).select("id", F.col("_fields").alias("fields"))


def wrong_date(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.filter(date_broken()).select(key, "event_date", "start")


def repeated_ids(meetings: DataFrame, key: str = "id") -> DataFrame:
    return meetings.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def lost_or_repeated(events: DataFrame, meetings: DataFrame) -> DataFrame:
    """Source ids of ``events`` (source, source_id) that are not in exactly one meeting, and ids from nowhere."""
    named = lambda c, s: meetings.select(F.lit(s).alias("source"), F.explode(c).alias("source_id"))
    out = named("crm_ids", "crm").unionAll(named("calendar_ids", "calendar")).groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("n_out"))
    whole = events.groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("n_in"))
    joined = whole.join(out, ["source", "source_id"], "full").fillna(0, ["n_in", "n_out"])
    return joined.filter((F.col("n_in") != 1) | (F.col("n_out") != 1))


def all_checks(events: DataFrame, meetings: DataFrame) -> dict[str, DataFrame]:
    return {
        "origin": wrong_origin(meetings), "score": wrong_score(meetings), "conflict": wrong_conflict(meetings), "date": wrong_date(meetings),
        "event_date": wrong_date(events, "source_id"), "ids": repeated_ids(meetings), "conservation": lost_or_repeated(events, meetings),
    }


def counted(found: dict[str, DataFrame]) -> DataFrame:
    """(check, n_violations) of the rows that each check gave."""
    return reduce(DataFrame.unionAll, [df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n_violations")) for name, df in found.items()])


def violations(events: DataFrame, meetings: DataFrame) -> DataFrame:
    """(check, n_violations) for every check."""
    return counted(all_checks(events, meetings))
