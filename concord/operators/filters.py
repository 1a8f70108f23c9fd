"""Predicates of the meeting list, and lenient reading of their text form."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identity_key

ORIGINS = ("both", "crm_only", "calendar_only")


def has_origin(origin: str) -> Column:
    return F.col("origin") == origin


def conflicts(wanted: bool) -> Column:
    return F.col("has_conflicts") == wanted


def between(first: dt.date | None = None, last: dt.date | None = None) -> Column:
    """Inclusive; a meeting without a date is out as soon as there is a bound."""
    out = F.lit(True)
    if first is not None:
        out = out & (F.col("event_date") >= F.lit(first))
    if last is not None:
        out = out & (F.col("event_date") <= F.lit(last))
    return F.coalesce(out, F.lit(False))


def owned_by(query: str) -> Column:
    """The query's key is part of the key of the owner, by name or address, in either source; an empty key finds nothing."""
    needle = identity_key(F.lit(query))
    return (needle != "") & F.exists("owner_keys", lambda k: F.contains(k, needle))


def apply_filters(
    meetings: DataFrame, origin: str | None = None, has_conflicts: bool | None = None,
    date_from: dt.date | None = None, date_to: dt.date | None = None, owner: str | None = None,
) -> DataFrame:
    """Meetings (with derived columns) that meet every filter that is set."""
    if origin is not None:
        meetings = meetings.filter(has_origin(origin))
    if has_conflicts is not None:
        meetings = meetings.filter(conflicts(has_conflicts))
    if date_from is not None or date_to is not None:
        meetings = meetings.filter(between(date_from, date_to))
    return meetings if owner is None else meetings.filter(owned_by(owner))


def filters_from_text(query: Mapping[str, str]) -> dict:
    """Keyword arguments for :func:`apply_filters`; a value that cannot be read counts as not set."""
    out: dict = {}
    if (origin := query.get("origin", "").strip().lower()) in ORIGINS:
        out["origin"] = origin
    if (wanted := query.get("has_conflicts", "").strip().lower()) in ("true", "false", "1", "0", "yes", "no"):
        out["has_conflicts"] = wanted in ("true", "1", "yes")
    for name in ("date_from", "date_to"):
        try:
            out[name] = dt.date.fromisoformat(query.get(name, "").strip())
        except ValueError:
            continue
    if owner := query.get("owner", "").strip():
        out["owner"] = owner
    return out


def list_items(meetings: DataFrame) -> DataFrame:
    """Without the raw records."""
    return meetings.drop("raw_crm", "raw_calendar")


def one_meeting(meetings: DataFrame, meeting_id: str) -> DataFrame:
    return meetings.filter(F.col("id") == meeting_id)


def chronological() -> list[Column]:
    """Sort keys: date (none last), time of day (none first), id."""
    return [F.col("event_date").asc_nulls_last(), F.col("start").asc_nulls_first(), F.col("id").asc()]
