"""Both feeds in one shape. No row is dropped: every defect becomes a flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ReconcileConfig
from ..functions import parse
from ..functions.text import PLACEHOLDER_CLIENTS
from ..schemas import EVENT, FLAGS, PARTICIPANT, PARTICIPANTS


def _shaped(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in EVENT.items()])


def _person(email: Column, display: Column, organizer: Column, raw: Column) -> Column:
    return F.struct(email.alias("email"), display.alias("display"), parse.email_domain(email).alias("domain"), organizer.alias("is_organizer"), raw.alias("raw")).cast(PARTICIPANT)


def normalize_crm(crm: DataFrame, config: ReconcileConfig = ReconcileConfig(), ordinal: str = "crm_id") -> DataFrame:
    """CRM rows as events. ``ordinal`` names the column that stands for input order."""
    c = F.col
    status, status_code = parse.parse_status(c("status"))
    texts = {"_title": "subject", "_text": "notes", "_place": "location", "_owner": "relationship_owner", "_client": "client_name", "_company": "client_company", "_kind": "meeting_type"}
    read = parse.with_time(parse.with_date(parse.with_timestamp(crm, "created_at", "_created", config.timezone), "meeting_date", "_day"), "meeting_time", "_seconds")
    # In steps of columns, so that no expression is computed more than once.
    read = read.withColumns({"_status": status, "_status_code": status_code} | {k: parse.clean(c(v)) for k, v in texts.items()})
    gap = F.when(c("_client").isNull() & (c("_kind") == "Internal"), "INTERNAL_NO_CLIENT").when(F.lower("_client").isin(*PLACEHOLDER_CLIENTS), "PLACEHOLDER_CLIENT")
    read = read.withColumns({"_start": parse.combine(c("_day"), c("_seconds")), "_gap_code": gap})
    read = read.withColumn("_zone_code", F.when(c("_start").isNotNull(), "TIMEZONE_ASSUMED"))
    flags = F.array_compact(F.array(
        parse.flag(c("_day_code"), "meeting_date", c("meeting_date"), "MALFORMED_DATE", "UNPARSABLE_DATE"), parse.flag(c("_seconds_code"), "meeting_time", c("meeting_time"), "TIME_MISSING"),
        parse.flag(c("_zone_code"), "meeting_time", c("meeting_time"), "TIMEZONE_ASSUMED"), parse.flag(c("_status_code"), "status", c("status"), "UNKNOWN_STATUS"),
        parse.flag(c("_gap_code"), "client_name", F.when(c("_client").isNotNull(), c("client_name")), "INTERNAL_NO_CLIENT", "PLACEHOLDER_CLIENT"),
    ))
    none = F.lit(None).cast("string")
    people = F.array_compact(F.array(
        F.when(c("_owner").isNotNull(), _person(none, c("_owner"), F.lit(True), c("_owner"))),
        F.when(c("_client").isNotNull(), _person(none, c("_client"), F.lit(False), c("_client"))),
    ))
    return _shaped(read, {
        "source": F.lit("crm"), "source_id": F.coalesce(F.nullif(c("crm_id"), F.lit("")), F.lit("CRM-UNKNOWN")), "ordinal": c(ordinal).cast("string"),
        "title": c("_title"), "text": c("_text"), "location": c("_place"), "organizer": c("_owner"), "owner_name": c("_owner"),
        "client_name": c("_client"), "client_company": c("_company"), "meeting_type": c("_kind"), "status": c("_status"), "status_raw": parse.clean(c("status")),
        "is_recurring": F.lit(False), "event_date": c("_day"), "start": c("_start"), "created": c("_created"), "participants": people, "flags": flags, "raw": c("raw"),
    })


def _people() -> Column:
    """Attendees of ``_read``, each address or label once, and ``_organizer`` last if not among them (``_keys``)."""
    low = F.lower("_organizer")
    once = F.filter("_read", lambda a, i: F.array_position("_keys", a["key"]) == i + 1)
    people = F.transform(once, lambda a: _person(a["email"], F.coalesce(a["email"], a["raw"]), F.coalesce(a["email"] == low, F.lit(False)), a["raw"]))
    last = F.when(low.isNotNull() & ~F.array_contains("_keys", low), F.array(_person(low, low, F.lit(True), F.col("_organizer")))).otherwise(F.array().cast(PARTICIPANTS))
    return F.concat(people, last)


def normalize_calendar(calendar: DataFrame, config: ReconcileConfig = ReconcileConfig(), ordinal: str = "event_id") -> DataFrame:
    """Calendar rows as events."""
    c = F.col
    status, status_code = parse.parse_status(c("status"))
    read = calendar
    for raw, name in (("start_time", "_start"), ("end_time", "_end"), ("created_at", "_created")):
        read = parse.with_timestamp(read, raw, name, config.timezone)
    read = read.withColumns({"_status": status, "_status_code": status_code, "_organizer": parse.clean(c("organizer")), "_read": parse.read_emails(F.transform(F.coalesce(c("attendees"), F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("None"))))})
    assumed = lambda name: F.coalesce(c(name) == "TIMEZONE_ASSUMED", F.lit(False))
    shape = lambda name: F.when(c(name) != "TIMEZONE_ASSUMED", c(name))
    read = read.withColumns({
        "_keys": F.transform("_read", lambda a: a["key"]), "_zone_code": F.when(assumed("_start_code") | assumed("_end_code"), "TIMEZONE_ASSUMED"),
        "_start_shape": shape("_start_code"), "_end_shape": shape("_end_code"),
    })
    fixed = F.array_compact(F.array(
        parse.flag(c("_start_shape"), "start_time", c("start_time"), "MALFORMED_DATETIME"), parse.flag(c("_end_shape"), "end_time", c("end_time"), "MALFORMED_DATETIME"),
        parse.flag(c("_zone_code"), "start_time", c("start_time"), "TIMEZONE_ASSUMED"), parse.flag(c("_status_code"), "status", c("status"), "UNKNOWN_STATUS"),
    ))
    mail = F.array_compact(F.transform("_read", lambda a: parse.flag(a["code"], "attendees", a["raw"], "NON_EMAIL_ATTENDEE", "MALFORMED_EMAIL")))
    return _shaped(read, {
        "source": F.lit("calendar"), "source_id": F.coalesce(F.nullif(c("event_id"), F.lit("")), F.lit("CAL-UNKNOWN")), "ordinal": c(ordinal).cast("string"),
        "title": parse.clean(c("title")), "text": parse.clean(c("description")), "location": parse.clean(c("location")), "organizer": c("_organizer"),
        "status": c("_status"), "status_raw": parse.clean(c("status")), "is_recurring": F.coalesce(c("is_recurring"), F.lit(False)), "event_date": c("_start").cast("date"),
        "start": c("_start"), "end": c("_end"), "created": c("_created"), "participants": _people(), "flags": F.concat(fixed, mail).cast(FLAGS), "raw": c("raw"),
    })


def normalize_feeds(crm: DataFrame, calendar: DataFrame, config: ReconcileConfig = ReconcileConfig()) -> DataFrame:
    """Both feeds in one relation."""
    return normalize_crm(crm, config).unionByName(normalize_calendar(calendar, config))
