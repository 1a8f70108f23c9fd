"""Unified meetings: every field keeps where it came from and what the other source said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ReconcileConfig
from ..functions import text as tx
from ..schemas import FLAGS, PARTICIPANTS, SEVERITIES
from .signals import confidence, evidence

#: Provenance field -> type of its value.
FIELDS = {
    "title": "string", "start_time": "timestamp_ntz", "end_time": "timestamp_ntz", "location": "string", "participants": PARTICIPANTS,
    "client_name": "string", "client_company": "string", "owner_name": "string", "meeting_type": "string", "notes": "string", "status": "string",
}
EVIDENCE = "struct<score:double,confidence:string,signals:array<struct<name:string,weight:double,score:double,detail:string,contribution:double>>>"


def field_type(kind: str) -> str:
    return f"struct<value:{kind},source:string,alternatives:array<struct<source:string,value:{kind}>>,conflict:boolean,conflict_kind:string>"


def _field(kind: str, value: Column | None, source: Column | str | None, other_source: str | Column | None = None, other: Column | None = None, conflict_kind: str | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None)
    alternatives = F.array() if other_source is None else F.array(F.struct(lit(other_source).cast("string").alias("source"), (none if other is None else other).cast(kind).alias("value")))
    return F.struct(
        (none if value is None else value).cast(kind).alias("value"), lit(source).cast("string").alias("source"),
        alternatives.cast(f"array<struct<source:string,value:{kind}>>").alias("alternatives"),
        F.lit(conflict_kind == "contradiction").alias("conflict"), F.lit(conflict_kind).cast("string").alias("conflict_kind"),
    ).cast(field_type(kind))


def single(kind: str, value: Column, source: str) -> Column:
    """A value that only one source has, or an empty field."""
    return F.when(value.isNull(), _field(kind, None, None)).otherwise(_field(kind, value, source))


def prefer(kind: str, winner: Column, winner_source: str, loser: Column, loser_source: str, mark_absence: bool = False) -> Column:
    """The winner's value, with the loser's kept. Where the winner has none, that is an absence always; where the loser has none, only if asked for."""
    alone = _field(kind, winner, winner_source, loser_source, None, "absence") if mark_absence else _field(kind, winner, winner_source)
    return (
        F.when(winner.isNull() & loser.isNull(), _field(kind, None, None))
        .when(winner.isNull(), _field(kind, loser, loser_source, winner_source, None, "absence"))
        .when(loser.isNull(), alone)
        .when(winner == loser, _field(kind, winner, winner_source))
        .otherwise(_field(kind, winner, winner_source, loser_source, loser))
    )


def merge_start(crm: Column, calendar: Column) -> Column:
    kind = FIELDS["start_time"]
    return (
        F.when(crm.isNull() | calendar.isNull(), prefer(kind, calendar, "calendar", crm, "crm", True))
        .when(crm == calendar, _field(kind, calendar, "calendar"))
        .otherwise(_field(kind, calendar, "calendar", "crm", crm, "contradiction"))
    )


def merge_location(crm: Column, calendar: Column) -> Column:
    """Equal, more specific, compatible (a telling word in common; the longer one shows) or contradictory."""
    crm_wins = _field("string", crm, "crm", "calendar", calendar, "granularity")
    calendar_wins = _field("string", calendar, "calendar", "crm", crm, "granularity")
    akin = F.arrays_overlap(tx.place_tokens(crm), tx.place_tokens(calendar))
    return (
        F.when(crm.isNull() | calendar.isNull(), prefer("string", calendar, "calendar", crm, "crm", True))
        .when(F.lower(crm) == F.lower(calendar), _field("string", calendar, "calendar"))
        .when(tx.more_specific(crm, calendar), crm_wins)
        .when(tx.more_specific(calendar, crm), calendar_wins)
        .when(akin, F.when(F.length(calendar) >= F.length(crm), calendar_wins).otherwise(crm_wins))
        .otherwise(_field("string", calendar, "calendar", "crm", crm, "contradiction"))
    )


def merge_status(crm: Column, calendar: Column) -> Column:
    """Cancelled against anything, and tentative against confirmed, contradict; else the more advanced shows."""
    open_question = (crm.isin("tentative", "confirmed")) & (calendar.isin("tentative", "confirmed"))
    contradictory = (crm == "cancelled") | (calendar == "cancelled") | open_question
    crm_first = lambda kind: _field("string", crm, "crm", "calendar", calendar, kind)
    calendar_first = lambda kind: _field("string", calendar, "calendar", "crm", crm, kind)
    return (
        F.when(crm == calendar, _field("string", crm, "crm"))
        .when(contradictory, F.when(crm == "cancelled", crm_first("contradiction")).otherwise(calendar_first("contradiction")))
        .when(tx.lifecycle_rank(crm) >= tx.lifecycle_rank(calendar), crm_first("granularity"))
        .otherwise(calendar_first("granularity"))
    )


def _people(events: str) -> Column:
    people = F.col(f"{events}.participants")
    return F.when(F.size(people) > 0, people)


def _laid_out(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    kinds = {"id": "string", "origin": "string", "event_date": "date", "start": "timestamp_ntz", "crm_ids": "array<string>", "calendar_ids": "array<string>"}
    kinds |= {f: field_type(k) for f, k in FIELDS.items()}
    kinds |= {"match_evidence": EVIDENCE, "flags": FLAGS, "raw_crm": "array<string>", "raw_calendar": "array<string>"}
    return df.select(*[columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def merge_pairs(events: DataFrame, pairs: DataFrame, config: ReconcileConfig = ReconcileConfig()) -> DataFrame:
    """One meeting per pair; ``pairs``: c_id, k_id, score, the signals ``s_*`` and their details ``d_*``."""
    crm = events.filter("source = 'crm'").select(F.col("source_id").alias("c_id"), F.struct(*events.columns).alias("c"))
    calendar = events.filter("source = 'calendar'").select(F.col("source_id").alias("k_id"), F.struct(*events.columns).alias("k"))
    both = pairs.join(crm, "c_id").join(calendar, "k_id")
    c, k = (lambda f: F.col(f"c.{f}")), (lambda f: F.col(f"k.{f}"))
    crm_wins = lambda f, g=None: prefer(FIELDS[f], c(g or f), "crm", k(g or f), "calendar")
    return _laid_out(both, {
        "id": tx.meeting_id(F.concat(c("source_ids"), k("source_ids"))), "origin": F.lit("both"),
        "event_date": F.coalesce(k("event_date"), c("event_date")), "start": F.coalesce(k("start"), c("start")),
        "crm_ids": c("source_ids"), "calendar_ids": k("source_ids"), "title": crm_wins("title"), "start_time": merge_start(c("start"), k("start")),
        "end_time": prefer(FIELDS["end_time"], k("end"), "calendar", c("end"), "crm"), "location": merge_location(c("location"), k("location")),
        "participants": prefer(PARTICIPANTS, _people("k"), "calendar", _people("c"), "crm"), "client_name": crm_wins("client_name"), "client_company": crm_wins("client_company"),
        "owner_name": prefer("string", c("owner_name"), "crm", k("organizer"), "calendar"), "meeting_type": crm_wins("meeting_type"), "notes": crm_wins("notes", "text"),
        "status": merge_status(c("status"), k("status")),
        "match_evidence": F.struct(F.col("score").alias("score"), confidence(F.col("score"), config).alias("confidence"), evidence(config).alias("signals")),
        "flags": F.concat(c("flags"), k("flags")), "raw_crm": c("raw_records"), "raw_calendar": k("raw_records"),
    })


def merge_singles(events: DataFrame, source: str) -> DataFrame:
    """One meeting per event that only ``source`` has."""
    c = F.col
    one = lambda f, value: single(FIELDS[f], value, source)
    crm, none = source == "crm", F.array()
    return _laid_out(events, {
        "id": tx.meeting_id(c("source_ids")), "origin": F.lit(f"{source}_only"), "event_date": c("event_date"), "start": c("start"),
        "crm_ids": c("source_ids") if crm else none, "calendar_ids": none if crm else c("source_ids"), "title": one("title", c("title")),
        "start_time": one("start_time", c("start")), "end_time": one("end_time", c("end")), "location": one("location", c("location")),
        "participants": one("participants", F.when(F.size("participants") > 0, c("participants"))), "client_name": one("client_name", c("client_name")),
        "client_company": one("client_company", c("client_company")), "owner_name": one("owner_name", F.coalesce("owner_name", "organizer")),
        "meeting_type": one("meeting_type", c("meeting_type")), "notes": one("notes", c("text")), "status": one("status", c("status")), "flags": c("flags"),
        "raw_crm": c("raw_records") if crm else none, "raw_calendar": none if crm else c("raw_records"),
    })


def conflicting_fields() -> Column:
    """Names of the fields in conflict, in field order."""
    return F.array_compact(F.array(*[F.when(F.col(f"{f}.conflict"), f) for f in FIELDS]))


def worst_severity(flags: Column) -> Column:
    """The gravest severity among flags, null without any."""
    rank = lambda f: F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), f["severity"])
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), (F.array_max(F.transform(flags, rank)) - 1).cast("int"))


def owner_keys() -> Column:
    """Search keys of the owner and of whom the other source names."""
    values = F.concat(F.array("owner_name.value"), F.transform("owner_name.alternatives", lambda a: a["value"]))
    return F.filter(F.transform(F.array_compact(values), tx.identity_key), lambda k: k != "")


def with_derived(meetings: DataFrame) -> DataFrame:
    """Meetings with the columns that lists and filters read."""
    made = meetings.withColumns({"conflict_fields": conflicting_fields(), "worst_severity": worst_severity(F.col("flags")), "owner_keys": owner_keys()})
    return made.withColumn("has_conflicts", F.size("conflict_fields") > 0)
