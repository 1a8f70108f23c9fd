"""How well a CRM record and a calendar record agree, as column expressions.

Everything that depends on one record alone is computed before the join by
:func:`crm_features` and :func:`calendar_features`; the pair functions read the
prefixed columns ``c_*`` and ``k_*``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ReconcileConfig
from ..functions import text as tx

PARTICIPANT_SHARES = {"owner": 0.4, "client": 0.4, "company": 0.2}


def _micros(at: str) -> Column:
    """A start as a number, taken once for a row: for each pair it would cost more than all the rest."""
    return F.unix_micros(F.col(at).cast("timestamp"))


def crm_features(events: DataFrame) -> DataFrame:
    """Narrow rows for pairing: c_id, c_date and what the signals read."""
    placeholder = F.exists("flags", lambda f: f["code"] == "PLACEHOLDER_CLIENT")
    words, (first, initials) = tx.tokens(F.col("title")), tx.company_parts(F.col("client_company"))
    kind = F.nullif("meeting_type", F.lit(""))
    return events.select(
        F.col("source_id").alias("c_id"), F.col("event_date").alias("c_date"), F.col("start").alias("c_start"), _micros("start").alias("c_at"),
        tx.name_key(F.col("owner_name")).alias("c_owner"), tx.name_key(F.col("client_name")).alias("c_client"),
        ((F.coalesce(F.col("client_name"), F.lit("")) != "") & ~placeholder).alias("c_usable_client"),
        (F.coalesce(F.col("client_company"), F.lit("")) != "").alias("c_has_company"), first.alias("c_first"), initials.alias("c_initials"),
        tx.content_tokens(F.col("title"), F.col("text"), F.col("client_company")).alias("c_content"), words.alias("c_words"), tx.acronyms(words).alias("c_acronyms"),
        F.lower("location").alias("c_place"), tx.long_tokens(F.col("location")).alias("c_place_words"), kind.alias("c_type"), (F.lower(kind) == "virtual").alias("c_virtual"),
    ).withColumn("c_cells", tx.company_cells(F.col("c_first"), F.col("c_initials")))


def calendar_features(events: DataFrame) -> DataFrame:
    """Narrow rows for pairing: k_id, k_date and what the signals read."""
    emails = F.array_compact(F.transform("participants", lambda p: F.nullif(p["email"], F.lit(""))))
    domains = F.array_compact(F.transform("participants", lambda p: F.nullif(p["domain"], F.lit(""))))
    words = tx.tokens(F.col("title"))
    made = events.select(
        F.col("source_id").alias("k_id"), F.col("event_date").alias("k_date"), F.col("start").alias("k_start"), _micros("start").alias("k_at"),
        tx.email_key(F.col("organizer")).alias("k_organizer"), (F.coalesce(F.col("organizer"), F.lit("")) != "").alias("k_has_organizer"),
        F.array_distinct(F.transform(emails, tx.email_key)).alias("k_attendees"), F.array_distinct(F.transform(domains, tx.domain_root)).alias("k_roots"),
        tx.content_tokens(F.col("title"), F.col("text")).alias("k_content"), words.alias("k_words"), tx.acronyms(words).alias("k_acronyms"),
        F.lower("location").alias("k_place"), tx.long_tokens(F.col("location")).alias("k_place_words"), tx.looks_virtual(F.col("location")).alias("k_virtual"),
    )
    parties = F.array_distinct(F.filter(F.concat(F.array("k_organizer"), "k_attendees"), lambda p: p != ""))
    return made.withColumns({"k_parties": parties, "k_cells": tx.root_cells(F.col("k_roots"))})


def owner_presence() -> Column:
    """1 if the owner organised it, 0.7 if they attended, 0 if absent, null if unknown."""
    owner = F.col("c_owner")
    known = F.col("k_has_organizer") | (F.size("k_attendees") > 0)
    return (
        F.when(owner == "", F.lit(None).cast("double")).when(owner == F.col("k_organizer"), 1.0)
        .when(F.array_contains("k_attendees", owner), 0.7).when(known, 0.0)
    )


def client_presence() -> Column:
    """1 or 0 for a usable client, null without one."""
    hit = (F.col("c_client") != "") & F.array_contains("k_attendees", F.col("c_client"))
    return F.when(F.col("c_usable_client"), F.when(hit, 1.0).otherwise(0.0))


def company_presence() -> Column:
    """1 or 0 for a company, null without one."""
    hit = F.exists("k_roots", lambda r: tx.root_is_of(r, F.col("c_first"), F.col("c_initials")))
    return F.when(F.col("c_has_company"), F.when(hit, 1.0).otherwise(0.0))


def participant_overlap(company: Column | None = None) -> Column:
    """Owner, client and company by share, over those that can be compared; 0 if none can. ``company`` is its presence, if at hand."""
    parts = {"owner": owner_presence(), "client": client_presence(), "company": company_presence() if company is None else company}
    share, value = F.lit(0.0), F.lit(0.0)
    for name, part in parts.items():
        share = share + F.when(part.isNotNull(), PARTICIPANT_SHARES[name]).otherwise(0.0)
        value = value + F.coalesce(F.lit(PARTICIPANT_SHARES[name]) * part, F.lit(0.0))
    return F.when(share == 0, 0.0).otherwise(F.try_divide(value, share))


def gap_hours() -> Column:
    """Hours between the starts on the wall clock."""
    return F.abs(F.col("c_at") - F.col("k_at")) / F.lit(3_600_000_000.0)


def time_proximity(config: ReconcileConfig) -> Column:
    """1 at one start, falling evenly to 0 at the window's end; one half if a start is unknown."""
    gap = gap_hours()
    near = F.when(gap >= config.time_window_hours, 0.0).otherwise(F.lit(1.0) - gap / F.lit(config.time_window_hours))
    return F.when(F.col("c_at").isNull() | F.col("k_at").isNull(), 0.5).otherwise(near)


def with_shared(pairs: DataFrame) -> DataFrame:
    """Add ``_shared``, the number of words that both titles have, which several signals read."""
    return pairs.withColumn("_shared", F.size(F.array_intersect("c_content", "k_content")))


def title_similarity() -> Column:
    """Shared words over the smaller set, or 0.6 for an acronym of the other title."""
    left, right, shared = F.col("c_content"), F.col("k_content"), F.col("_shared")
    acronym = F.arrays_overlap("c_acronyms", "k_words") | F.arrays_overlap("k_acronyms", "c_words")
    return (
        F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).when(shared > 0, shared / F.least(F.size(left), F.size(right)))
        .when(F.coalesce(acronym, F.lit(False)), 0.6).otherwise(0.0)
    )


def location_agreement() -> Column:
    a, b = F.col("c_place"), F.col("k_place")
    return (
        F.when(a.isNull() | b.isNull(), 0.5).when(F.contains(a, b) | F.contains(b, a), 1.0)
        .when(F.arrays_overlap("c_place_words", "k_place_words"), 0.6).otherwise(0.0)
    )


def modality_agreement() -> Column:
    return F.when(F.col("c_type").isNull() | F.col("k_place").isNull(), 0.5).when(F.col("c_virtual") == F.col("k_virtual"), 1.0).otherwise(0.0)


def structural_agreement() -> Column:
    return F.lit(0.6) * location_agreement() + F.lit(0.4) * modality_agreement()


def shared_cell() -> Column:
    """The first cell that a company and the domains have in common."""
    return F.get(F.array_intersect("c_cells", "k_cells"), F.lit(0))


def parts() -> dict[str, tuple[tuple[str, ...], tuple[str, ...], dict[str, Column]]]:
    """Part of a score -> what it reads of the CRM's and of the calendar's row, and what it gives; neither ids nor times, so rows of the same words share it."""
    return {
        "company": (("c_has_company", "c_first", "c_initials", "c_cells"), ("k_roots", "k_cells"), {"_company": company_presence(), "_first_cell": shared_cell()}),
        "title": (("c_content", "c_words", "c_acronyms"), ("k_content", "k_words", "k_acronyms"), {"_title": title_similarity()}),
        "structure": (("c_place", "c_place_words", "c_type", "c_virtual"), ("k_place", "k_place_words", "k_virtual"), {"_structure": structural_agreement()}),
    }


def signals(config: ReconcileConfig, looked: Iterable[str] = ()) -> dict[str, Column]:
    """Signal name -> score, in the order of the weights; the parts in ``looked`` stand in the row by their names."""
    made = {
        "participants": participant_overlap(F.col("_company") if "company" in looked else None), "time": time_proximity(config),
        "title": F.col("_title") if "title" in looked else title_similarity(), "structure": F.col("_structure") if "structure" in looked else structural_agreement(),
    }
    return {name: made[name] for name in config.weights}


def total(config: ReconcileConfig) -> Column:
    """Weighted scores, added from left to right, over the columns ``s_<signal>``."""
    out = None
    for name, weight in config.weights.items():
        part = F.lit(weight) * F.col(f"s_{name}")
        out = part if out is None else out + part
    return out


def confidence(score: Column, config: ReconcileConfig) -> Column:
    return F.when(score >= config.high_confidence, "high").otherwise("low")


def participant_detail() -> Column:
    owner, client, company = owner_presence(), client_presence(), company_presence()
    said = F.concat_ws(
        ", ", F.when(owner == 1.0, "owner organised it").when(owner == 0.7, "owner attended").when(owner == 0.0, "owner absent"),
        F.when(client == 1.0, "client found").when(client == 0.0, "client absent"), F.when(company == 1.0, "company = domain").when(company == 0.0, "company ≠ domain"),
    )
    return F.when(said == "", "no comparable party information").otherwise(said)


def tenths(x: Column) -> Column:
    """A number of 0 or more with one decimal, rounded as its exact binary value asks, half to even.

    Ten times a double is a double and an error, which follows from the number's
    halves. Only where the double lies half way does the error decide, and the
    even neighbour only where there is none.
    """
    high = F.lit(134217729.0) * x - (F.lit(134217729.0) * x - x)
    ten = x * 10.0
    error = (high * 10.0 - ten) + (x - high) * 10.0
    below = F.floor(ten)
    rounded = F.when(ten - below != 0.5, F.rint(ten)).when(error > 0, below + 1).when(error < 0, below).otherwise(F.rint(ten)).cast("long")
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def time_detail(config: ReconcileConfig) -> Column:
    gap = gap_hours()
    return (
        F.when(F.col("c_at").isNull() | F.col("k_at").isNull(), "one side has no time of day").when(gap >= config.time_window_hours, F.concat(tenths(gap), F.lit("h apart")))
        .when(gap == 0, "same start time").otherwise(F.concat(F.rint(gap * 60).cast("long").cast("string"), F.lit(" min apart")))
    )


def title_detail() -> Column:
    shared = F.array_intersect("c_content", "k_content")
    return (
        F.when((F.size("c_content") == 0) | (F.size("k_content") == 0), "no comparable text").when(F.col("_shared") > 0, F.concat(F.lit("shared: "), F.array_join(F.array_sort(shared), ", ")))
        .when(title_similarity() == 0.6, "acronym match").otherwise("no shared terms")
    )


def structure_detail() -> Column:
    a, b = F.col("c_place"), F.col("k_place")
    place = (
        F.when(a.isNull() | b.isNull(), "location unknown on one side").when(a == b, "same location").when(F.contains(a, b) | F.contains(b, a), "one location contains the other")
        .when(F.arrays_overlap("c_place_words", "k_place_words"), F.concat(F.lit("locations share "), F.array_join(F.array_sort(F.array_intersect("c_place_words", "k_place_words")), ", ")))
        .otherwise("locations differ")
    )
    kind = (
        F.when(F.col("c_type").isNull() | b.isNull(), "modality unknown").when(F.col("c_virtual") == F.col("k_virtual"), "modality agrees")
        .otherwise(F.concat(F.col("c_type"), F.lit(" vs "), F.when(F.col("k_virtual"), "virtual").otherwise("physical"), F.lit(" location")))
    )
    return F.concat(place, F.lit("; "), kind)


def details(config: ReconcileConfig) -> dict[str, Column]:
    """Signal name -> what the score rests on, in words. The wording."""
    made = {"participants": participant_detail(), "time": time_detail(config), "title": title_detail(), "structure": structure_detail()}
    return {name: made[name] for name in config.weights}


def evidence(config: ReconcileConfig) -> Column:
    """The signals of a pair with their weights, scores, details and contributions, from ``s_<signal>`` and ``d_<signal>``."""
    return F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.col(f"s_{n}").alias("score"), F.col(f"d_{n}").alias("detail"), (F.lit(w) * F.col(f"s_{n}")).alias("contribution"))
        for n, w in config.weights.items()
    ])
