"""Duplicate collapse inside a source.

Only rows of one source, date and convener can be duplicates; recurring rows
and rows without a date or convener pass by. Inside such a group the order
matters: a record joins the first survivor that it matches *as the survivor
stands by then*, so this is no transitive closure. But a survivor's parties all
come from its own records, so rows that no chain of shared parties connects
never meet: groups are split into these components first, with Spark joins. A
survivor's start is always that of one of its records, so rows on two sides of a
gap between starts that is wider than the window never meet either: components
in which all rows have a start are split into islands at such gaps. A small
helper then goes through each island's narrow rows in order, holding its
survivors only.

Few rows have a duplicate. Those that have none pass by as they are; only the
others are shuffled, whole, to be folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ReconcileConfig
from ..functions import parse
from ..schemas import FLAGS
from .components import components
from .stored import store

#: Rows of ids or islands up to which a table is broadcast; above, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def _outside(config: ReconcileConfig) -> Column:
    """Who takes part from outside, by address or label: neither the organizer nor of the own domain."""
    met = F.filter("participants", lambda p: ~p["is_organizer"] & ~F.coalesce(F.lower(p["domain"]) == config.internal_domain.lower(), F.lit(False)))
    return F.transform(met, lambda p: _who(p))


def _who(person: Column) -> Column:
    return F.lower(parse.trimmed(F.coalesce(F.nullif(person["email"], F.lit("")), person["display"])))


def client_keys(config: ReconcileConfig) -> Column:
    """Parties that are neither the organizer nor of the own domain, and the client's name."""
    return F.array_distinct(F.concat(_outside(config), F.array_compact(F.array(F.lower("client_name")))))


def _small(df: DataFrame) -> DataFrame:
    """``df``, a stored table, to be broadcast if it is as small as that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _first_fit(minutes: int):
    """Rows in order of component, group and input to (source, row, survivor, place): which survivor a row joins, as its how-manieth."""
    width = minutes * 60_000_000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, alive, by_key = None, [], {}
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if at != (group := (r.component, r.island, r.source, r.event_date, r.convener)):
                    at, alive, by_key = group, [], {}
                keys, people = set(r.keys), set(r.people)
                start, created = (None if pd.isna(x) else int(x) for x in (r.start, r.created))
                client = {r.client} if r.client else set()
                for i in sorted({i for k in keys for i in by_key.get(k, ())}):
                    s = alive[i]
                    near = s["start"] is None or start is None or abs(s["start"] - start) <= width
                    if near and keys & (s["people"] | s["client"]):
                        if created is not None and s["created"] is not None and created < s["created"]:
                            s |= {"start": start, "created": created, "client": client}
                        s["people"] |= people
                        s["n"] += 1
                        out.append((r.source, r.row, s["row"], s["n"]))
                        break
                else:
                    i = len(alive)
                    alive.append({"row": r.row, "start": start, "created": created, "people": people, "client": client, "n": 0})
                    out.append((r.source, r.row, r.row, 0))
                for k in people | client:
                    by_key.setdefault(k, set()).add(i)
            yield pd.DataFrame(out, columns=["source", "source_id", "survivor", "place"])

    return run


def _grouped(events: DataFrame) -> DataFrame:
    convener = F.lower(parse.trimmed(F.col("organizer")))
    return events.withColumn("_convener", F.when(~F.col("is_recurring") & F.col("event_date").isNotNull(), F.nullif(convener, F.lit(""))))


def survivors(events: DataFrame, config: ReconcileConfig = ReconcileConfig()) -> DataFrame:
    """(source, source_id, survivor, place) for the rows that share a party with another of their group."""
    own = ["source", "event_date", "_convener"]
    grouped = _grouped(events).filter("_convener IS NOT NULL").select(
        *own, "source_id", "ordinal", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), F.unix_micros(F.col("created").cast("timestamp")).alias("created"),
        client_keys(config).alias("keys"), _outside(config).alias("people"), F.lower("client_name").alias("client"), F.xxhash64("source", "source_id").alias("node"),
    )
    grouped = store(grouped, "convened")
    # Nodes are rows, and parties of a group; a hash that two of them share only puts components together.
    told = grouped.select("node", F.explode("keys").alias("_key"), *own).select("node", F.xxhash64(F.lit("party"), *own, "_key").alias("party"))
    met = told.groupBy("party").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("party")
    found = components(told.join(met, "party"), "node", "party")
    placed = store(grouped.join(found, "node").select("component", *own[:2], F.col("_convener").alias("convener"), F.col("source_id").alias("row"), "ordinal", "start", "created", "keys", "people", "client"), "placed")
    order = ["component", "island", "source", "event_date", "convener", "ordinal", "row"]
    dealt = with_islands(placed, config.dedupe_minutes).repartition("component", "island").sortWithinPartitions(*order)
    return dealt.mapInPandas(_first_fit(config.dedupe_minutes), "source string, source_id string, survivor string, place long")


def with_islands(placed: DataFrame, minutes: int) -> DataFrame:
    """Add ``island``: rows of a component whose starts are linked by steps of at most ``minutes``; 0 for all if a start is missing.

    Starts are counted in slots as wide as the window, so no gap lies inside
    one; a component is of one date and has few slots, whatever its rows. So its
    slots are looked at, and not its rows.
    """
    width = minutes * 60_000_000
    slot = F.floor(F.col("start") / F.lit(max(width, 1)))
    slots = placed.groupBy("component", slot.alias("_slot")).agg(F.min("start").alias("_first"), F.max("start").alias("_last"))
    whole = Window.partitionBy("component")
    ahead = F.lag("_last").over(whole.orderBy("_slot"))
    parts = slots.withColumns({"_new": (F.col("_first") - ahead > width).cast("int"), "_open": F.max(F.col("_slot").isNull().cast("int")).over(whole)}).filter("_open = 0")
    parts = parts.withColumn("_island", F.sum(F.coalesce("_new", F.lit(0))).over(whole.orderBy("_slot")).cast("int"))
    # Most components are one island.
    several = store(parts.withColumn("_n", F.max("_island").over(whole)).filter("_n > 0").select("component", "_slot", "_island"), "islands")
    return placed.withColumn("_slot", slot).join(_small(several), ["component", "_slot"], "left").withColumn("island", F.coalesce("_island", F.lit(0))).drop("_slot", "_island")


#: Fields that come from the record created first.
DESCRIPTIVE = (
    "start", "end", "event_date", "title", "text", "location", "organizer", "owner_name", "client_name", "client_company",
    "meeting_type", "status", "status_raw", "is_recurring", "created", "raw",
)


def _new_ones(all_of: str, keys: str, n_first: str) -> Column:
    """The items of ``all_of`` that the first record has, all of them, and of the later ones those whose key is new."""
    return F.filter(all_of, lambda x, i: (i < F.col(n_first)) | (F.array_position(keys, F.get(keys, i)) == i + 1))


def _folded(rows: DataFrame) -> DataFrame:
    """One row for each survivor from the rows (with ``survivor`` and ``place``) of all its records."""
    record = F.struct("place", *dict.fromkeys(("source_id", "participants", "flags", "ordinal", *DESCRIPTIVE)))
    held = rows.groupBy("source", "survivor").agg(F.sort_array(F.collect_list(record)).alias("_all"))
    # The record that leads is the one created first; a null on either side never swaps, so a null first record leads for good.
    # What a record that joins is set down with is the raw of whichever of the two does not lead.
    start = F.struct(F.lit(0).alias("lead"), F.get("_all.created", F.lit(0)).alias("created"), F.get("_all.raw", F.lit(0)).alias("raw"), F.array().cast("array<string>").alias("others"))
    step = lambda s, r: F.when(
        F.coalesce(r["created"] < s["created"], F.lit(False)),
        F.struct(r["place"].cast("int").alias("lead"), r["created"].alias("created"), r["raw"].alias("raw"), F.array_append(s["others"], s["raw"]).alias("others")),
    ).otherwise(F.struct(s["lead"].alias("lead"), s["created"].alias("created"), s["raw"].alias("raw"), F.array_append(s["others"], r["raw"]).alias("others")))
    held = held.withColumn("_fold", F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), start, step))
    ids = F.array_distinct(F.col("_all.source_id"))
    led = held.withColumns({"_lead": F.get("_all", F.col("_fold.lead")), "source_ids": ids, "_everyone": F.flatten(F.col("_all.participants")), "_n_people": F.size(F.get("_all.participants", F.lit(0)))})
    collapsed = parse.flag(F.lit("DUPLICATE_COLLAPSED"), "event_id", F.array_join(F.slice("source_ids", 1, 2), ", "), "DUPLICATE_COLLAPSED")
    # The collapse is noted when the second record joins; flags of a third come after it.
    early, late = F.flatten(F.transform(F.slice("_all", 1, 2), lambda r: r["flags"])), F.flatten(F.transform(F.slice("_all", F.lit(3), F.size("_all")), lambda r: r["flags"]))
    led = led.withColumns({"_flags": F.concat(early, F.array(collapsed).cast(FLAGS), late), "_n_flags": F.size(F.get("_all.flags", F.lit(0)))})
    led = led.withColumns({"_names": F.transform("_everyone", _who), "_what": F.transform("_flags", lambda f: F.struct(f["code"], f["field"], f["raw_value"]))})
    return led.select(
        "source", *[F.col(f"_lead.{c}").alias(c) for c in DESCRIPTIVE], F.array_min(F.col("_all.ordinal")).alias("ordinal"), "source_ids",
        _new_ones("_everyone", "_names", "_n_people").alias("participants"), _new_ones("_flags", "_what", "_n_flags").alias("flags"),
        F.concat(F.array("_fold.raw"), "_fold.others").alias("raw_records"), F.get("source_ids", F.lit(0)).alias("source_id"),
    )


def collapse(events: DataFrame, config: ReconcileConfig = ReconcileConfig()) -> DataFrame:
    """One event per meeting and source, with ``source_ids`` and the ``raw_records`` of all its records, survivor's first.

    Only the folded ones are stored: the others are ``events`` (a stored table)
    as they are, so a second copy of them is not written where it is cheap to
    tell them apart.
    """
    decided = store(survivors(events, config), "survivors")
    joined = decided.filter("place > 0").select("source", "survivor").distinct()
    members = store(decided.join(joined, ["source", "survivor"]), "members")
    own = ["source", "source_id"]
    several = _small(members)
    folded = store(_folded(events.join(several, own)), "folded")
    alone = events.join(several.select(*own), own, "left_anti").withColumns({"source_ids": F.array("source_id"), "raw_records": F.array("raw")})
    whole = folded.unionByName(alone.select(*folded.columns))
    return whole if members.count() <= BROADCAST_ROWS else store(whole, "collapsed")


def collapsed_count(collapsed: DataFrame) -> DataFrame:
    """How many records were folded into others."""
    return collapsed.agg(F.coalesce(F.sum(F.size("source_ids") - 1), F.lit(0)).cast("long").alias("duplicates_collapsed"))
