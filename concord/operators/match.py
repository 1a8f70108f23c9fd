"""Blocking, scoring and one-to-one assignment."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ReconcileConfig
from . import signals
from .components import components
from .stored import discard, store

#: Heavy keys of a pairing up to which their table is broadcast.
HEAVY_KEYS = 500_000
#: Candidates that a task takes at once in the greedy order, as a component of their graph or as all that is left; bounds its memory.
AT_ONCE = 500_000
#: Combinations of both sides' words up to which a part of the score is taken for each and looked up by the pairs.
COMBINED = 500_000
#: What a pair can have in common besides the client: the owner, the firm, both or neither.
SHARED = ("", "o", "f", "of")
#: Part of a score -> table of what it gives, by the hash of what it reads of both sides.
Looked = dict[str, DataFrame]


def _met(own: DataFrame, near: DataFrame, keys: list[str], config: ReconcileConfig) -> DataFrame:
    """``own`` joined with ``near`` on ``keys``, heavy keys dealt over tasks.

    Both sides are counted by key first, without what they carry. A key that
    would make more than ``pairs_per_task`` pairs is dealt over as many tasks as
    that takes: the rows of its larger side over so many parts, each of which
    meets all rows of the other side. Heavy keys are few, each having many rows;
    their table is broadcast up to ``HEAVY_KEYS``, and joined beyond.
    """
    n = {side: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(side)) for side, df in (("_own", own), ("_near", near))}
    made = n["_own"].join(n["_near"], keys).withColumn("_parts", F.ceil(F.col("_own") * F.col("_near") / F.lit(config.pairs_per_task)).cast("int"))
    parts = F.least("_parts", F.greatest("_own", "_near").cast("int"))
    heavy = store(made.filter("_parts > 1").select(*keys, parts.alias("_parts"), (F.col("_own") >= F.col("_near")).alias("_deal_own")), "heavy-keys")
    count = heavy.count()
    if not count:
        discard(heavy)
        return own.join(near, keys).drop(*keys)
    few = F.broadcast(heavy) if count <= HEAVY_KEYS else heavy
    every, one = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1), lambda id_: F.array(F.coalesce(F.pmod(F.xxhash64(id_), F.col("_parts")).cast("int"), F.lit(0)))
    side = lambda df, id_, dealt: df.join(few, keys, "left").withColumn("_salt", F.explode(F.when(F.coalesce(dealt, F.lit(True)), one(id_)).otherwise(every))).drop("_parts", "_deal_own")
    salted = side(own, "c_id", F.col("_deal_own")).join(side(near, "k_id", ~F.col("_deal_own")), [*keys, "_salt"])
    return salted.drop(*keys, "_salt")


def _on_days(calendar: DataFrame, days: int) -> DataFrame:
    """Calendar rows on every date that they may meet."""
    return calendar.filter("k_date IS NOT NULL").withColumn("_day", F.explode(F.sequence(F.date_sub("k_date", days), F.date_add("k_date", days))))


def blocked(crm: DataFrame, calendar: DataFrame, config: ReconcileConfig = ReconcileConfig()) -> DataFrame:
    """Feature rows (c_*, k_*) of all pairs whose dates are at most ``block_days`` apart.

    The range join becomes an equi-join: calendar rows stand on every date that
    they may meet, CRM rows on their own, so each pair is made once.
    """
    own = crm.filter("c_date IS NOT NULL").withColumn("_day", F.col("c_date"))
    return _met(own, _on_days(calendar, config.block_days), ["_day"], config)


def coded(crm: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame, Looked]:
    """Both sides without the words that a part of a score reads, and that part's table by hashes of the words.

    Many rows have the same words, so a part is taken once for each combination
    of them and looked up by the pairs. A part with more than ``COMBINED``
    combinations, or with hashes that two of them share, is left to the pairs.
    """
    looked: Looked = {}
    dropped: set[str] = set()
    for name, (of_c, of_k, made) in signals.parts().items():
        words = [store(df.select(*of).distinct(), f"{name}-words") for df, of in ((crm, of_c), (calendar, of_k))]
        if math.prod(df.count() for df in words) <= COMBINED:
            combined = words[0].crossJoin(F.broadcast(words[1]))
            given = (signals.with_shared(combined) if name == "title" else combined).select(*[c.alias(n) for n, c in made.items()], F.xxhash64(F.xxhash64(*of_c), F.xxhash64(*of_k)).alias(f"_{name}_key"))
            table = store(given, f"{name}-parts")
            if table.count() == table.select(f"_{name}_key").distinct().count():
                looked[name] = table
                crm, calendar = crm.withColumn(f"c_{name}", F.xxhash64(*of_c)), calendar.withColumn(f"k_{name}", F.xxhash64(*of_k))
                dropped |= {*of_c, *of_k} - {"c_cells", "k_cells", "c_has_company"}  # these are read for pairing as well
        discard(*words)
    return crm.drop(*dropped), calendar.drop(*dropped), looked


def _looked_up(pairs: DataFrame, looked: Looked, *names: str) -> DataFrame:
    """``pairs`` with what the parts ``names`` give, where they have tables."""
    for name in names:
        if name in looked and f"c_{name}" in pairs.columns:
            pairs = pairs.withColumn(f"_{name}_key", F.xxhash64(f"c_{name}", f"k_{name}")).join(F.broadcast(looked[name]), f"_{name}_key").drop(f"_{name}_key", f"c_{name}", f"k_{name}")
    return pairs


def _needs(config: ReconcileConfig, rest: float, known: Iterable[str], shared: str) -> float:
    """The least time signal with which a pair can reach the floor if of the ``known`` parties it has ``shared`` in common (o, f: owner, firm)."""
    w, shares, told = config.weights, signals.PARTICIPANT_SHARES, {"owner": "o", "company": "f"}
    whole, part = sum(shares[p] for p in known), sum(shares[p] for p in known if told.get(p, "-") in shared)
    return (config.candidate_floor - rest - 1e-9 - w["participants"] * (part / whole if whole else 0.0)) / w["time"]


def pruned(crm: DataFrame, calendar: DataFrame, config: ReconcileConfig = ReconcileConfig(), looked: Looked | None = None) -> DataFrame:
    """As :func:`blocked`, without most of the pairs that cannot reach the floor: they are not made at all.

    What a pair has in common of the owner, the client and the company bounds
    its parties' signal, and so says how near in time it must be with the other
    signals at their best: any time of the days that are blocked together, at
    most so many hours apart, or never. So pairs are made by

    * day and client;
    * owner, company, both or neither, by day if that is enough at any time, and
      by time slots as wide as they may be apart if it is not.

    A row without a start counts as half the time signal. A pair is made by what
    it has in common alone, or by less of it that is enough for the whole day,
    so each pair is made once, in the join that also brings what it is scored
    by: pairs are neither made distinct nor joined back to their rows.
    """
    w, looked = config.weights, looked or {}
    rest = sum(v for name, v in w.items() if name not in ("participants", "time"))
    if rest >= config.candidate_floor or w.get("time", 0) <= 0 or w.get("participants", 0) <= 0:
        return _looked_up(blocked(crm, calendar, config), looked, "company")  # nothing follows from a lack of parties
    near_days = F.abs(F.date_diff("c_date", "k_date")) <= config.block_days
    has = {"owner": F.col("c_owner") != "", "client": F.col("c_usable_client"), "company": F.col("c_has_company")}
    need = {s: F.lit(2.0) for s in SHARED}
    reach = 0.0
    for n in range(len(has) + 1):
        for known in itertools.combinations(has, n):
            this = reduce(Column.__and__, [has[p] if p in known else ~has[p] for p in has])
            for s in SHARED:
                if ("o" not in s or "owner" in known) and ("f" not in s or "company" in known):
                    least = _needs(config, rest, known, s)
                    need[s] = F.when(this, least).otherwise(need[s])
                    reach = max(reach, (1 - least) * config.time_window_hours if least > 0 else 0.0)
    crm = crm.filter("c_date IS NOT NULL").withColumns({f"_need_{s}": c for s, c in need.items()})
    calendar = calendar.filter("k_date IS NOT NULL")
    whole, need = {s: F.col(f"_whole_{s}") for s in SHARED}, {s: F.col(f"_need_{s}") for s in SHARED}
    usable, told_apart = F.col("c_usable_client") & (F.col("c_client") != ""), ~whole["o"] & ~whole["f"]
    on_days = {s: c & ~whole[""] for s, c in whole.items()} | {"": whole[""], "of": whole["of"] & told_apart & ~whole[""], "c": usable & ~whole[""]}
    in_slots = {s: ~whole[s] & (need[s] <= 1) & ~whole[""] & (told_apart if s == "of" else F.lit(True)) for s in SHARED}

    def enough(rows: DataFrame, time: Column) -> DataFrame:
        """Add what is enough for a whole day, if that leaves ``time`` of the time signal."""
        return rows.withColumns({f"_whole_{s}": need[s] <= time for s in SHARED})

    def keyed(rows: DataFrame, tag: str, parties: Column, clients: Column, cells: Column) -> DataFrame:
        """A row for each key by which ``rows`` are met as ``tag`` says."""
        if "f" in tag:
            rows = rows.withColumn("_cell", F.explode(cells))
        rows = rows.withColumn("_name", F.explode(clients if tag == "c" else parties)) if tag in ("c", "o", "of") else rows
        name = {"": [], "c": ["_name"], "o": ["_name"], "f": ["_cell"], "of": ["_name", "_cell"]}[tag]
        return rows.withColumn("_key", F.concat_ws("/", F.lit(tag), *name)).drop("_name", "_cell", *(["c_cells", "k_cells"] if "company" in looked else []), "k_parties")

    def met(own: DataFrame, wanted: dict[str, Column], near: DataFrame, at: str, own_at: Column, near_at: Column, close: Column) -> list[DataFrame]:
        """Pairs of CRM rows with the calendar rows that have a key and ``at`` in common with them."""
        there = own.agg(*[F.max(c).alias(s) for s, c in wanted.items()]).first().asDict()
        tags = [s for s in wanted if there[s]]
        if not tags:
            return []
        one = lambda c: F.array(F.col(c))
        rows = [keyed(own.filter(wanted[s]).withColumns({"_tag": F.lit(s), "_need": need.get(s, F.lit(0.0))}), s, one("c_owner"), one("c_client"), F.col("c_cells")) for s in tags]
        rows = reduce(DataFrame.unionByName, rows).drop(*[f"_need_{s}" for s in SHARED]).withColumn("_by", F.col("_key"))
        # Owners and firms are few, and most of a calendar row's parties are neither: only keys that a CRM row has are spread.
        names = store(rows.filter("_tag <> 'c'").select("_key").distinct(), "names")
        few = names.count() <= HEAVY_KEYS
        spread = {s: keyed(near, s, F.col("k_parties"), F.col("k_attendees"), F.col("k_cells")) for s in tags}
        spread = [df.join(F.broadcast(names), "_key", "left_semi") if few and s not in ("", "c") else df for s, df in spread.items()]
        rows, spread = rows.withColumn(at, F.explode(own_at)), reduce(DataFrame.unionByName, spread).withColumn(at, near_at)
        tag = F.col("_tag")
        client = usable & F.array_contains("k_attendees", F.col("c_client"))
        owner = (F.col("c_owner") != "") & (F.coalesce(F.col("c_owner") == F.col("k_organizer"), F.lit(False)) | F.array_contains("k_attendees", F.col("c_owner")))
        apart = F.when(tag == "c", client).otherwise(~client & (tag.isin("o", "of") | ~owner | ((tag == "f") & whole["f"] & ~whole["o"])))
        pairs = _met(rows, spread, [at, "_key"], config).filter(near_days & close & (whole[""] | apart))
        pairs = _looked_up(pairs, looked, "company")
        hit, cell = (F.col("_company"), F.col("_first_cell")) if "company" in looked else (signals.company_presence(), signals.shared_cell())
        firm = F.coalesce(hit == 1.0, F.lit(False))
        named = firm & (F.col("_by") == F.concat_ws("/", tag, F.when(tag == "of", F.col("c_owner")), cell))
        kept = F.when(whole[""] | (tag == "c"), True).when(tag.isin("f", "of"), named).when(tag == "o", whole["o"] | ~firm).otherwise(~firm)
        return [pairs.filter(kept).drop("_tag", "_need", "_by", "_first_cell", "c_cells", "k_cells", *[f"_whole_{s}" for s in SHARED])]

    timed, untimed = calendar.filter("k_start IS NOT NULL"), calendar.filter("k_start IS NULL")
    days = F.sequence(F.date_sub("c_date", config.block_days), F.date_add("c_date", config.block_days))
    out = met(enough(crm, F.when(F.col("c_start").isNull(), 0.5).otherwise(0.0)), on_days, timed, "_day", days, F.col("k_date"), F.lit(True))
    if reach > 0:
        slot = lambda c: F.floor(F.col(c) / F.lit((math.ceil(reach * 3600) + 1) * 1_000_000))
        close = signals.gap_hours() <= (1 - F.col("_need")) * config.time_window_hours + 1e-6
        out += met(enough(crm.filter("c_start IS NOT NULL"), F.lit(0.0)), in_slots, timed, "_slot", F.array(*[slot("c_at") + d for d in (-1, 0, 1)]), slot("k_at"), close)
    if not untimed.isEmpty():
        out += met(enough(crm, F.lit(0.5)), on_days, untimed, "_day", days, F.col("k_date"), F.lit(True))
    none = _looked_up(crm.drop(*[f"_need_{s}" for s in SHARED]).limit(0).crossJoin(calendar.drop("k_parties").limit(0)), looked, "company").drop("_first_cell", "c_cells", "k_cells")
    return reduce(DataFrame.unionByName, out) if out else none


def scored(pairs: DataFrame, config: ReconcileConfig = ReconcileConfig(), floor: float | None = None, looked: Looked | None = None) -> DataFrame:
    """c_id, k_id, the signals ``s_*``, ``score`` and ``confidence`` of every pair, or of those that reach ``floor``.

    Signals are taken one by one, the cheap ones first; with a floor, a pair goes
    as soon as it could not reach it with all the others at their best, unless
    the title, which costs most, is looked up.
    """
    looked = looked or {}
    made, done = signals.signals(config, looked), []
    out = _looked_up(pairs, looked, *looked)
    for name in sorted(made, key=lambda n: (n not in looked, n == "title")):
        out = (signals.with_shared(out) if name == "title" and name not in looked else out).withColumn(f"s_{name}", made[name])
        done.append(name)
        if floor is not None and "title" not in looked and len(done) < len(made):
            best = sum((F.lit(config.weights[n]) * F.col(f"s_{n}") for n in done), F.lit(sum(w for n, w in config.weights.items() if n not in done) + 1e-9))
            out = out.filter(best >= floor)
    out = out.select("c_id", "k_id", *[f"s_{n}" for n in made]).withColumn("score", signals.total(config)).withColumn("confidence", signals.confidence(F.col("score"), config))
    return out if floor is None else out.filter(F.col("score") >= floor)


def features(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What pairing reads of the CRM's and of the calendar's events, each made once and stored."""
    crm = store(signals.crm_features(events.filter("source = 'crm'")), "crm-features")
    return crm, store(signals.calendar_features(events.filter("source = 'calendar'")), "calendar-features")


def candidates(events: DataFrame, config: ReconcileConfig = ReconcileConfig(), prune: bool = False, read: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Scored pairs of (collapsed or plain) events at or above the floor; ``read`` are their features, if at hand."""
    crm, calendar, looked = coded(*(read or features(events)))
    return _found(crm, calendar, looked, config, prune)


def _found(crm: DataFrame, calendar: DataFrame, looked: Looked, config: ReconcileConfig, prune: bool) -> DataFrame:
    pairs = pruned(crm, calendar, config, looked) if prune else blocked(crm, calendar, config)
    return scored(pairs, config, config.candidate_floor, looked)


def _floors(config: ReconcileConfig) -> list[float]:
    """Scores down to the floor, above the first of which a shared client is needed if one is known, and above the second any party."""
    w, shares = config.weights, signals.PARTICIPANT_SHARES
    rest = sum(v for name, v in w.items() if name != "participants")
    above = [rest + w.get("participants", 0) * (shares["owner"] + shares["company"]) + 1e-6, rest + 1e-6]
    return [*(f for f in above if f > config.candidate_floor), config.candidate_floor]


def matched(read: tuple[DataFrame, DataFrame], config: ReconcileConfig = ReconcileConfig(), prune: bool = False) -> DataFrame:
    """What :func:`assign` gives of all candidates, with their signals.

    The greedy order begins with the best scores, so with ``prune`` the pairs
    above a high score are made and assigned first, and then those above a lower
    one among the rows that are left. Nearly all rows have a partner by the time
    that pairs without a party in common are made, whose number grows with the
    square of a day's rows; so they are neither made nor stored for the others.
    """
    crm, calendar, looked = coded(*read)
    out: DataFrame | None = None
    for floor in _floors(config) if prune else [config.candidate_floor]:
        found = store(_found(crm, calendar, looked, replace(config, candidate_floor=floor), prune), "scored")
        got = store(assign(found).join(found, ["c_id", "k_id", "score"]), "matched")
        out = got if out is None else out.unionByName(got)
        if floor > config.candidate_floor:
            left = [store(df.join(got.select(id_), id_, "left_anti"), "unmatched") for df, id_ in ((crm, "c_id"), (calendar, "k_id"))]
            discard(found, crm, calendar)
            crm, calendar = left
    discard(found, crm, calendar)
    return out


def explained(pairs: DataFrame, read: tuple[DataFrame, DataFrame], config: ReconcileConfig = ReconcileConfig()) -> DataFrame:
    """``pairs`` with ``d_<signal>``: what each signal's score rests on, in words."""
    whole = pairs.join(read[0], "c_id").join(read[1], "k_id")
    return signals.with_shared(whole).select(*pairs.columns, *[c.alias(f"d_{n}") for n, c in signals.details(config).items()])


def _tied(ranked: DataFrame) -> DataFrame:
    """The pairs that the greedy pass takes of blocks of equal scores.

    A block is a set of rows of both sides that all have the same best score,
    all with each other and with nobody else. No pair outside touches it before
    it is used up, so it is taken in order: first with first, second with second.
    ``_c`` and ``_k`` are a pair's ranks in the lists of its two rows.
    """
    per_c, per_k = Window.partitionBy("c_id", "score"), Window.partitionBy("k_id", "score")
    of_c = {"_top_c": F.max("score").over(Window.partitionBy("c_id")), "_n_k": F.count(F.lit(1)).over(per_c), "_low_k": F.min("k_id").over(per_c)}
    of_k = {"_top_k": F.max("score").over(Window.partitionBy("k_id")), "_n_c": F.count(F.lit(1)).over(per_k), "_low_c": F.min("c_id").over(per_k)}
    met = ranked.withColumns(of_c).withColumns(of_k).filter("score = _top_c AND score = _top_k AND _n_k > 1 AND _n_c > 1")
    name = ["score", "_low_c", "_low_k", "_n_c", "_n_k"]
    blocks = met.groupBy(*name).agg(F.count(F.lit(1)).alias("_pairs"), F.countDistinct("c_id").alias("_cs"), F.countDistinct("k_id").alias("_ks"))
    blocks = blocks.filter("_pairs = _n_c * _n_k AND _cs = _n_c AND _ks = _n_k")
    return met.filter("_c = _k").join(blocks.select(*name), name).select("c_id", "k_id", "score")


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """The greedy pass over the candidates of a closed set of rows."""
    pdf = pdf.sort_values(["score", "c_id", "k_id"], ascending=[False, True, True], kind="stable")
    done_c, done_k, kept = set(), set(), []
    for c, k in zip(pdf["c_id"], pdf["k_id"], strict=True):
        if hit := c not in done_c and k not in done_k:
            done_c.add(c)
            done_k.add(k)
        kept.append(hit)
    return pdf.loc[kept, ["c_id", "k_id", "score"]]


def _closed(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest): what the greedy pass takes of all components of at most ``AT_ONCE`` candidates, and the candidates of the others.

    No two components have a row in common, so each is taken by itself.
    """
    ends = store(rest.withColumns({"_a": F.xxhash64(F.lit("c"), "c_id"), "_b": F.xxhash64(F.lit("k"), "k_id")}), "ends")
    found = components(ends, "_a", "_b").withColumnRenamed("node", "_a")
    held = store(ends.join(found, "_a"), "in-components")
    large = store(held.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > AT_ONCE).select("component"), "large-components")
    small = held.join(large, "component", "left_anti").groupBy("component").applyInPandas(_greedy, "c_id string, k_id string, score double")
    return store(small, "taken"), store(held.join(large, "component", "left_semi").select("c_id", "k_id", "score"), "rest")


def assign(found: DataFrame) -> DataFrame:
    """Greedy one-to-one pairs in the order (score descending, c_id, k_id), with the round in which each was made.

    The order is total, so the best remaining pair of a row that is also the
    best of its partner is what the greedy pass would take. Each round takes all
    such pairs and removes their rows from the rest; at least the best remaining
    pair goes, so it ends. After a round that took few of the rows, ties hold
    the rest up: blocks of equal scores are taken as a whole as well, and if
    that does not help either, components of the candidates' graph, each by a
    greedy pass of its own in a task. Only components of more than ``AT_ONCE``
    candidates go on by rounds; they are looked for anew as rounds cut them.
    """
    whole = found.select("c_id", "k_id", "score")
    rest = whole if vars(found).get("_stored_at") else store(whole, "candidates")
    by_c = Window.partitionBy("c_id").orderBy(F.desc("score"), "k_id")
    by_k = Window.partitionBy("k_id").orderBy(F.desc("score"), "c_id")
    taken: DataFrame | None = None
    turn, left, slow = 0, rest.count(), 0
    while left:
        turn += 1
        if slow and left <= AT_ONCE:
            made, rest = store(rest.groupBy().applyInPandas(_greedy, "c_id string, k_id string, score double").withColumn("round", F.lit(turn)), "assigned"), rest.limit(0)
            return made if taken is None else taken.unionAll(made)
        if slow % 4 == 2:
            got, after = _closed(rest)
            made = store(got.withColumn("round", F.lit(turn)), "assigned")
        else:
            ranked = rest.withColumns({"_c": F.row_number().over(by_c), "_k": F.row_number().over(by_k)})
            best = ranked.filter("_c = 1 AND _k = 1").select("c_id", "k_id", "score")
            if slow:
                best = best.unionAll(_tied(ranked)).distinct()
            made = store(best.withColumn("round", F.lit(turn)), "assigned")
            after = store(rest.join(made.select("c_id"), "c_id", "left_anti").join(made.select("k_id"), "k_id", "left_anti").select("c_id", "k_id", "score"), "rest")
        taken = made if taken is None else taken.unionAll(made)
        if turn % 64 == 0:  # the union stays small, whatever the number of rounds
            taken = store(taken, "assigned")
        before, left = left, after.count()
        discard(rest)
        rest = after
        slow = slow + 1 if left > 0.5 * before else 0
    return taken if taken is not None else rest.withColumn("round", F.lit(0))


def unmatched(events: DataFrame, pairs: DataFrame, source: str) -> DataFrame:
    """Events of a source that no pair holds."""
    column: Column = F.col("c_id" if source == "crm" else "k_id")
    return events.filter(F.col("source") == source).join(pairs.select(column.alias("source_id")), "source_id", "left_anti")
