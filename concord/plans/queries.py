"""Registered queries over the derived feeds, and the SQL that they are held against."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ReconcileConfig
from ..functions import parse
from ..functions import text as tx
from ..operators import checks, dedupe, filters, match, normalize, reports, signals
from ..operators.stored import shared_folder
from ..sources import feeds, snapshots
from . import derive, pipeline
from .oracle import ORACLE_SQL  # noqa: F401  registered beside QUERIES

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = ReconcileConfig()
_runs: dict[tuple[str, str], pipeline.Reconciled] = {}
_events: dict[tuple[str, str], DataFrame] = {}
_ready: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame]] = {}
_read: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}
_found: dict[tuple[str, str], DataFrame] = {}
_published: dict[tuple[str, str], str] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feeds, normalized; made once in a session and stored. A run's are the same."""
    key = _key(spark, sf_dir)
    if key in _ready:
        return _ready[key][0]
    if key not in _events:
        whole = normalize.normalize_feeds(derive.crm_feed(spark, sf_dir), derive.calendar_feed(spark, sf_dir), CONFIG)
        _events[key] = match.store(whole, "events")
    return _events[key]


def prepared_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, collapsed events and repeated ids; made once in a session and stored. Queries that read no pairs need no more of a run."""
    key = _key(spark, sf_dir)
    if key not in _ready:
        _ready[key] = pipeline.prepared(derive.crm_feed(spark, sf_dir), derive.calendar_feed(spark, sf_dir), CONFIG)
    return _ready[key]


def run_of(spark: SparkSession, sf_dir: str) -> pipeline.Reconciled:
    """The whole reconciliation; made once in a session, its tables are stored."""
    key = _key(spark, sf_dir)
    if key not in _runs:
        _runs[key] = pipeline.reconcile(derive.crm_feed(spark, sf_dir), derive.calendar_feed(spark, sf_dir), CONFIG, prune=True, ready=prepared_of(spark, sf_dir))
    return _runs[key]


def _plain_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What pairing reads of the plain (not collapsed) events; made once in a session and stored."""
    key = _key(spark, sf_dir)
    if key not in _read:
        _read[key] = match.features(events_of(spark, sf_dir))
    return _read[key]


def _plain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs of the plain events; made once in a session, the tables they lie in are stored."""
    key = _key(spark, sf_dir)
    if key not in _found:
        _found[key] = match.matched(_plain_features(spark, sf_dir), CONFIG, prune=True)
    return _found[key]


def snapshot_of(spark: SparkSession, sf_dir: str) -> str:
    """The folder where the run's meetings have been published; once in a session."""
    key = _key(spark, sf_dir)
    if key not in _published:
        run, root = run_of(spark, sf_dir), f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
        snapshots.publish(run.meetings, pipeline.summary(run), root, events=run.events)
        _published[key] = root
    return _published[key]


def _stamp(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


def _codes(c: str = "flags"):
    return F.array_join(F.transform(c, lambda f: F.concat(f["code"], F.lit(":"), f["field"])), ",")


def crm_normalized(spark, sf_dir):
    """S2, F1-F3, F5, F6, F8, N1-N3."""
    e = normalize.normalize_crm(derive.crm_feed(spark, sf_dir), CONFIG)
    return e.select("source_id", F.col("event_date").cast("string").alias("event_date"), _stamp("start").alias("start"), "client_name", "client_company", "status", F.size("participants").alias("n_participants"), _codes().alias("flags"))


def calendar_normalized(spark, sf_dir):
    """S3, F4, F5, F7, F8, F11, N4-N6."""
    e = normalize.normalize_calendar(derive.calendar_feed(spark, sf_dir), CONFIG)
    people = F.array_join(F.transform("participants", lambda p: F.concat_ws("/", p["display"], p["domain"], p["is_organizer"].cast("string"))), ",")
    return e.select("source_id", F.col("event_date").cast("string").alias("event_date"), _stamp("start").alias("start"), _stamp("end").alias("end"), "is_recurring", "status", people.alias("participants"), _codes().alias("flags"))


def flags_by_code(spark, sf_dir):
    """N7, R5 over normalized events, with J5's severity."""
    counted = reports.flags_by_code(events_of(spark, sf_dir))
    return counted.join(F.broadcast(reports.flag_dimension(counted)), "code").select("code", "severity", "n")  # as many rows as codes


def flags_by_severity(spark, sf_dir):
    return reports.flags_by_severity(events_of(spark, sf_dir))


def records_in(spark, sf_dir):
    """R1."""
    return reports.records_in(events_of(spark, sf_dir))


def status_vocabulary(spark, sf_dir):
    """R9."""
    return reports.vocabulary(events_of(spark, sf_dir))


def gap_census(spark, sf_dir):
    """R8, both feeds."""
    return reports.gap_census("crm", derive.crm_feed(spark, sf_dir)).unionByName(reports.gap_census("calendar", derive.calendar_feed(spark, sf_dir)))


def text_functions(spark, sf_dir):
    """F9-F15 on customers: tokens, keys, companies against domains, content words, acronyms."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    company, title = F.concat("c_mktsegment", F.lit(" Wealth Partners")), F.concat("c_mktsegment", F.lit(" LP Advisory Committee for the "), "c_name")
    domain = F.concat(F.lower(F.substring("c_mktsegment", 1, 5)), F.lit("vc.com"))
    initials = F.concat(F.lower(F.substring("c_mktsegment", 1, 1)), F.lit("wp.org"))
    return c.select(
        "c_custkey", F.array_join(tx.tokens(title), " ").alias("tokens"), tx.name_key(F.col("c_name")).alias("name_key"), tx.email_key(F.concat("c_name", F.lit("@x.com"))).alias("email_key"),
        tx.company_matches_domain(company, domain).alias("prefix_match"), tx.company_matches_domain(company, initials).alias("initials_match"), tx.company_matches_domain(company, F.lit("zz.com")).alias("no_match"),
        F.array_join(F.array_sort(tx.content_tokens(title)), " ").alias("content"), F.size(tx.acronyms(tx.tokens(title))).alias("n_acronyms"),
        F.array_contains(tx.acronyms(tx.tokens(title)), "lpac").alias("has_lpac"), parse.email_domain(F.concat("c_name", F.lit("@X.Com"))).alias("domain"),
    )


def candidate_pairs(spark, sf_dir):
    """Scored pairs at or above the floor."""
    found = match.candidates(events_of(spark, sf_dir), CONFIG, prune=True, read=_plain_features(spark, sf_dir))
    return found.select("c_id", "k_id", *[F.round(f"s_{s}", 6).alias(s) for s in CONFIG.weights], F.round("score", 6).alias("score"), "confidence")


def candidate_pairs_pruned(spark, sf_dir):
    """The same pairs by the pruned join; they are not stored, as their number grows with the square of a day's rows."""
    return match.candidates(events_of(spark, sf_dir), CONFIG, prune=True, read=_plain_features(spark, sf_dir)).select("c_id", "k_id", F.round("score", 6).alias("score"))


def signal_contributions(spark, sf_dir):
    """Contribution of each signal of each matched pair."""
    rows = run_of(spark, sf_dir).pairs.select("c_id", "k_id", F.explode(signals.evidence(CONFIG)).alias("s"))
    return rows.select("c_id", "k_id", F.col("s.name").alias("signal"), F.round("s.contribution", 6).alias("contribution"))


def match_details(spark, sf_dir):
    """What the score of each signal of each matched pair rests on."""
    rows = run_of(spark, sf_dir).meetings.filter("origin = 'both'").select("id", F.explode("match_evidence.signals").alias("s"))
    return rows.select("id", F.col("s.name").alias("signal"), F.col("s.detail").alias("detail"))


def assignment(spark, sf_dir):
    """A1, A2 on the plain (not collapsed) events."""
    return _plain_pairs(spark, sf_dir).select("c_id", "k_id", F.round("score", 6).alias("score"))


def unmatched_records(spark, sf_dir):
    """J2, J3."""
    events, pairs = events_of(spark, sf_dir), _plain_pairs(spark, sf_dir)
    return match.unmatched(events, pairs, "crm").select("source", "source_id").unionByName(match.unmatched(events, pairs, "calendar").select("source", "source_id"))


def duplicates(spark, sf_dir):
    """Which record joins which."""
    return dedupe.survivors(events_of(spark, sf_dir), CONFIG).filter("place > 0").select("source", "source_id", "survivor")


def collapsed(spark, sf_dir):
    """D4-D7 for the records that absorbed others."""
    c = prepared_of(spark, sf_dir)[1].filter(F.size("source_ids") > 1)
    return c.select("source", F.array_join("source_ids", ",").alias("source_ids"), _stamp("start").alias("start"), F.size("participants").alias("n_participants"), F.size("raw_records").alias("n_raw"),
                    F.array_contains(F.col("flags.code"), "DUPLICATE_COLLAPSED").alias("flagged"))


def duplicate_count(spark, sf_dir):
    """D8."""
    return dedupe.collapsed_count(prepared_of(spark, sf_dir)[1])


def merged_fields(spark, sf_dir):
    """Value, source, kind of the fields that follow rules, for every meeting."""
    m = run_of(spark, sf_dir).meetings
    told = lambda f, v: [v.alias(f), F.col(f"{f}.source").alias(f"{f}_source"), F.col(f"{f}.conflict_kind").alias(f"{f}_kind"), F.size(f"{f}.alternatives").alias(f"{f}_others")]
    return m.select("id", "origin", *told("start_time", _stamp("start_time.value")), *told("location", F.col("location.value")), *told("status", F.col("status.value")), *told("owner_name", F.col("owner_name.value")))


def meeting_states(spark, sf_dir):
    """G9, G10."""
    return run_of(spark, sf_dir).meetings.select("id", F.array_join("conflict_fields", ",").alias("conflict_fields"), "has_conflicts", "worst_severity", F.size("flags").alias("n_flags"))


def run_summary(spark, sf_dir):
    """R1-R5, D8 as one table."""
    return pipeline.summary(run_of(spark, sf_dir))


def conflict_kinds(spark, sf_dir):
    return reports.conflicts_by_kind(run_of(spark, sf_dir).meetings)


def conflict_fields(spark, sf_dir):
    return reports.conflicts_by_field(run_of(spark, sf_dir).meetings)


def flag_report(spark, sf_dir):
    """R6, A4."""
    r = reports.flag_report(run_of(spark, sf_dir).meetings)
    return r.select("code", "severity", "n_flags", "n_meetings", F.array_join("first_ids", ",").alias("first_ids"), "more")


def conflict_report(spark, sf_dir):
    """Field and meeting, whole."""
    return reports.conflict_meetings(run_of(spark, sf_dir).meetings)


def conflict_keys(spark, sf_dir):
    """J6."""
    return reports.conflict_keys(run_of(spark, sf_dir).meetings)


def chronological(spark, sf_dir):
    """A3, Q-6: the list in order, without raw records."""
    return filters.list_items(run_of(spark, sf_dir).meetings).orderBy(*filters.chronological()).select("id", F.col("event_date").cast("string").alias("event_date"), _stamp("start").alias("start"))


def filtered_list(spark, sf_dir):
    """Q-1 to Q-5, Q-8 together."""
    wanted = filters.filters_from_text({"origin": "both", "has_conflicts": "true", "date_from": "1993-01-01", "date_to": "1996-12-31", "owner": "priya.sharma@firma.com"})
    return filters.apply_filters(run_of(spark, sf_dir).meetings, **wanted).select("id", F.col("owner_name.value").alias("owner"))


def merged_values(spark, sf_dir):
    """The seven fields without rules of their own."""
    m = run_of(spark, sf_dir).meetings
    told = lambda f, v: [v.alias(f), F.col(f"{f}.source").alias(f"{f}_source"), F.col(f"{f}.conflict_kind").alias(f"{f}_kind"), F.size(f"{f}.alternatives").alias(f"{f}_others")]
    people = F.array_join(F.transform("participants.value", lambda p: p["display"]), ",")
    plain = [c for f in ("title", "client_name", "client_company", "meeting_type", "notes") for c in told(f, F.col(f"{f}.value"))]
    return m.select("id", *plain, *told("end_time", _stamp("end_time.value")), *told("participants", people))


def published_list(spark, sf_dir):
    """Publish, then read the current snapshot back."""
    return snapshots.read_meetings(spark, snapshot_of(spark, sf_dir)).select("id", "origin")


def published_period(spark, sf_dir):
    """S5, Q-3: a period of the current snapshot, read from its months alone."""
    first, last = dt.date(1995, 1, 15), dt.date(1995, 3, 20)
    return snapshots.read_meetings(spark, snapshot_of(spark, sf_dir), first, last).select("id", F.col("event_date").cast("string").alias("event_date"))


def published_summary(spark, sf_dir):
    """The summary of the current snapshot."""
    return snapshots.read_summary(spark, snapshot_of(spark, sf_dir)).select("metric", "key", "count")


def meeting_detail(spark, sf_dir):
    """Q-7: one meeting by its id, with its raw records: the last of those that both sources hold."""
    root = snapshot_of(spark, sf_dir)
    wanted = snapshots.read_meetings(spark, root).filter("origin = 'both'").agg(F.max("id").alias("id")).first()["id"]
    shown = snapshots.read_meeting(spark, root, wanted or "")
    return shown.select("id", "origin", F.col("title.value").alias("title"), F.size("raw_crm").alias("n_crm"), F.size("raw_calendar").alias("n_calendar"), F.get_json_object(F.col("raw_crm")[0], "$.notes").alias("raw_notes"))


def sources(spark, sf_dir):
    """Both feeds written as JSON Lines, JSON arrays and Parquet, read back and normalized; the arrays as a whole and in splits."""
    root, out = f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}", None
    for name, feed, read, shape in (
        ("crm", derive.crm_feed(spark, sf_dir), feeds.read_crm, normalize.normalize_crm), ("calendar", derive.calendar_feed(spark, sf_dir), feeds.read_calendar, normalize.normalize_calendar),
    ):
        feed = match.store(feed, f"{name}-feed")
        feed.select("raw").write.option("compression", "gzip").text(f"{root}/{name}-lines")  # arrays stay plain, as they are read in splits
        feed.drop("raw").write.option("compression", "zstd").parquet(f"{root}/{name}-parquet")
        feeds.write_json_arrays(feed, f"{root}/{name}-array")
        match.discard(feed)
        for kind in ("lines", "array", "split", "parquet"):
            e = shape(read(spark, f"{root}/{name}-{'array' if kind == 'split' else kind}", kind), CONFIG)
            told = e.select(F.lit(kind).alias("kind"), "source", "source_id", F.size("participants").alias("n_participants"), F.size("flags").alias("n_flags"), F.length(F.get_json_object("raw", "$.location")).alias("raw_location_chars"))
            out = told if out is None else out.unionByName(told)
    return out


def published_owner(spark, sf_dir):
    """Q-4 over the current snapshot, by its dictionary of owners: all meetings of a name, whoever writes it how."""
    found = snapshots.read_owner(spark, snapshot_of(spark, sf_dir), "Priya Sharma")
    return found.select("id", F.col("owner_name.value").alias("owner"))


def rejected_runs(spark, sf_dir):
    """Runs that break a rule are not published; what their audits found, and what readers see after all: the run before."""
    run = run_of(spark, sf_dir)
    root, summary = f"{shared_folder(spark)}/rejected-{uuid.uuid4().hex}", pipeline.summary(run)
    snapshots.publish(run.meetings, summary, root, events=run.events)
    hit = F.coalesce(F.year("event_date") == 1995, F.lit(False))
    m = run.meetings
    spoiled = {
        "origin": m.withColumn("origin", F.when(hit, "crm_only").otherwise(F.col("origin"))),
        "score": m.withColumn("match_evidence", F.when(hit, F.col("match_evidence").withField("score", F.col("match_evidence.score") / 2)).otherwise(F.col("match_evidence"))),
        "date": m.withColumn("event_date", F.when(hit, F.date_add("event_date", 1)).otherwise(F.col("event_date"))),
        "conservation": m.filter(~hit),
    }
    out = []
    for name, meetings in spoiled.items():
        try:
            snapshots.publish(meetings, summary, root, events=run.events)
            out.append((name, "published", 0))
        except snapshots.SnapshotRejected as rejected:
            out += [(name, check, n) for check, n in rejected.found.items() if n]
    told = spark.createDataFrame(out, "spoiled string, `check` string, n long")
    seen = snapshots.read_meetings(spark, root).agg(F.lit("none").alias("spoiled"), F.lit("readable").alias("check"), F.count(F.lit(1)).alias("n"))
    return told.unionByName(seen)


def timestamp_shapes(spark, sf_dir):
    """times of events written in all the ways that ISO 8601 has, read back."""
    k = F.col("event_id") % 12
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"))
    day, clock = F.date_format("at", "yyyy-MM-dd"), F.date_format("at", "HH:mm:ss")
    bare = lambda c: F.replace(F.replace(c, F.lit("-"), F.lit("")), F.lit(":"), F.lit(""))
    year = F.year(F.date_add(F.date_trunc("week", "at").cast("date"), 3))
    week = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear("at").cast("string"), 2, "0"))
    weekday = (F.weekday("at") + 1).cast("string")
    forms = [
        F.concat(day, F.lit("T"), clock), F.concat(bare(day), F.lit("T"), bare(clock)), F.concat(day, F.lit(" "), clock, F.lit(",5")), F.concat(day, F.lit("x"), clock, F.lit(".1234567")),
        F.concat(week, F.lit("-"), weekday, F.lit("T"), clock), F.concat(bare(week), weekday, F.lit("T"), bare(clock), F.lit("Z")), F.concat(day, F.lit("T"), clock, F.lit("+05:30:15")), F.concat(day, F.lit("T"), clock, F.lit("-0330")),
        F.concat(F.lit("\u00a0"), day, F.lit("T"), clock, F.lit("Z\u2003")), F.concat(day, F.lit("T"), F.substring(clock, 1, 5)), F.concat(F.substring(day, 1, 7), F.substring(day, 9, 2), F.lit("T"), clock), F.concat(day, F.lit("T"), clock, F.lit("+24:00")),
    ]
    raw = forms[-1]
    for i, form in enumerate(forms[:-1]):
        raw = F.when(k == i, form).otherwise(raw)
    read = parse.with_timestamp(e.withColumn("raw", raw), "raw", "t", CONFIG.timezone)
    read = parse.with_date(read.withColumn("day", F.when(k < 4, day).when(k < 7, bare(day)).when(k < 9, F.concat(week, F.lit("-"), weekday)).when(k == 9, bare(week)).otherwise(F.concat(day, F.lit("\u3000")))), "day", "d")
    return read.select("event_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), "t_code", F.col("d").cast("string").alias("d"), "d_code")


def broken_integrity(spark, sf_dir):
    """C1-C6 over meetings that are broken on purpose: all of one year."""
    run = run_of(spark, sf_dir)
    hit = F.coalesce(F.year("event_date") == 1995, F.lit(False))
    m, e = run.meetings, run.events
    flipped = F.col("start_time").withField("conflict", ~F.col("start_time.conflict"))
    broken = {
        "origin": checks.wrong_origin(m.withColumn("origin", F.when(hit, "crm_only").otherwise(F.col("origin")))),
        "score": checks.wrong_score(m.withColumn("match_evidence", F.when(hit, F.col("match_evidence").withField("score", F.col("match_evidence.score") / 2)).otherwise(F.col("match_evidence")))),
        "conflict": checks.wrong_conflict(m.withColumn("start_time", F.when(hit, flipped).otherwise(F.col("start_time")))),
        "date": checks.wrong_date(m.withColumn("event_date", F.when(hit, F.date_add("event_date", 1)).otherwise(F.col("event_date")))),
        "event_date": checks.wrong_date(e.withColumn("event_date", F.when(hit, F.date_add("event_date", 1)).otherwise(F.col("event_date"))), "source_id"),
        "ids": checks.repeated_ids(m.unionAll(m.filter(hit))), "conservation": checks.lost_or_repeated(e, m.filter(~hit)),
    }
    return checks.counted(broken)


def integrity(spark, sf_dir):
    """Violations by check."""
    return pipeline.violations(run_of(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f"rec_{f.__name__}": f
    for f in (
        crm_normalized, calendar_normalized, flags_by_code, flags_by_severity, records_in, status_vocabulary, gap_census, text_functions, candidate_pairs,
        candidate_pairs_pruned, signal_contributions, assignment, unmatched_records, duplicates, collapsed, duplicate_count, merged_fields, meeting_states,
        run_summary, conflict_kinds, conflict_fields, flag_report, conflict_report, conflict_keys, chronological, filtered_list, published_list, integrity,
        match_details, merged_values, published_period, published_summary, meeting_detail, sources, broken_integrity, published_owner, rejected_runs, timestamp_shapes,
    )
}
