"""Reconciliation: hand-made cases by operator, and properties of a whole run."""

import datetime as dt
import itertools
import json
import random
import re
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from concord.config import ReconcileConfig
from concord.functions import parse
from concord.functions import text as tx
from concord.operators import checks, dedupe, filters, match, merge, normalize, reports
from concord.plans import pipeline
from concord.schemas import CALENDAR_FIELDS, CALENDAR_SCHEMA, CRM_FIELDS, CRM_SCHEMA
from concord.sources import feeds, snapshots

ZONE = "America/New_York"


def crm_row(crm_id, **kw):
    base = dict(
        crm_id=crm_id, subject="Portfolio Review", client_name="David Park", client_company="Meridian Capital", relationship_owner="Sarah Chen", meeting_date="2025-03-10",
        meeting_time="14:00", meeting_type="In-Person", location="Palm Court", notes="equities", status="Scheduled", created_at="2025-01-10T09:00:00Z",
    )
    return {k: (base | kw)[k] for k in CRM_FIELDS}


def cal_row(event_id, **kw):
    base = dict(
        event_id=event_id, title="Meridian - Portfolio Review", organizer="sarah.chen@firma.com", attendees=["sarah.chen@firma.com", "david.park@meridiancap.com"],
        start_time="2025-03-10T14:00:00", end_time="2025-03-10T15:00:00", location="Palm Court", description="equities", is_recurring=False, status="confirmed", created_at="2025-01-10T09:00:00Z",
    )
    return {k: (base | kw)[k] for k in CALENDAR_FIELDS}


def crm_df(spark, rows):
    return feeds.with_raw(spark.createDataFrame([tuple(r.values()) for r in rows], CRM_SCHEMA), CRM_SCHEMA)


def cal_df(spark, rows):
    return feeds.with_raw(spark.createDataFrame([tuple(r.values()) for r in rows], CALENDAR_SCHEMA), CALENDAR_SCHEMA)


def run(spark, crm, calendar, **kw):
    return pipeline.reconcile(crm_df(spark, crm), cal_df(spark, calendar), **kw)


def test_dates_and_times(spark):
    cases = {
        "2025-03-10": (dt.date(2025, 3, 10), None), "20250310": (dt.date(2025, 3, 10), None), "03-15/2025": (dt.date(2025, 3, 15), "MALFORMED_DATE"),
        " 3/5/2025\t": (dt.date(2025, 3, 5), "MALFORMED_DATE"), "not a date": (None, "UNPARSABLE_DATE"), "2025-13-45": (None, "UNPARSABLE_DATE"),
        "": (None, "UNPARSABLE_DATE"), None: (None, "UNPARSABLE_DATE"), "03-15-2025-extra": (None, "UNPARSABLE_DATE"),
    }
    got = parse.with_date(spark.createDataFrame([(k,) for k in cases], "x string"), "x", "d").select("d", "d_code").collect()
    assert [tuple(r) for r in got] == list(cases.values())
    got = parse.with_time(spark.createDataFrame([("14:00",), ("9:05:07",), ("25:00",), ("noon",), (None,)], "x string"), "x", "t").select("t", "t_code").collect()
    assert [tuple(r) for r in got] == [(50400, None), (32707, None), (None, "TIME_MISSING"), (None, "TIME_MISSING"), (None, "TIME_MISSING")]


@pytest.mark.parametrize(
    ("raw", "value", "code"),
    [
        ("2025-03-13T19:00:00Z", "2025-03-13 15:00:00", None), ("2025-02-28T09:15:00Z", "2025-02-28 04:15:00", None), ("2025-03-10T14:00:00", "2025-03-10 14:00:00", "TIMEZONE_ASSUMED"),
        ("2025-03-14T20:00", "2025-03-14 20:00:00", "MALFORMED_DATETIME"), ("2025-03-14 20:00", "2025-03-14 20:00:00", "TIMEZONE_ASSUMED"), ("2025-03-14T20", "2025-03-14 20:00:00", "TIMEZONE_ASSUMED"),
        ("2025-03-14T20:00-05:00", "2025-03-14 21:00:00", None), ("2025-03-14T20:00:00+01:00", "2025-03-14 15:00:00", None), ("", None, "MALFORMED_DATETIME"), (None, None, "MALFORMED_DATETIME"),
        ("????", None, "MALFORMED_DATETIME"), ("0", None, "MALFORMED_DATETIME"), ("2025-03-14T20:00:00+99:00", None, "MALFORMED_DATETIME"), ("2025-02-30T10:00:00", None, "MALFORMED_DATETIME"),
    ],
)
def test_timestamps(spark, raw, value, code):
    got = parse.with_timestamp(spark.createDataFrame([(raw,)], "x string"), "x", "t", ZONE).select(F.col("t").cast("string"), "t_code").first()
    assert tuple(got) == (value, code)


def test_mail_and_status(spark):
    df = spark.createDataFrame([("A.B[at]x[dot]com",), (" Me@X.com ",), ("external-guests",), (None,)], "x string")
    got = df.select(F.explode(parse.read_emails(F.array("x"))).alias("m")).select("m.email", "m.code").collect()
    assert [tuple(r) for r in got] == [("a.b@x.com", "MALFORMED_EMAIL"), ("me@x.com", None), (None, "NON_EMAIL_ATTENDEE"), (None, "NON_EMAIL_ATTENDEE")]
    df = spark.createDataFrame([("Canceled",), ("confirmed",), ("moved",), (None,)], "x string")
    assert [r[0] for r in df.select(parse.parse_status(F.col("x"))[0]).collect()] == ["cancelled", "confirmed", "unknown", "unknown"]


def test_text_functions(spark):
    df = spark.createDataFrame([("LP Advisory Committee prep", "LPAC")], "a string, b string")
    got = df.select(tx.acronyms(tx.tokens(F.col("a"))).alias("x"), tx.content_tokens(F.col("a"), F.col("b")).alias("c"), tx.identity_key(F.lit("Priya.Sharma@firma.com")).alias("i")).first()
    assert "lpac" in got["x"] and set(got["c"]) == {"advisory", "committee", "lpac"} and got["i"] == "priyasharma"
    pairs = [("Atlas Ventures", "atlasvc.com", True), ("Horizon Wealth Partners", "horizonwp.com", True), ("Blue Oak", "bo.com", True), ("Atlas Ventures", "northstar.com", False), (None, "x.com", False)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r[0] for r in df.select(tx.company_matches_domain(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


def test_normalized_rows_keep_defects(spark):
    crm = normalize.normalize_crm(crm_df(spark, [
        crm_row("a", meeting_date="03-15/2025", meeting_time=None, status="???"), crm_row("b", client_name=None, meeting_type="Internal"),
        crm_row("c", client_name=" Multiple "), crm_row("d", client_name=None), crm_row(None, subject=" ", notes=""),
    ]))
    got = {r["source_id"]: r for r in crm.withColumn("codes", F.col("flags.code")).collect()}
    assert got["a"]["codes"] == ["MALFORMED_DATE", "TIME_MISSING", "UNKNOWN_STATUS"] and got["a"]["start"] is None
    assert got["b"]["codes"] == ["TIMEZONE_ASSUMED", "INTERNAL_NO_CLIENT"] and got["c"]["codes"] == ["TIMEZONE_ASSUMED", "PLACEHOLDER_CLIENT"]
    assert got["d"]["codes"] == ["TIMEZONE_ASSUMED"] and got["CRM-UNKNOWN"]["title"] is None and got["CRM-UNKNOWN"]["text"] is None
    assert json.loads(got["a"]["raw"])["status"] == "???"
    calendar = normalize.normalize_calendar(cal_df(spark, [
        cal_row("x", end_time="2025-03-10T15:00", attendees=["A[at]b.com", "guests", "a@b.com", "guests"]), cal_row("y", attendees=[], start_time="2025-03-10T14:00:00Z", end_time=None),
    ]))
    got = {r["source_id"]: r for r in calendar.withColumn("codes", F.col("flags.code")).collect()}
    assert got["x"]["codes"] == ["MALFORMED_DATETIME", "TIMEZONE_ASSUMED", "MALFORMED_EMAIL", "NON_EMAIL_ATTENDEE", "NON_EMAIL_ATTENDEE"]
    assert [p["display"] for p in got["x"]["participants"]] == ["a@b.com", "guests", "sarah.chen@firma.com"]
    assert [p["is_organizer"] for p in got["y"]["participants"]] == [True] and got["y"]["codes"] == ["MALFORMED_DATETIME"]


def survivors(spark, rows):
    events = normalize.normalize_calendar(cal_df(spark, rows))
    return {r["source_ids"][0]: r for r in dedupe.collapse(events).collect()}


def test_duplicates(spark):
    near, far = cal_row("b", start_time="2025-03-10T15:00:00"), cal_row("b", start_time="2025-03-10T15:01:00")
    assert len(survivors(spark, [cal_row("a"), near])) == 1 and len(survivors(spark, [cal_row("a"), far])) == 2
    assert len(survivors(spark, [cal_row("a", is_recurring=True), near])) == 2
    assert len(survivors(spark, [cal_row("a", organizer=None, attendees=["d@x.com"]), cal_row("b", organizer=None, attendees=["d@x.com"])])) == 2
    inside = ["sarah.chen@firma.com", "tom@firma.com"]
    assert len(survivors(spark, [cal_row("a", attendees=inside), cal_row("b", attendees=inside)])) == 2
    three = survivors(spark, [
        cal_row("a", location="late", created_at="2025-01-12T00:00:00Z"), cal_row("b", location="first", created_at="2025-01-01T00:00:00Z", attendees=["david.park@meridiancap.com", "new@x.com"]), cal_row("c", location="mid"),
    ])["a"]
    assert three["location"] == "first" and three["source_ids"] == ["a", "b", "c"] and len(three["raw_records"]) == 3
    assert [p["email"] for p in three["participants"]] == ["sarah.chen@firma.com", "david.park@meridiancap.com", "new@x.com"]
    assert [f["raw_value"] for f in three["flags"] if f["code"] == "DUPLICATE_COLLAPSED"] == ["a, b"]
    kept = survivors(spark, [cal_row("a", location="first", created_at=None), cal_row("b", created_at="2020-01-01T00:00:00Z")])["a"]
    assert kept["location"] == "first"


def first_fit(rows):
    """The rule as a plain loop: (id, start minute, client keys) in order."""
    out, alive = {}, []
    for rid, start, keys in rows:
        for s in alive:
            if abs(s["start"] - start) <= 60 and s["keys"] & keys:
                s["keys"] |= keys
                out[rid] = s["id"]
                break
        else:
            alive.append({"id": rid, "start": start, "keys": set(keys)})
    return out


def test_first_fit_against_a_plain_loop(spark):
    rnd = random.Random(3)
    rows, plain = [], []
    for i in range(60):
        minute, people = rnd.randrange(0, 300), rnd.sample("pqrstu", rnd.randint(1, 2))
        rows.append(cal_row(f"e{i:03d}", start_time=f"2025-03-10T{8 + minute // 60:02d}:{minute % 60:02d}:00", attendees=[f"{p}@x.com" for p in people]))
        plain.append((f"e{i:03d}", minute, set(people)))
    events = normalize.normalize_calendar(cal_df(spark, rows)).repartition(5)
    got = {r["source_id"]: r["survivor"] for r in dedupe.survivors(events).filter("place > 0").collect()}
    assert got == first_fit(plain)


def greedy(pairs):
    done, out = set(), set()
    for s, c, k in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if ("c", c) not in done and ("k", k) not in done:
            done |= {("c", c), ("k", k)}
            out.add((c, k))
    return out


def test_assignment_is_the_greedy_one(spark):
    rnd = random.Random(7)
    pairs = [(rnd.choice((0.5, 0.6, 0.7, 0.8)), f"c{c}", f"k{k}") for c, k in itertools.product(range(25), range(25)) if rnd.random() < 0.3]
    df = spark.createDataFrame([(c, k, s) for s, c, k in pairs], "c_id string, k_id string, score double")
    assert {(r["c_id"], r["k_id"]) for r in match.assign(df).collect()} == greedy(pairs)
    assert match.assign(df.limit(0)).collect() == []


def test_assignment_of_many_ties(spark):
    n = 1001
    ids = lambda name: spark.range(n).select(F.format_string(f"{name}%04d", F.col("id")).alias(f"{name}_id"))
    got = match.assign(ids("c").crossJoin(ids("k")).withColumn("score", F.lit(0.7))).collect()
    assert sorted((r["c_id"], r["k_id"]) for r in got) == [(f"c{i:04d}", f"k{i:04d}") for i in range(n)]
    rnd = random.Random(11)
    for _ in range(3):  # blocks of unequal sides, pairs that leave them, and worse scores around
        pairs = []
        for b in range(6):
            cs, ks = ([f"{name}{b}{i}" for i in range(rnd.randint(1, 5))] for name in "ck")
            pairs += [(0.5 + b % 3 / 10, c, k) for c in cs for k in ks]
        have = {p[1:] for p in pairs}
        every = list(itertools.product(sorted({p[1] for p in pairs}), sorted({p[2] for p in pairs})))
        pairs += [(rnd.choice((0.5, 0.6, 0.7)), *p) for p in rnd.sample(every, 12) if p not in have]
        df = spark.createDataFrame([(c, k, s) for s, c, k in pairs], "c_id string, k_id string, score double")
        assert {(r["c_id"], r["k_id"]) for r in match.assign(df).collect()} == greedy(pairs)


def test_blocking_and_pruning(spark):
    crm = [crm_row("c0"), crm_row("c1", meeting_date="2025-03-12"), crm_row("c2", meeting_date="x"), crm_row("c3", meeting_time=None), crm_row("c4", meeting_time="08:00")]
    calendar = [cal_row("k0"), cal_row("k1", start_time="2025-03-11T14:00:00", organizer="tom@firma.com", attendees=["z@zz.com"]), cal_row("k2", start_time="2025-03-15T14:00:00")]
    events = normalize.normalize_feeds(crm_df(spark, crm), cal_df(spark, calendar))
    from concord.operators import signals

    c, k = signals.crm_features(events.filter("source = 'crm'")), signals.calendar_features(events.filter("source = 'calendar'"))
    whole = {(r["c_id"], r["k_id"]) for r in match.blocked(c, k).collect()}
    assert whole == {("c0", "k0"), ("c0", "k1"), ("c1", "k1"), ("c3", "k0"), ("c3", "k1"), ("c4", "k0"), ("c4", "k1")}
    assert {(r["c_id"], r["k_id"]) for r in match.blocked(c, k, ReconcileConfig(pairs_per_task=2)).collect()} == whole
    plain = {(r["c_id"], r["k_id"], round(r["score"], 9)) for r in match.candidates(events).collect()}
    assert plain == {(r["c_id"], r["k_id"], round(r["score"], 9)) for r in match.candidates(events, prune=True).collect()}
    assert plain == {(r["c_id"], r["k_id"], round(r["score"], 9)) for r in match.candidates(events, ReconcileConfig(pairs_per_task=1), prune=True).collect()}
    assert max(plain, key=lambda p: p[2])[:2] == ("c0", "k0")


@pytest.mark.parametrize("settings", [{}, {"candidate_floor": 0.62}, {"candidate_floor": 0.2}, {"weights": {"participants": 0.3, "time": 0.5, "title": 0.1, "structure": 0.1}}, {"block_days": 0, "time_window_hours": 1.5}])
def test_pruning_loses_no_pair(spark, settings):
    rnd, config = random.Random(17), ReconcileConfig(**settings)
    people, firms = ["Sarah Chen", "Tom Okafor", "Ann Lee", "David Park", ""], ["Atlas Ventures", "Blue Oak", "Ox Hill Group", "Atlantic Trust", None, "at"]
    roots, places = ["atlasvc", "bo", "ohg", "atl", "atla", "a", "zz"], ["Palm Court", "Zoom", "Palm Court Room 4", None]
    mail = lambda name: (name or "nobody").lower().replace(" ", ".")
    hour = lambda: f"{rnd.randint(0, 23):02d}:{rnd.choice((0, 15, 30)):02d}"
    crm = [
        crm_row(f"c{i:03d}", relationship_owner=rnd.choice(people), client_name=rnd.choice([*people, "multiple", None]), client_company=rnd.choice(firms), meeting_date=f"2025-03-1{rnd.randint(0, 3)}",
                meeting_time=rnd.choice([hour(), hour(), None]), subject=rnd.choice(("LP Advisory Committee", "Fund Update")), location=rnd.choice(places), meeting_type=rnd.choice(("Virtual", "In-Person", "")))
        for i in range(24)
    ]
    calendar = [
        cal_row(f"k{i:03d}", organizer=rnd.choice([f"{mail(rnd.choice(people))}@firma.com", None, ""]), start_time=f"2025-03-1{rnd.randint(0, 3)}T{hour()}:00", title=rnd.choice(("LPAC", "Fund session", "Lunch")),
                location=rnd.choice(places), attendees=[f"{mail(rnd.choice(people))}@{rnd.choice(roots)}.com" for _ in range(rnd.randint(0, 3))] + rnd.choice([[], ["guests"]]))
        for i in range(24)
    ]
    events = match.store(normalize.normalize_feeds(crm_df(spark, crm), cal_df(spark, calendar)), "events")
    read = match.features(events)
    got = [sorted((r["c_id"], r["k_id"], round(r["score"], 9)) for r in match.candidates(events, config, prune, read).collect()) for prune in (False, True)]
    assert got[0] == got[1] and len(got[0]) > 30
    made = match.pruned(*read, config).select("c_id", "k_id")
    assert made.count() == made.distinct().count()


def test_evidence_says_what_scores_rest_on(spark):
    done = run(spark, [crm_row("c0", subject="LP Advisory Committee", notes=None, client_company=None), crm_row("c1", meeting_date="2025-04-10", meeting_time=None, client_name="Multiple", location=None)],
               [cal_row("k0", title="LPAC", description=None, start_time="2025-03-10T14:30:00", location="Zoom"), cal_row("k1", start_time="2025-04-10T09:00:00", location="Palm")])
    told = {r["id"]: {s["name"]: s["detail"] for s in r["match_evidence"]["signals"]} for r in done.meetings.collect()}
    assert told == {
        "c0-k0": {"participants": "owner organised it, client found", "time": "30 min apart", "title": "acronym match", "structure": "locations differ; In-Person vs virtual location"},
        "c1-k1": {"participants": "owner organised it, company = domain", "time": "one side has no time of day", "title": "shared: equities, meridian, portfolio", "structure": "location unknown on one side; modality agrees"},
    }


def test_merge_rules(spark):
    done = run(spark, [
        crm_row("c0", location="Palm Court - Room 4", status="Completed", meeting_time="13:00"), crm_row("c1", meeting_date="2025-04-10", status="Cancelled", location=None, client_name="Ann Lee"), crm_row("c2", meeting_date="2025-05-01"),
    ], [
        cal_row("k0", location="Palm Court"), cal_row("k1", start_time="2025-04-10T14:00:00", attendees=["ann.lee@meridiancap.com"], location="Lake House"), cal_row("k2", start_time="2025-06-01T09:00:00", attendees=[], organizer="tom@firma.com"),
    ])
    got = {r["id"]: r for r in done.meetings.collect()}
    assert set(got) == {"c0-k0", "c1-k1", "c2", "k2"}
    a, b = got["c0-k0"], got["c1-k1"]
    assert (a["location"]["value"], a["location"]["source"], a["location"]["conflict_kind"]) == ("Palm Court - Room 4", "crm", "granularity")
    assert (a["status"]["value"], a["status"]["conflict_kind"]) == ("completed", "granularity")
    assert a["start_time"]["conflict"] and a["start_time"]["source"] == "calendar" and a["conflict_fields"] == ["start_time"]
    assert (b["status"]["value"], b["status"]["source"], b["status"]["conflict"]) == ("cancelled", "crm", True)
    assert (b["location"]["value"], b["location"]["conflict_kind"]) == ("Lake House", "absence") and b["location"]["alternatives"][0]["value"] is None
    assert b["end_time"]["conflict_kind"] is None and b["end_time"]["alternatives"] == []
    assert got["c2"]["origin"] == "crm_only" and got["k2"]["owner_name"]["value"] == "tom@firma.com"
    assert all(r["n_violations"] == 0 for r in pipeline.violations(done).collect())
    total = {(r["metric"], r["key"]): r["count"] for r in pipeline.summary(done).collect()}
    assert total["meetings_out", None] == 4 and total["matched_pairs", None] == 2 and total["records_in", "crm"] == 3 and total["conflicts_by_field", "status"] == 1


def test_checks_find_what_is_wrong(spark):
    done = run(spark, [crm_row("c0")], [cal_row("k0")])
    broken = done.meetings.withColumn("origin", F.lit("crm_only")).withColumn("event_date", F.date_add("event_date", 1))
    assert checks.wrong_origin(broken).count() == 1 and checks.wrong_date(broken).count() == 1
    assert checks.repeated_ids(broken.unionAll(broken)).count() == 1
    assert checks.lost_or_repeated(done.events, broken.limit(0)).count() == 2
    with pytest.raises(ValueError, match="occurs 2 times"):
        run(spark, [crm_row("c0"), crm_row("c0")], [])
    done = run(spark, [crm_row("c0"), crm_row("c0"), crm_row("c1"), crm_row(None), crm_row("")], [], repeated="aside")
    assert [r["id"] for r in done.meetings.collect()] == ["c1"] and {tuple(r) for r in done.set_aside.collect()} == {("crm", "c0", 2), ("crm", "CRM-UNKNOWN", 2)}


def test_filters_and_reports(spark):
    done = run(spark, [crm_row("c0", status="Cancelled"), crm_row("c1", relationship_owner="Tom Okafor", meeting_date="2025-04-01"), crm_row("c2", meeting_date="junk")], [cal_row("k0")])
    ids = lambda **kw: sorted(r["id"] for r in filters.apply_filters(done.meetings, **kw).collect())
    assert ids() == ["c0-k0", "c1", "c2"] and ids(origin="both") == ["c0-k0"] and ids(has_conflicts=False) == ["c1", "c2"]
    assert ids(date_to=dt.date(2025, 3, 10)) == ["c0-k0"] and ids(owner="sarah.chen@FIRMA.com") == ["c0-k0", "c2"] and ids(owner="??") == []
    assert filters.filters_from_text({"origin": "elsewhere", "date_from": "soon", "has_conflicts": "yes"}) == {"has_conflicts": True}
    assert [r["id"] for r in done.meetings.orderBy(*filters.chronological()).collect()] == ["c0-k0", "c1", "c2"]
    report = {r["code"]: r for r in reports.flag_report(done.meetings, links=1).collect()}
    assert report["TIMEZONE_ASSUMED"]["n_flags"] == 3 and report["TIMEZONE_ASSUMED"]["n_meetings"] == 2 and report["TIMEZONE_ASSUMED"]["more"] == 1
    assert report["TIMEZONE_ASSUMED"]["first_ids"] == ["c0-k0"] and next(iter(report)) == "UNPARSABLE_DATE"
    assert {(r["source"], r["key"]) for r in reports.conflict_keys(done.meetings).collect()} == {("crm", "status"), ("calendar", "status")}


def test_order_and_partitions_do_not_matter(spark):
    rnd = random.Random(1)
    crm = [crm_row(f"c{i:02d}", meeting_time=f"{9 + i % 5}:00", client_name=rnd.choice(("David Park", "Ann Lee")), subject=rnd.choice(("Fund Update", "Portfolio Review"))) for i in range(20)]
    calendar = [cal_row(f"k{i:02d}", start_time=f"2025-03-10T{9 + i % 7:02d}:30:00", is_recurring=True, attendees=[rnd.choice(("david.park@meridiancap.com", "ann.lee@x.com"))]) for i in range(20)]
    whole = lambda a, b, n: sorted(r["id"] for r in pipeline.reconcile(crm_df(spark, a).repartition(n), cal_df(spark, b).repartition(n)).meetings.collect())
    one = whole(crm, calendar, 1)
    rnd.shuffle(crm)
    rnd.shuffle(calendar)
    assert one == whole(crm, calendar, 3)


def test_sources_and_snapshots(spark, tmp_path):
    rows = [crm_row("c0") | {"extra": 1}, crm_row("c1", location=None)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    for name, kind in (("a.json", "array"), ("l.json", "lines")):
        got = feeds.read_crm(spark, str(tmp_path / name), kind).orderBy("crm_id").collect()
        assert [r["crm_id"] for r in got] == ["c0", "c1"] and json.loads(got[0]["raw"])["extra"] == 1
    for bad in ('{"crm_id": "x"}', "nonsense", "[1, 2]"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            feeds.read_crm(spark, str(tmp_path / "bad.json"), "array").collect()
    with pytest.raises(Exception):  # noqa: B017
        feeds.read_calendar(spark, str(tmp_path / "none.json")).collect()
    done, root = run(spark, [crm_row("c0"), crm_row("c1", meeting_date="2025-05-01")], [cal_row("k0")]), str(tmp_path / "published")
    snapshots.publish(done.meetings, pipeline.summary(done), root)
    assert [r["id"] for r in snapshots.read_meetings(spark, root).collect()] == ["c0-k0", "c1"]
    later = snapshots.read_meetings(spark, root, dt.date(2025, 4, 1), dt.date(2025, 5, 1))
    assert [r["id"] for r in later.collect()] == ["c1"] and "month" in re.search(r"PartitionFilters: \[([^]]*)", later._jdf.queryExecution().toString())[1]
    with pytest.raises(Exception):  # noqa: B017
        snapshots.publish(done.meetings.withColumn("id", F.raise_error(F.lit("broken"))), pipeline.summary(done), root)
    assert snapshots.read_meeting(spark, root, "c1").count() == 1 and snapshots.read_summary(spark, root).count() > 5
    assert merge.FIELDS.keys() == reports.SOURCE_KEYS.keys() and ReconcileConfig().weights["participants"] == 0.4


def test_duplicates_with_padded_labels_and_late_swaps(spark):
    padded = survivors(spark, [cal_row("a", attendees=["sarah.chen@firma.com", " Guest List "]), cal_row("b", attendees=["sarah.chen@firma.com", "guest list "])])
    assert list(padded) == ["a"] and padded["a"]["source_ids"] == ["a", "b"]
    rows = [cal_row(i, location=i, created_at=f"2025-01-{day:02d}T00:00:00Z") for i, day in (("a", 9), ("b", 10), ("c", 5), ("d", 7), ("e", 1))]
    got = survivors(spark, rows)["a"]
    # In turn: a leads; b joins behind it; c takes the lead and a is set down; d joins; e takes the lead and c is set down.
    assert got["location"] == "e" and [json.loads(r)["location"] for r in got["raw_records"]] == ["e", "b", "a", "d", "c"]
    twice = survivors(spark, [cal_row("a", attendees=["sarah.chen@firma.com", "External", "external", "d@x.com"]), cal_row("b", attendees=["sarah.chen@firma.com", "External", "d@x.com"])])["a"]
    assert [f["raw_value"] for f in twice["flags"] if f["code"] == "NON_EMAIL_ATTENDEE"] == ["External", "external"]
    same = normalize.normalize_crm(crm_df(spark, [crm_row("x", client_name="Sarah Chen")]))
    assert [p["display"] for p in dedupe.collapse(same).first()["participants"]] == ["Sarah Chen", "Sarah Chen"]


def test_islands_of_a_component(spark, monkeypatch):
    rnd = random.Random(9)
    minutes = sorted(rnd.choice((0, 30, 61, 200, 261, 322, 400)) + rnd.randrange(0, 4) for _ in range(200))
    rows = [(1, m * 60_000_000) for m in minutes] + [(2, m * 60_000_000) for m in (0, 500)] + [(2, None), (3, -7 * 3_600_000_000), (3, -5 * 3_600_000_000)]
    for limit in (10**6, 0):
        monkeypatch.setattr(dedupe, "BROADCAST_ROWS", limit)
        got = dedupe.with_islands(spark.createDataFrame(rows, "component long, start long"), 60).collect()
        islands = {}
        for r in got:
            islands.setdefault((r["component"], r["island"]), []).append(r["start"])
        plain, last = 0, None
        for m in minutes:
            plain += last is not None and m - last > 60
            last = m
        assert sorted(k for c, k in islands if c == 1) == list(range(plain + 1)) and plain >= 2
        assert all(b - a <= 3_600_000_000 for (c, _), xs in islands.items() if c == 1 for a, b in itertools.pairwise(sorted(xs)))
        assert [k for c, k in islands if c == 2] == [0] and sorted(k for c, k in islands if c == 3) == [0, 1]


def test_a_day_of_one_client_is_many_tasks(spark):
    """A convener's day with one client in every row: as many tasks as gaps allow, and what the loop gives."""
    n, hours = 6_000, 8
    start = F.make_timestamp_ntz(F.lit(2025), F.lit(3), F.lit(10), (F.col("id") % hours * 3).cast("int"), (F.col("id") * 7 % 60).cast("int"), F.lit(0))
    one = normalize.normalize_calendar(cal_df(spark, [cal_row("a")])).drop("source_id", "ordinal", "start", "created")
    events = spark.range(n).join(F.broadcast(one)).withColumns({"source_id": F.format_string("e%06d", F.col("id")), "ordinal": F.format_string("e%06d", F.col("id")), "start": start, "created": F.lit(None).cast("timestamp_ntz")})
    decided = dedupe.survivors(events)
    got = {r["source_id"]: r["survivor"] for r in decided.filter("place > 0").collect()}
    assert got == first_fit([(f"e{i:06d}", i % hours * 180 + i * 7 % 60, {"x"}) for i in range(n)])
    islands = dedupe.with_islands(spark.range(n).select(F.lit(1).cast("long").alias("component"), F.expr("(id % 8 * 180 + id * 7 % 60) * 60000000L").alias("start")), 60)
    assert islands.groupBy("island").count().count() == hours


def test_assignment_of_a_chain_of_ties(spark, monkeypatch):
    """Each c may have two k of one score: n pairs one after the other by rounds alone."""
    n = 20_000
    links = spark.range(2 * n).select(F.format_string("c%06d", F.floor(F.col("id") / 2)).alias("c_id"), F.format_string("k%06d", F.floor((F.col("id") + 1) / 2)).alias("k_id"), F.lit(0.7).alias("score"))
    got = match.assign(links).collect()
    assert {(r["c_id"], r["k_id"]) for r in got} == {(f"c{i:06d}", f"k{i:06d}") for i in range(n)} and max(r["round"] for r in got) <= 20
    rnd = random.Random(13)
    pairs = [(rnd.choice((0.5, 0.6)), f"c{g}-{c}", f"k{g}-{c + d}") for g in range(12) for c in range(rnd.randint(2, 40)) for d in (0, 1, 2) if rnd.random() < 0.8]
    df = spark.createDataFrame([(c, k, s) for s, c, k in pairs], "c_id string, k_id string, score double")
    for limit in (10**6, 40, 0):  # the rest as a whole, by components, by rounds alone
        monkeypatch.setattr(match, "AT_ONCE", limit)
        assert {(r["c_id"], r["k_id"]) for r in match.assign(df).collect()} == greedy(pairs)


def test_details_round_as_exact_values_ask(spark):
    from concord.operators import signals

    minutes = list(range(0, 1501))
    df = spark.createDataFrame([(m, m / 60) for m in minutes], "m int, x double").withColumn("t", signals.tenths(F.col("x")))
    assert [r["t"] for r in df.orderBy("m").collect()] == [f"{m / 60:.1f}" for m in minutes]
    start = dt.datetime(2025, 3, 10)
    pairs = spark.createDataFrame([(m, start, start + dt.timedelta(minutes=m)) for m in minutes], "m int, c_start timestamp_ntz, k_start timestamp_ntz")
    got = pairs.withColumn("d", signals.time_detail(ReconcileConfig())).orderBy("m").collect()
    said = lambda h: "same start time" if h == 0 else f"{h:.1f}h apart" if h >= 4 else f"{h * 60:.0f} min apart"
    assert [r["d"] for r in got] == [said(m * 60 / 3600) for m in minutes]


def read_as_python_does(raw):
    """Wall clock and code by the standard library's rules: ISO first, then four patterns, which are malformed."""
    text = (raw or "").strip()
    found, malformed = None, False
    try:
        found = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        malformed = (text.split("T")[-1] if "T" in text else "").split("+")[0].split("Z")[0].count(":") == 1
    except ValueError:
        for pattern in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M"):
            try:
                found, malformed = dt.datetime.strptime(text, pattern), True
                break
            except ValueError:
                continue
    if found is None:
        return None, "MALFORMED_DATETIME"
    naive = found.tzinfo is None
    wall = found if naive else found.astimezone(ZoneInfo(ZONE)).replace(tzinfo=None)
    return wall, "MALFORMED_DATETIME" if malformed else "TIMEZONE_ASSUMED" if naive else None


def test_timestamps_of_the_whole_grammar(spark):
    days = ["2025-03-10", "20250310", "2025-W11", "2025-W11-1", "2025W11", "2025W111", "2026-W53-7", "2025-W53-1", "2025-02-30", "2025-W11-8", "0000-01-01", "2025-3-5", "2024-02-29", "2025-0310", "202503-10"]
    clocks = ["", "T14", "T14:00", "T14:00:00", "T1400", "T140000.5", " 14:00:00.123", "x14:00:00,1234567", "T14:00:00.", "T14:0000", "T25:00:00", "T14:60", "T9:05", " 9:5:07", "-23:59:59"]
    zones = ["", "Z", "+05", "-05:00", "+0530", "+05:30:15", "+24:00", "+99:00", "+05:75", "+"]
    texts = [d + c + z for d in days for c in clocks for z in zones] + ["\xa02025-03-10T14:00:00 ", "　2025-03-10T14:00:00Z\x85", "????", "0", "[]", "{}", " \n", None, "2025-03-10T14:00\n"]
    got = parse.with_timestamp(spark.createDataFrame(list(enumerate(texts)), "i int, x string"), "x", "t", ZONE).orderBy("i").select("x", "t", "t_code").collect()
    assert [(r["x"], (r["t"], r["t_code"])) for r in got] == [(x, read_as_python_does(x)) for x in texts]
    plain = ["2025-03-10", "20250310", "2025-W11", "2025W11", "2025-W11-1", "2025W111", "2026-W53-7", "2025-W53", "2025-W00-1", "0000-01-01", "2025-02-30", "2025-069", "2025-W1", "　2025-03-10\x85", "2025-03-10T"]
    got = parse.with_date(spark.createDataFrame([(x,) for x in plain], "x string"), "x", "d").select("x", "d", "d_code").collect()
    for x, d, code in got:
        try:
            assert (d, code) == (dt.date.fromisoformat(x.strip()), None)
        except ValueError:
            assert (d, code) == (None, "UNPARSABLE_DATE")


def files_read(df):
    """Files below the meetings that a plan opens."""
    return {f for f in df.inputFiles() if "/meetings/" in f}


def test_snapshots_are_audited_and_found_by_id_and_owner(spark, tmp_path):
    root = str(tmp_path / "audited")
    crm = [crm_row(f"c{i}", meeting_date=f"2025-{1 + i % 6:02d}-10", client_name="David Park" if i == 2 else f"Person {i}", relationship_owner=("Sarah Chen", "Priya Sharma", "Tom Okafor")[i % 3]) for i in range(12)] + [crm_row("undated", meeting_date="x")]
    done = run(spark, crm, [cal_row("k0", organizer="priya.sharma@firma.com", start_time="2025-09-01T10:00:00"), cal_row("k1", organizer="tom.okafor@firma.com")])
    summary = pipeline.summary(done)
    snapshots.publish(done.meetings, summary, root, events=done.events)
    before = [r["id"] for r in snapshots.read_meetings(spark, root).collect()]
    assert {r["check"]: r["n_violations"] for r in snapshots.read_audit(spark, root).collect()} == dict.fromkeys(("origin", "score", "conflict", "date", "ids", "event_date", "conservation"), 0)
    broken = {
        "origin": done.meetings.withColumn("origin", F.lit("both")), "date": done.meetings.withColumn("event_date", F.date_add("event_date", 1)), "ids": done.meetings.withColumn("id", F.lit("one")),
        "conflict": done.meetings.withColumn("status", F.col("status").withField("conflict", ~F.col("status.conflict"))), "conservation": done.meetings.filter("id <> 'c3'"),
        "score": done.meetings.withColumn("match_evidence", F.col("match_evidence").withField("score", F.lit(None).cast("double"))),
    }
    for check, meetings in broken.items():
        with pytest.raises(snapshots.SnapshotRejected, match=check) as caught:
            snapshots.publish(meetings, summary, root, run_id=f"bad-{check}", events=done.events)
        assert caught.value.found[check] > 0 and not (tmp_path / "audited" / f"run_id=bad-{check}").exists()
    assert [r["id"] for r in snapshots.read_meetings(spark, root).collect()] == before and len(before) > 12
    # One meeting: its month alone is opened.
    months = files_read(snapshots.read_meetings(spark, root))
    for meeting_id in ("c3", "undated"):
        one = snapshots.read_meeting(spark, root, meeting_id)
        assert [r["id"] for r in one.collect()] == [meeting_id] and len(months) > 6
        plan = one._jdf.queryExecution().toString()
        assert "month" in re.search(r"PartitionFilters: \[([^]]*)", plan)[1] and "PushedFilters: [IsNotNull(id), EqualTo(id," in plan
    assert snapshots.read_meeting(spark, root, "none").count() == 0
    for text in ("Priya Sharma", "priya.sharma@firma.com", "harm", "", "***"):
        wanted = filters.apply_filters(snapshots.read_meetings(spark, root), owner=text)
        found = snapshots.read_owner(spark, root, text)
        assert [r["id"] for r in found.collect()] == [r["id"] for r in wanted.collect()] and (found.count() > 3) == bool(re.search("[a-z]", text.lower()))
    snapshots.publish(done.meetings.limit(0), summary, root)
    assert snapshots.read_meetings(spark, root).count() == 0


def test_owners_beyond_what_is_handed_over_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "OWNERS_AT_ONCE", 1)
    root, done = str(tmp_path / "owners"), run(spark, [crm_row(f"c{i}", relationship_owner=f"Owner {i}") for i in range(5)], [])
    snapshots.publish(done.meetings, pipeline.summary(done), root)
    assert sorted(r["id"] for r in snapshots.read_owner(spark, root, "owner").collect()) == [f"c{i}" for i in range(5)]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_a_heavy_day_is_dealt_over_tasks(spark, monkeypatch, broadcast):
    """A third of all rows on one day: no task makes far more pairs than others, and no pair is lost or made twice."""
    monkeypatch.setattr(match, "HEAVY_KEYS", broadcast)
    n = 3_000
    day = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 * 5 + 5).cast("int")
    side = lambda c: spark.range(n).select(F.format_string(f"{c}%05d", F.col("id")).alias(f"{c}_id"), F.date_add(F.lit("2025-01-01").cast("date"), day).alias(f"{c}_date"))
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "32"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        made = match.blocked(side("c"), side("k"), ReconcileConfig(pairs_per_task=4_000)).withColumn("task", F.spark_partition_id())
        got = made.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()
        total = made.agg(F.count(F.lit(1)), F.count_distinct("c_id", "k_id")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    days = [0 if i % 3 == 0 else i % 97 * 5 + 5 for i in range(n)]
    wanted = sum(abs(a - b) <= 1 for a, b in ((x, y) for x in set(days) for y in set(days)) for _ in range(days.count(a) * days.count(b)))
    counts = sorted(r["n"] for r in got)
    assert tuple(total) == (wanted, wanted) and counts[-1] <= 5 * counts[len(counts) // 2]


@pytest.fixture
def small_splits(spark):
    for key, value in (("spark.sql.files.maxPartitionBytes", "400"), ("spark.sql.files.openCostInBytes", "0"), ("spark.sql.files.minPartitionNum", "1")):
        spark.conf.set(key, value)
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(key)


def test_array_files_are_read_in_splits(spark, tmp_path, small_splits):
    rnd = random.Random(4)
    hostile = ["plain", 'a "quoted" {brace}', "}{][", "back\\slash\\", 'end\\"}', "é } ü", "\n}\t{", "", "x" * 300, '"', '\\"']
    records = [
        {"crm_id": f"c{i}", "notes": rnd.choice(hostile), "deep": {"list": [{"a": rnd.choice(hostile)}, [], {}], "more": {"}": rnd.choice(hostile)}} if i % 3 else None, "subject": rnd.choice(hostile) * rnd.randint(0, 3)}
        for i in range(24)
    ]
    for name, text in (("one.json", json.dumps(records)), ("indented.json", "\n " + json.dumps(records, indent=3, ensure_ascii=False) + " \n" * 90), ("tight.json", json.dumps(records, separators=(",", ":"), ensure_ascii=False))):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        read = feeds.read_json_array(spark, str(path), split_bytes=0)
        got = [r["raw"] for r in read.collect()]
        assert sorted((json.loads(x) for x in got), key=lambda r: int(r["crm_id"][1:])) == records
        small = [json.loads(r["raw"]) for r in feeds.read_json_array(spark, str(path)).collect()]
        assert small == records
        assert all(x in text for x in got) and spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 4
    folder = tmp_path / "folder"
    folder.mkdir()
    for i, part in enumerate((records[:5], [], records[5:6], records[6:20])):
        (folder / f"p{i}.json").write_text(json.dumps(part, indent=i or None))
    assert feeds.read_json_array(spark, str(folder), split_bytes=0).count() == 20
    whole = json.dumps(records)
    for bad in (whole[:-7], whole + "x", "[" + whole + "]", "[1, 2]", '{"crm_id": "x"}', "nonsense", whole.replace("}, {", "} {", 1), whole.replace('"crm_id": "c7"', '"crm_id" "c7"')):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            feeds.read_json_array(spark, str(tmp_path / "bad.json"), split_bytes=0).collect()


def test_pairs_of_a_run_are_the_greedy_ones_of_all_candidates(spark, monkeypatch):
    """Assigned from high scores to low ones, and with parts of the score looked up or not; only pairs of rows that are left are made further down."""
    rnd = random.Random(23)
    firms, owners = ["Atlas Ventures", "Blue Oak"], ["Sarah Chen", "Tom Okafor"]
    mail = lambda name: name.lower().replace(" ", ".")
    crm, calendar = [], []
    for i in range(40):
        firm, owner, client, hour = rnd.choice(firms), rnd.choice(owners), f"Client {i:02d}", rnd.randint(9, 15)
        crm.append(crm_row(f"c{i:02d}", relationship_owner=owner, client_name=rnd.choice([client, client, "multiple", None]), client_company=rnd.choice([firm, firm, None]), meeting_time=rnd.choice([f"{hour:02d}:00", f"{hour:02d}:00", None])))
        if i % 4:
            calendar.append(cal_row(f"k{i:02d}", organizer=f"{mail(owner)}@firma.com", attendees=[f"{mail(client)}@{firm.split()[0].lower()}.com"], start_time=f"2025-03-1{rnd.choice((0, 0, 1))}T{hour + rnd.randint(0, 1):02d}:00:00"))
    read = match.features(match.store(normalize.normalize_feeds(crm_df(spark, crm), cal_df(spark, calendar)), "events"))
    every = match.store(match.candidates(None, read=read), "every")
    wanted = greedy([(r["score"], r["c_id"], r["k_id"]) for r in every.collect()])
    found, kept = [], match.store
    monkeypatch.setattr(match, "store", lambda df, tag: found.append(kept(df, tag)) or found[-1] if tag == "scored" else kept(df, tag))
    monkeypatch.setattr(match, "discard", lambda *tables: None)
    for combined in (10**6, 0):
        monkeypatch.setattr(match, "COMBINED", combined)
        found.clear()
        got = match.matched(read, prune=True).select("c_id", "k_id", "score").collect()
        assert {(r["c_id"], r["k_id"]) for r in got} == wanted and len(got) > 20
        assert sum(df.count() for df in found) < every.count() / 2


def test_collapsed_rows_are_known_before_any_pair(spark, monkeypatch):
    """Neither pairs nor a second copy of the rows that have no duplicate are made for it."""
    tags, kept = [], dedupe.store
    monkeypatch.setattr(dedupe, "store", lambda df, tag: tags.append((tag, df.count())) or kept(df, tag))
    monkeypatch.setattr(match, "matched", None)
    calendar = [cal_row("a"), cal_row("b", start_time="2025-03-10T14:30:00"), cal_row("d", start_time="2025-03-17T14:00:00")]
    collapsed = pipeline.prepared(crm_df(spark, [crm_row("c0")]), cal_df(spark, calendar))[1]
    assert {(r["source"], tuple(r["source_ids"]), len(r["raw_records"])) for r in collapsed.collect()} == {("crm", ("c0",), 1), ("calendar", ("a", "b"), 2), ("calendar", ("d",), 1)}
    assert ("folded", 1) in tags and "collapsed" not in dict(tags) and dedupe.collapsed_count(collapsed).first()[0] == 1


def test_feeds_written_for_reading_back_leave_no_second_copy(spark, monkeypatch):
    from pathlib import Path

    from concord.operators.stored import shared_folder
    from concord.plans import derive, queries

    monkeypatch.setattr(derive, "crm_feed", lambda *_: crm_df(spark, [crm_row("c0"), crm_row("c1")]))
    monkeypatch.setattr(derive, "calendar_feed", lambda *_: cal_df(spark, [cal_row("k0")]))
    root = Path(shared_folder(spark).removeprefix("file:"))
    before = set(root.glob("feeds-*"))
    told = queries.sources(spark, "").groupBy("kind").count().collect()
    (made,) = set(root.glob("feeds-*")) - before
    assert {tuple(r) for r in told} == {(kind, 3) for kind in ("lines", "array", "split", "parquet")}
    assert list(made.glob("crm-lines/*.gz")) and list(made.glob("crm-parquet/*.zstd.parquet")) and not list(root.glob("concord-crm-feed-*"))


def test_candidate_queries_prune_and_store_no_pairs(spark, monkeypatch):
    from concord.plans import queries

    events = match.store(normalize.normalize_feeds(crm_df(spark, [crm_row("c0"), crm_row("c1", meeting_time=None)]), cal_df(spark, [cal_row("k0"), cal_row("k1", start_time="2025-03-11T09:00:00")])), "events")
    wanted, tags, kept = {(r["c_id"], r["k_id"]) for r in match.candidates(events).collect()}, [], match.store
    monkeypatch.setattr(queries, "events_of", lambda *_: events)
    monkeypatch.setattr(queries, "_read", {}, raising=False)
    monkeypatch.setattr(match, "blocked", None)
    monkeypatch.setattr(match, "store", lambda df, tag: tags.append(tag) or kept(df, tag))
    for query in (queries.candidate_pairs, queries.candidate_pairs_pruned):
        assert {(r["c_id"], r["k_id"]) for r in query(spark, "").collect()} == wanted and ("c0", "k0") in wanted
    assert not {"plain-candidates", "scored"} & set(tags)
