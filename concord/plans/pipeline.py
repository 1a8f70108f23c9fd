"""The whole reconciliation: normalize, collapse, match, merge, and what is reported of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReconcileConfig
from ..operators import checks, dedupe, match, merge, normalize, reports


@dataclass
class Reconciled:
    """The tables of a run; ``events`` has a row per input record, ``collapsed`` one per survivor."""

    events: DataFrame
    collapsed: DataFrame
    pairs: DataFrame
    meetings: DataFrame
    #: source, source_id, n: ids that occur more than once, whose rows take no part where they are set aside.
    set_aside: DataFrame


def prepared(crm: DataFrame, calendar: DataFrame, config: ReconcileConfig = ReconcileConfig(), repeated: str = "raise") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The events, one for each survivor of their collapse, and the ids that occur more than once; what a run does before rows of two sources meet."""
    events = match.store(normalize.normalize_feeds(crm, calendar, config), "events")
    twice = match.store(events.groupBy("source", "source_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-ids")
    if first := twice.first():
        if repeated == "raise":
            raise ValueError(f"source id {first['source_id']} occurs {first['n']} times in {first['source']}")
        events = match.store(events.join(twice, ["source", "source_id"], "left_anti"), "events")
    return events, dedupe.collapse(events, config), twice


def reconcile(crm: DataFrame, calendar: DataFrame, config: ReconcileConfig = ReconcileConfig(), prune: bool = False, repeated: str = "raise", ready: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> Reconciled:
    """Reconcile two feeds (columns of their schemas, and ``raw``).

    Assignment goes by id, so ids must be unique in their source; records
    without one share the id of unknown records. A repeated id raises, or with
    ``repeated="aside"`` its rows are left out and told in ``set_aside``. ``ready``
    is what :func:`prepared` gives of them, if at hand.
    """
    events, collapsed, twice = ready or prepared(crm, calendar, config, repeated)
    read = match.features(collapsed)
    pairs = match.store(match.explained(match.matched(read, config, prune), read, config), "pairs")
    meetings = merge.merge_pairs(collapsed, pairs, config)
    for source in ("crm", "calendar"):
        meetings = meetings.unionByName(merge.merge_singles(match.unmatched(collapsed, pairs, source), source))
    meetings = match.store(meetings, "meetings")
    match.discard(*read)
    return Reconciled(events, collapsed, pairs, merge.with_derived(meetings), twice)


def summary(run: Reconciled) -> DataFrame:
    """One long table: metric, key, count."""
    row = lambda df, metric, key, n: df.select(F.lit(metric).alias("metric"), key.cast("string").alias("key"), n.cast("long").alias("count"))
    told = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(None).cast("string").alias("key"), F.col(n).cast("long").alias("count")) for n in df.columns])).alias("r")).select("r.*")
    out = told(reports.outcome_counts(run.meetings)).unionByName(told(dedupe.collapsed_count(run.collapsed)))
    out = out.unionByName(row(reports.records_in(run.events), "records_in", F.col("source"), F.col("records")))
    out = out.unionByName(row(reports.conflicts_by_kind(run.meetings), "conflicts_by_kind", F.col("kind"), F.col("n")))
    out = out.unionByName(row(reports.conflicts_by_field(run.meetings), "conflicts_by_field", F.col("field"), F.col("n")))
    out = out.unionByName(row(reports.flags_by_code(run.meetings), "flags_by_code", F.col("code"), F.col("n")))
    return out.unionByName(row(reports.flags_by_severity(run.meetings), "flags_by_severity", F.col("severity"), F.col("n")))


def violations(run: Reconciled) -> DataFrame:
    return checks.violations(run.events, run.meetings)
