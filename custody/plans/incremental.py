"""The ledger driven by what a load changes: its work follows the load, not the history.

The steps are those of ``plans.ledger``; the tables are bucketed (``sinks.buckets``). A load's
raw rows are matched with stored ones in their own buckets. Everything after that comes from
the rows that this load added: they are staged, promoted, and their serials name the drives to
decide. Counts per drive are kept as a table (``sides``), so that a decision needs one row a
drive, however long its history is; a late partner changes that row, and in ``recompute``
mode the drive is decided anew.

Repeats. Every load has a name. Raw rows keep the name of the load that added them, so a load
repeated under its name, whole or after a stop, works on the same rows; appends go by key, and
a drive's counts remember the last load they took in. ``unfinished`` lists loads that were
stopped and not repeated, ``repair`` completes them. Loads of one ledger run one after another.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custody import schemas
from custody.operators import bronze, gold, matching, merge, reports, silver
from custody.operators.bronze import at
from custody.sinks.buckets import BucketStore, Layout

_FIRST = "STRUCT<event_time: TIMESTAMP, drive_event_id: STRING>"
SIDES = (
    "serial_norm STRING, removed_count BIGINT, shredded_count BIGINT, "
    f"first_removed {_FIRST}, first_shredded {_FIRST}, last_load STRING"
)
TABLES = {
    "bronze": Layout(f"{schemas.BRONZE}, load STRING", ("event_id",)),
    "stg_shred": Layout(schemas.STG_SHRED, ("event_id",)),
    "stg_removal": Layout(schemas.STG_REMOVAL, ("event_id",)),
    "drives": Layout(schemas.DRIVE, ("serial_norm",)),
    "batches": Layout(schemas.BATCH, ("batch_id",)),
    "events": Layout(schemas.DRIVE_EVENT, ("drive_event_id",)),
    "sides": Layout(SIDES, ("serial_norm",)),
    "decisions": Layout(schemas.DECISION, ("serial_norm", "rule_version"), ("serial_norm",)),
    "steps": Layout("load STRING, step STRING, rows BIGINT", ("load", "step")),
    "loads": Layout("load STRING, finished_at TIMESTAMP", ("load",)),
}


class IncrementalLedger:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, version: str = matching.STRICT_V1):
        self.spark = spark
        self.store = BucketStore(spark, root, TABLES, buckets)
        self.version = version

    def process(self, rows: DataFrame, run_ts: datetime, load: str, mode: str = "frozen") -> dict[str, int]:
        """Take in rows of (source_sheet_id, source_tab, row_number, payload); returns the load's step counters."""
        incoming = self.store.stage("incoming", bronze.to_bronze(rows, run_ts).withColumn("load", F.lit(load)))
        touched = self.store.touched("bronze", incoming)
        self.store.append_new("bronze", incoming, touched)
        own = self.store.near("bronze", touched).where(F.col("load") == load)
        return self._derive(own, incoming, run_ts, load, mode)

    def unfinished(self) -> DataFrame:
        """Names of loads that added rows and were stopped; reads one column of the raw table."""
        return self.store.read("bronze").select("load").distinct().join(self.store.read("loads").select("load"), "load", "left_anti")

    def repair(self, run_ts: datetime, mode: str = "frozen") -> list[str]:
        """Complete the loads that were stopped, in the order of their rows' times."""
        rows = self.store.read("bronze").join(self.unfinished(), "load", "left_semi")
        order = rows.groupBy("load").agg(F.min("ingested_at").alias("first")).orderBy("first", "load")
        found = [r["load"] for r in order.collect()]  # one writer: rarely more than one load
        for load in found:
            own = self.store.read("bronze").where(F.col("load") == load)
            self._derive(own, own, run_ts, load, mode)
        return found

    def _derive(self, own: DataFrame, incoming: DataFrame, run_ts: datetime, load: str, mode: str) -> dict[str, int]:
        """All steps after the raw append, from the rows that the load added."""
        store = self.store
        seen = own.agg(F.count(F.lit(1)).alias("n"), F.min("ingested_at").alias("at")).first()
        run_ts = seen["at"] or run_ts  # a repeated load keeps its time
        counts = {"bronze": seen["n"], "duplicates": incoming.count() - seen["n"]}

        shreds = store.stage("shreds", silver.stage_shreds(silver.routed(own, "shred"), run_ts))
        removals = store.stage("removals", silver.stage_removals(silver.routed(own, "removal"), run_ts))
        for table, staged in (("stg_shred", shreds), ("stg_removal", removals)):
            store.append_new(table, staged)
            counts[table] = staged.count()

        shredded = gold.shred_events(gold.unpromoted(shreds), run_ts)
        removed = gold.removal_events(gold.unpromoted(removals, shredded), run_ts)
        events = store.stage("events", shredded.unionByName(removed))
        counts["events"] = events.count()
        changed = store.stage("sides", self._changes(events, load))
        touched = store.touched("sides", changed)  # the buckets of drives and decisions, too
        store.append_new("events", events)
        self._upsert_entities(shreds, changed, touched, run_ts)
        store.upsert("sides", changed, _side_policies(load), touched)
        counts["decisions"] = self._decide(changed, touched, run_ts, mode)

        lines = [(load, step, n) for step, n in counts.items()]
        store.append_new("steps", self.spark.createDataFrame(lines, TABLES["steps"].schema))
        store.append_new("loads", self.spark.createDataFrame([(load, run_ts)], TABLES["loads"].schema))
        return counts

    def _changes(self, events: DataFrame, load: str) -> DataFrame:
        """What the events add to each drive's sides."""
        when = F.struct("event_time", "drive_event_id")
        sums = []
        for kind, count, first in ((gold.REMOVED, "removed_count", "first_removed"), (gold.SHREDDED, "shredded_count", "first_shredded")):
            here = F.col("event_type") == kind
            sums += [F.count_if(here).alias(count), F.min(F.when(here, when)).alias(first)]
        return events.groupBy("serial_norm").agg(*sums).withColumn("last_load", F.lit(load))

    def _upsert_entities(self, shreds: DataFrame, changed: DataFrame, touched: list[int], run_ts: datetime) -> None:
        seen = {"first_seen_at": at(run_ts), "last_seen_at": at(run_ts)}
        policies = {"first_seen_at": merge.keep, "last_seen_at": merge.replace}
        self.store.upsert("drives", changed.select("serial_norm").withColumns(seen), policies, touched)
        batches = self.store.stage("batches", gold.batch_changes(gold.unpromoted(shreds), run_ts))
        fields = {c: merge.prefer_non_blank for c in ("client", "location", "tech")}
        self.store.upsert("batches", batches, {**policies, **fields, "batch_date": merge.prefer_present})

    def _decide(self, changed: DataFrame, touched: list[int], run_ts: datetime, mode: str) -> int:
        """Decide the drives that the load touched, from their sides."""
        store = self.store
        sides = store.near("sides", touched).join(changed.select("serial_norm"), "serial_norm", "left_semi")
        paired = sides.select(
            "serial_norm", "removed_count", "shredded_count",
            F.col("first_removed.drive_event_id").alias("removed_event_id"),
            F.col("first_shredded.drive_event_id").alias("shredded_event_id"),
        )
        past = store.near("decisions", touched).where(F.col("rule_version") == self.version)
        rows = store.stage("decisions", matching.decide_pairs(paired, run_ts, past, mode, self.version))
        if mode == "frozen":
            return store.append_new("decisions", rows, touched)
        policies = {c: merge.replace for c in rows.columns if c not in TABLES["decisions"].key}
        store.upsert("decisions", rows, policies, touched)
        return rows.count()

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.store.read(name) for name in TABLES}

    def views(self) -> dict[str, DataFrame]:
        t = self.tables()
        return {
            "v_drive_lifecycle": reports.drive_lifecycle(t["drives"], t["events"]),
            "v_unmatched_removals": reports.unmatched_removals(t["events"], t["decisions"]),
            "v_unmatched_shreds": reports.unmatched_shreds(t["events"], t["decisions"]),
            "v_ambiguous_matches": reports.ambiguous_matches(t["decisions"]),
        }

    def compact(self, files: int = 8) -> dict[str, list[int]]:
        """Merge the small files that many loads leave in a bucket."""
        return {name: self.store.compact(name, files) for name in TABLES}


def _side_policies(load: str) -> dict[str, merge.Policy]:
    """Counts add up and earliest events stay, unless the drive has already taken this load in."""

    def once(policy: merge.Policy) -> merge.Policy:
        def guarded(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
            done = F.coalesce(F.col("__old_last_load") == load, F.lit(False))
            return F.when(done, old).otherwise(policy(old, new, stored, incoming))

        return guarded

    def earliest(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
        return F.least(old, new)

    return {
        "removed_count": once(merge.add), "shredded_count": once(merge.add),
        "first_removed": once(earliest), "first_shredded": once(earliest), "last_load": merge.replace,
    }


def step_totals(steps: DataFrame) -> DataFrame:
    """Rows by step, over all loads."""
    return steps.groupBy("step").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("loads"))


def combined(*counts: dict[str, int]) -> dict[str, int]:
    """Step counters of several loads added up."""
    return reduce(lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}, counts, {})
