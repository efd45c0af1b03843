"""Ledger pipeline over stored tables: ingest, stage, promote, decide."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custody import schemas
from custody.operators import bronze, gold, matching, reports, silver
from custody.sinks.snapshots import TableStore

TABLES = {
    "bronze": schemas.BRONZE,
    "stg_shred": schemas.STG_SHRED,
    "stg_removal": schemas.STG_REMOVAL,
    "drives": schemas.DRIVE,
    "batches": schemas.BATCH,
    "events": schemas.DRIVE_EVENT,
    "decisions": schemas.DECISION,
}
PARTITIONS = {"bronze": ["source_sheet_id"], "events": ["event_type"]}


class Ledger:
    """Every step may be repeated: done work is found by key and left alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = TableStore(spark, root, TABLES, PARTITIONS)

    def bronze(self) -> DataFrame:
        return self.store.log("bronze")

    def ingest(self, rows: DataFrame, run_ts: datetime) -> dict[str, int]:
        """Append rows of (source_sheet_id, source_tab, row_number, payload) not stored yet."""
        incoming, total = bronze.observed(bronze.to_bronze(rows, run_ts), "incoming")
        fresh, inserted = bronze.observed(bronze.append_new(incoming, self.bronze()), "inserted")
        self.store.append("bronze", fresh)
        done = inserted.get["rows"]
        return {"inserted": done, "duplicates": total.get["rows"] - done}

    def stage(self, run_ts: datetime, routes: dict[str, list[str]] | None = None) -> dict[str, int]:
        counts = {}
        for table, route, fn in [
            ("stg_shred", "shred", silver.stage_shreds),
            ("stg_removal", "removal", silver.stage_removals),
        ]:
            todo = silver.unstaged(silver.routed(self.bronze(), route, routes), self.store.log(table))
            rows, seen = bronze.observed(fn(todo, run_ts), table)
            self.store.append(table, rows)
            counts[table] = seen.get["rows"]
        return counts

    def promote(self, run_ts: datetime) -> dict[str, int]:
        # The rows to promote are found once and written down; everything else
        # is derived from them, not from the whole staging tables.
        events = self.store.log("events")
        shreds = self.store.stage("new_shreds", gold.unpromoted(self.store.log("stg_shred"), events))
        removals = self.store.stage(
            "new_removals",
            gold.unpromoted(
                self.store.log("stg_removal"), events, gold.shred_events(shreds, run_ts)
            ),
        )
        result = gold.promote(
            shreds, removals, self.store.snapshot("drives"), self.store.snapshot("batches"),
            self.spark.createDataFrame([], schemas.DRIVE_EVENT), run_ts,
        )
        # Entities first, events last: events mark rows as promoted, so a run lost
        # in between is simply repeated.
        self.store.replace("batches", result.batches)
        self.store.replace("drives", result.drives)
        rows, seen = bronze.observed(result.new_events, "events")
        self.store.append("events", rows)
        return {"events": seen.get["rows"]}

    def decide(self, run_ts: datetime, mode: str = "frozen", version: str = matching.STRICT_V1) -> dict[str, int]:
        past = self.store.snapshot("decisions")
        rows = matching.decide(
            self.store.snapshot("drives"), self.store.log("events"), run_ts, past, mode, version
        )
        rows, seen = bronze.observed(rows, "decisions")
        if mode == "frozen":
            self.store.extend("decisions", rows)
        else:
            others = past.filter(F.col("rule_version") != version)
            self.store.replace("decisions", others.unionByName(rows))
        return {"decisions": seen.get["rows"]}

    def run(self, run_ts: datetime, mode: str = "frozen") -> dict[str, int]:
        """Stage, promote, decide; counters of the three steps."""
        return {**self.stage(run_ts), **self.promote(run_ts), **self.decide(run_ts, mode)}

    def tables(self) -> dict[str, DataFrame]:
        return {
            "bronze": self.bronze(),
            "stg_shred": self.store.log("stg_shred"),
            "stg_removal": self.store.log("stg_removal"),
            "drives": self.store.snapshot("drives"),
            "batches": self.store.snapshot("batches"),
            "events": self.store.log("events"),
            "decisions": self.store.snapshot("decisions"),
        }

    def views(self) -> dict[str, DataFrame]:
        t = self.tables()
        return {
            "v_drive_lifecycle": reports.drive_lifecycle(t["drives"], t["events"]),
            "v_unmatched_removals": reports.unmatched_removals(t["events"], t["decisions"]),
            "v_unmatched_shreds": reports.unmatched_shreds(t["events"], t["decisions"]),
            "v_ambiguous_matches": reports.ambiguous_matches(t["decisions"]),
        }
