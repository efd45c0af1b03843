"""Raw layer: row identity, idempotent append and its counters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from custody import schemas
from custody.functions.hashing import key_hash, payload_hash
from custody.functions.text import alias_pick, as_col
from custody.functions.times import parse_timestamp

# Provenance defaults and the columns a row time is read from.
SOURCE_SYSTEM = "google_sheets"
SCHEMA_VERSION = "v1"
TIMESTAMP_COLUMNS = ["Timestamp", "timestamp"]


def at(run_ts: datetime | Column) -> Column:
    return run_ts if isinstance(run_ts, Column) else F.lit(run_ts).cast("timestamp")


def row_key(sheet_id: Column | str, tab: Column | str, row_number: Column | str) -> Column:
    return F.concat_ws(":", as_col(sheet_id), as_col(tab), as_col(row_number).cast("string"))


def to_bronze(rows: DataFrame, run_ts: datetime | Column, source_system: str = SOURCE_SYSTEM) -> DataFrame:
    """Raw events from rows of (source_sheet_id, source_tab, row_number, payload)."""
    keyed = rows.select(
        F.lit(source_system).alias("source_system"),
        "source_sheet_id",
        "source_tab",
        row_key("source_sheet_id", "source_tab", "row_number").alias("source_row_key"),
        parse_timestamp(alias_pick("payload", TIMESTAMP_COLUMNS)).alias("source_timestamp"),
        "payload",
        payload_hash("payload").alias("payload_hash"),
    )
    return keyed.select(
        key_hash(*schemas.BRONZE_KEY).alias("event_id"),
        "*",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        at(run_ts).alias("ingested_at"),
    )


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is neither repeated in the load nor stored already.

    ``dropDuplicates`` combines inside each task first, so a key that fills a
    third of the load shrinks to one row per task before the shuffle.
    """
    return incoming.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def append_new(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Idempotent append: the bronze rows still to be written.

    The sheet id, which the event id depends on, is part of the key, so that a table
    partitioned by it can be pruned by the load's sheets where Spark sees fit.
    """
    return new_rows(incoming, stored, ["source_sheet_id", "event_id"])


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Attach a row counter that is filled by whatever job writes the frame."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def append_report(incoming: DataFrame, stored: DataFrame, by: str, key: list[str]) -> DataFrame:
    """Inserted and duplicate counts per source, with a total row (source NULL).

    Works on keys only: rows per (source, key) are counted before the stored
    side is consulted, so neither payloads nor repeated rows are shuffled.
    """
    per_key = incoming.groupBy(by, *[k for k in key if k != by]).agg(F.count(F.lit(1)).alias("n"))
    known = stored.select(*key).distinct().withColumn("known", F.lit(True))
    marked = per_key.join(known, key, "left")
    fresh = F.when(F.col("known").isNull(), 1).otherwise(0)
    return marked.rollup(by).agg(
        F.sum(fresh).cast("bigint").alias("inserted"),
        F.sum(F.col("n") - fresh).cast("bigint").alias("duplicates"),
    )


def latest_per_row_key(bronze: DataFrame) -> DataFrame:
    """Optional filter: only the newest version of every source row."""
    newest = bronze.groupBy("source_row_key").agg(
        F.max_by("event_id", F.struct("ingested_at", "event_id")).alias("event_id")
    )
    return bronze.join(newest.select("event_id"), "event_id", "left_semi")
