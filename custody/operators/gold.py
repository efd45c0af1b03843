"""Promotion of valid staged rows to drives, batches and lifecycle events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.functions.hashing import key_hash
from custody.functions.text import non_blank
from custody.operators import merge
from custody.operators.bronze import at

REMOVED, SHREDDED = "REMOVED", "SHREDDED"


def unpromoted(staged: DataFrame, *events: DataFrame) -> DataFrame:
    """Valid staged rows whose raw event has no lifecycle event of any type."""
    rows = staged.filter("is_valid")
    for e in events:
        rows = rows.join(e.select(F.col("source_event_id").alias("event_id")), "event_id", "left_anti")
    return rows


def shred_events(rows: DataFrame, run_ts: datetime | Column) -> DataFrame:
    return _events(
        rows.filter("serial_norm <> ''"), SHREDDED, "serial_norm", run_ts,
        batch_id=non_blank("batch_id"), computer_serial=F.lit(""), notes=F.lit(""),
    )


def removal_events(rows: DataFrame, run_ts: datetime | Column) -> DataFrame:
    return _events(
        rows.filter("drive_serial_norm <> ''"), REMOVED, "drive_serial_norm", run_ts,
        batch_id=F.lit(None).cast("string"),
        computer_serial=F.col("computer_serial_norm"), notes=F.col("notes"),
    )


def _events(rows, event_type, serial, run_ts, *, batch_id, computer_serial, notes) -> DataFrame:
    return rows.select(
        key_hash("event_id", F.lit(event_type)).alias("drive_event_id"),
        F.col(serial).alias("serial_norm"),
        F.lit(event_type).alias("event_type"),
        F.coalesce("event_time", at(run_ts)).alias("event_time"),
        F.col("event_id").alias("source_event_id"),
        batch_id.alias("batch_id"),
        "client",
        computer_serial.alias("computer_serial"),
        notes.alias("notes"),
        at(run_ts).alias("created_at"),
    )


def upsert_drives(drives: DataFrame, new_events: DataFrame, run_ts: datetime | Column) -> DataFrame:
    """First sight sets both times, every later sight only the last one."""
    seen = (
        new_events.select("serial_norm").distinct()
        .withColumns({"first_seen_at": at(run_ts), "last_seen_at": at(run_ts)})
    )
    return merge.upsert(
        drives, seen, ["serial_norm"],
        {"first_seen_at": merge.keep, "last_seen_at": merge.replace},
    )


def last_non_blank(value: str, order: Column) -> Column:
    """Latest non-blank value of a text column within a group."""
    return F.max_by(non_blank(value), F.when(non_blank(value).isNotNull(), order)).alias(value)


def batch_changes(rows: DataFrame, run_ts: datetime | Column) -> DataFrame:
    """One row per batch: each column's latest non-blank value in this load."""
    order = F.struct(F.coalesce("event_time", at(run_ts)), F.col("event_id"))
    return (
        rows.filter("serial_norm <> '' AND batch_id <> ''")
        .groupBy("batch_id")
        .agg(
            F.max_by("batch_date", F.when(F.col("batch_date").isNotNull(), order)).alias("batch_date"),
            last_non_blank("client", order),
            last_non_blank("location", order),
            last_non_blank("tech", order),
        )
        .na.fill("", ["client", "location", "tech"])
        .withColumns({"first_seen_at": at(run_ts), "last_seen_at": at(run_ts)})
    )


def upsert_batches(batches: DataFrame, rows: DataFrame, run_ts: datetime | Column) -> DataFrame:
    return merge.upsert(
        batches, batch_changes(rows, run_ts), ["batch_id"],
        {
            "batch_date": merge.prefer_present,
            "client": merge.prefer_non_blank,
            "location": merge.prefer_non_blank,
            "tech": merge.prefer_non_blank,
            "first_seen_at": merge.keep,
            "last_seen_at": merge.replace,
        },
    )


@dataclass(frozen=True)
class Promotion:
    drives: DataFrame
    batches: DataFrame
    new_events: DataFrame
    skipped_blank: DataFrame


def promote(
    shreds: DataFrame,
    removals: DataFrame,
    drives: DataFrame,
    batches: DataFrame,
    events: DataFrame,
    run_ts: datetime | Column,
) -> Promotion:
    """Next drives and batches, the events to append, and rows skipped for a blank serial.

    Shreds go first: a raw event staged on both routes becomes a shred only.
    """
    new_shreds = unpromoted(shreds, events)
    shredded = shred_events(new_shreds, run_ts)
    new_removals = unpromoted(removals, events, shredded)
    removed = removal_events(new_removals, run_ts)
    new_events = shredded.unionByName(removed)
    skipped = (
        new_shreds.filter("serial_norm = ''").select("event_id", F.lit(SHREDDED).alias("event_type"))
        .unionByName(
            new_removals.filter("drive_serial_norm = ''")
            .select("event_id", F.lit(REMOVED).alias("event_type"))
        )
    )
    return Promotion(
        drives=upsert_drives(drives, new_events, run_ts),
        batches=upsert_batches(batches, new_shreds, run_ts),
        new_events=new_events,
        skipped_blank=skipped,
    )
