"""Removed-before-scan pairs: import, counters, resolution against assets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.functions.serials import tracker_serial
from custody.functions.text import append_note
from custody.operators import merge, skew
from custody.operators.bronze import at

SUSPECT_NOTE = "this drive serial is on other assets too (check the scan)"
PAIR = ["computer_serial", "drive_serial"]


def normalise_pairs(lines: DataFrame, fold_unicode: bool = True) -> DataFrame:
    """Normalise both serials of raw pair rows and mark rows missing one of them."""
    return lines.withColumns(
        {c: tracker_serial(c, fold_unicode) for c in PAIR}
    ).withColumn("is_error", (F.col("computer_serial") == "") | (F.col("drive_serial") == ""))


def first_pair_errors(pairs: DataFrame, n: int = 10) -> DataFrame:
    return (
        pairs.filter("is_error").select("source", "row_index", "raw_line").orderBy("source", "row_index").limit(n)
    )


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Sightings per pair in this import, combined in each task before the shuffle."""
    return pairs.filter("NOT is_error").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("seen"))


def upsert_links(links: DataFrame, counted: DataFrame, batch_id: str, run_ts: datetime | Column) -> DataFrame:
    changes = counted.select(
        *PAIR,
        F.col("seen").alias("seen_count"),
        F.lit(batch_id).alias("last_batch"),
        at(run_ts).alias("first_seen_at"),
        at(run_ts).alias("last_seen_at"),
        F.lit(False).alias("flagged_suspect"),
        F.lit("").alias("flag_note"),
    )
    return merge.upsert(
        links, changes, PAIR,
        {
            "seen_count": merge.add,
            "last_batch": merge.replace,
            "last_seen_at": merge.replace,
            "first_seen_at": merge.keep,
            "flagged_suspect": merge.keep,
            "flag_note": merge.keep,
        },
    )


def import_statistics(pairs: DataFrame, counted: DataFrame, links_before: DataFrame) -> DataFrame:
    """total / imported / duplicate / error rows of one import, as one row."""
    known = links_before.select(*PAIR, F.lit(1).alias("known"))
    fresh = F.when(F.col("known").isNull(), 1).otherwise(0)
    by_pair = counted.join(known, PAIR, "left").agg(
        F.coalesce(F.sum(fresh), F.lit(0)).cast("bigint").alias("imported_rows"),
        F.coalesce(F.sum(F.col("seen") - fresh), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )
    rows = pairs.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if("is_error").alias("error_rows")
    )
    return side_by_side(rows, by_pair).select(
        "total_rows", "imported_rows", "duplicate_rows", "error_rows"
    )


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """One-row results with different columns as one row, without a cross join."""
    stacked = one_row[0]
    for more in one_row[1:]:
        stacked = stacked.unionByName(more, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def newest_asset_per_serial(assets: DataFrame) -> DataFrame:
    """The asset each computer serial resolves to: the newest one carrying it."""
    return (
        assets.select(
            "asset_tag", "created_at", tracker_serial("computer_serial").alias("computer_serial")
        )
        .filter("computer_serial <> ''")
        .groupBy("computer_serial")
        .agg(F.max_by("asset_tag", F.struct("created_at", "asset_tag")).alias("asset_tag"))
    )


def resolvable(links: DataFrame, targets: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Links joined with their asset: (pair, asset_tag); ``targets`` holds one row per computer serial.

    A serial on several assets (a board maker's placeholder, say) resolves to the newest of
    them, so the output is at most the links; ``shared_serials`` lists the others.
    """
    pairs = links.select(*PAIR).filter("drive_serial <> ''")
    return skew.join_unique(pairs, targets, "computer_serial", hot_rows=hot_rows)


def shared_serials(assets: DataFrame) -> DataFrame:
    """Computer serials that more than one asset carries, with how many do."""
    return (
        assets.select(tracker_serial("computer_serial").alias("computer_serial"), "asset_tag")
        .filter("computer_serial <> ''")
        .groupBy("computer_serial").agg(F.count(F.lit(1)).alias("assets"))
        .filter("assets > 1")
    )


def resolve_drives(drives: DataFrame, resolved: DataFrame, run_ts: datetime | Column) -> DataFrame:
    """Add missing drives as removed before the scan; move only ``present`` ones there."""
    changes = (
        resolved.select("asset_tag", F.col("drive_serial").alias("serial")).distinct()
        .withColumns(
            {
                "status": F.lit("removed_before_scan"),
                "source": F.lit("spreadsheet"),
                "logicalname": F.lit(""),
                "model": F.lit(""),
                "status_note": F.lit(""),
                "status_at": at(run_ts),
            }
        )
    )

    def stamp(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
        moved = incoming & (~stored | (F.col("__old_status") == "present"))
        return F.when(moved, new).otherwise(old)

    return merge.upsert(
        drives, changes, ["asset_tag", "serial"],
        {
            "status": merge.guarded("present"),
            "status_at": stamp,
            "source": merge.keep,
            "logicalname": merge.keep,
            "model": merge.keep,
            "status_note": merge.keep,
        },
    )


def suspect_serials(drives: DataFrame) -> DataFrame:
    """Drive serials on more than one asset, found without joining the table to itself."""
    return (
        drives.groupBy("serial")
        .agg(F.min("asset_tag").alias("a"), F.max("asset_tag").alias("b"))
        .filter("a <> b")
        .select("serial")
    )


def case_twins(drives: DataFrame) -> DataFrame:
    """Drives of one asset whose serials differ only in letter case or spacing."""
    return (
        drives.groupBy("asset_tag", tracker_serial("serial").alias("serial_norm"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
    )


def resolve_links(
    links: DataFrame, resolved: DataFrame, drives_after: DataFrame, run_ts: datetime | Column
) -> DataFrame:
    """Resolution columns of the links; suspects are looked up after all drives exist.

    The flag is set and never cleared, and the note is added once.
    """
    suspects = suspect_serials(drives_after).select(
        F.col("serial").alias("drive_serial"), F.lit(True).alias("__suspect")
    )
    changes = skew.join_unique(resolved, suspects, "drive_serial", "left", counted=links).select(
        *PAIR,
        F.col("asset_tag").alias("resolved_asset"),
        F.concat_ws("|", "asset_tag", "drive_serial").alias("resolved_drive"),
        at(run_ts).alias("resolved_at"),
        at(run_ts).alias("last_seen_at"),
        F.coalesce("__suspect", F.lit(False)).alias("flagged_suspect"),
        F.lit(None).cast("string").alias("flag_note"),
    )

    def note(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
        suspect = F.coalesce(F.col("__new_flagged_suspect"), F.lit(False))
        return F.when(suspect, append_note(old, SUSPECT_NOTE)).otherwise(old)

    return merge.upsert(
        links, changes, PAIR,
        {
            "resolved_asset": merge.replace,
            "resolved_drive": merge.replace,
            "resolved_at": merge.replace,
            "last_seen_at": merge.replace,
            "flagged_suspect": merge.either,
            "flag_note": note,
        },
    )


def resolution_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("asset_tag").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("resolved_assets"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("resolved_drives"),
    )


def import_record(
    statistics: DataFrame, batch_id: str, run_ts: datetime | Column, user: str,
    filename: str = "", manual_text: str = "", note: str = "",
) -> DataFrame:
    """The audit row of one import session."""
    return statistics.select(
        F.lit(batch_id).alias("batch_id"),
        at(run_ts).alias("created_at"),
        F.lit(user).alias("created_by"),
        F.lit(filename).alias("filename"),
        F.lit(manual_text).alias("manual_text"),
        F.lit(note).alias("note"),
        "total_rows", "imported_rows", "duplicate_rows", "error_rows",
    )

