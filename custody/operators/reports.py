"""Reporting views, counts, facets and top-k lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.operators.gold import REMOVED, SHREDDED


def drive_lifecycle(drives: DataFrame, events: DataFrame) -> DataFrame:
    """Removal time, shred time, batch and client per drive; drives without events stay.

    Events are reduced to one row per serial before the join, so both join sides
    are unique. Every event's batch exists by construction (see ``quality``), so
    the batch table need not be read for its id.
    """
    removed, shredded = F.col("event_type") == REMOVED, F.col("event_type") == SHREDDED
    per_drive = events.groupBy("serial_norm").agg(
        F.min(F.when(removed, F.col("event_time"))).alias("removal_time"),
        F.min(F.when(shredded, F.col("event_time"))).alias("shred_time"),
        F.max(F.when(shredded, F.col("batch_id"))).alias("batch_id"),
        F.max("client").alias("client"),
    )
    return drives.select("serial_norm").join(per_drive, "serial_norm", "left")


def _undecided_side(events: DataFrame, decisions: DataFrame, event_type: str, ref: str) -> DataFrame:
    # Joined on the event id, unique on both sides: no serial can skew it.
    refs = decisions.filter((F.col("decision") == "NO_MATCH") & F.col(ref).isNotNull()).select(
        F.col(ref).alias("drive_event_id")
    )
    return events.filter(F.col("event_type") == event_type).join(refs, "drive_event_id", "left_semi")


def unmatched_removals(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Removals never followed by a shred."""
    return _undecided_side(events, decisions, REMOVED, "removed_event_id").select(
        F.col("drive_event_id").alias("event_id"), "serial_norm",
        F.col("event_time").alias("removal_time"), "computer_serial", "client", "notes",
    )


def unmatched_shreds(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Shreds without a removal on record."""
    return _undecided_side(events, decisions, SHREDDED, "shredded_event_id").select(
        F.col("drive_event_id").alias("event_id"), "serial_norm",
        F.col("event_time").alias("shred_time"), "batch_id", "client",
    )


def ambiguous_matches(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("decision") == "AMBIGUOUS").select(
        "decision_id", "serial_norm", "confidence", "reason", "decided_at"
    )


# Report edge only: newest first, with the id as tie-break so a busy instant
# still range-partitions.
VIEW_ORDER = {
    "v_drive_lifecycle": [F.asc, "serial_norm"],
    "v_unmatched_removals": [F.desc, "removal_time", "event_id"],
    "v_unmatched_shreds": [F.desc, "shred_time", "event_id"],
    "v_ambiguous_matches": [F.desc, "decided_at", "decision_id"],
}


def ordered(view: DataFrame, name: str) -> DataFrame:
    direction, first, *ties = VIEW_ORDER[name]
    return view.orderBy(direction(first), *ties)


def register_views(drives: DataFrame, events: DataFrame, decisions: DataFrame) -> None:
    """Make the four reports available to SQL as temporary views."""
    drive_lifecycle(drives, events).createOrReplaceTempView("v_drive_lifecycle")
    unmatched_removals(events, decisions).createOrReplaceTempView("v_unmatched_removals")
    unmatched_shreds(events, decisions).createOrReplaceTempView("v_unmatched_shreds")
    ambiguous_matches(decisions).createOrReplaceTempView("v_ambiguous_matches")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One (name, rows) line per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def duplicate_hashes(scans: DataFrame, hash_col: str = "bundle_hash") -> DataFrame:
    """Content hashes stored more than once."""
    return (
        scans.filter(F.col(hash_col).isNotNull())
        .groupBy(hash_col)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def children_per_parent(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Child count per parent, zero kept. Children are counted before the join."""
    counted = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counted, key, "left").na.fill(0, [name])


def latest_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row per key as an aggregate, which combines before the shuffle."""
    return (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
        .select("__row.*")
    )


def newest(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Top-k report."""
    return df.orderBy(*order).limit(n)


def with_lookup(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Columns of a dimension beside each row; unknown keys keep NULLs."""
    return df.join(dimension, key, "left")


def find_by(df: DataFrame, column: str, value: str, newest_first: list[Column]) -> DataFrame:
    """Exact lookup, newest first."""
    wanted = value.strip()
    if not wanted:
        raise ValueError("a value to look up is required")
    return df.filter(F.col(column) == wanted).orderBy(*newest_first)


def search(
    df: DataFrame,
    facets: dict[str, list] | None = None,
    text: str | None = None,
    text_columns: list[str] | None = None,
) -> DataFrame:
    """Facet filter (every named column must hold one of its values) and text search.

    Each word of the text must occur, ignoring case, in at least one text column.
    """
    for column, values in (facets or {}).items():
        df = df.filter(F.col(column).isin(values))
    for word in (text or "").split():
        escaped = word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        hits = [F.coalesce(F.col(c).ilike(f"%{escaped}%"), F.lit(False)) for c in text_columns or []]
        df = df.filter(reduce(lambda a, b: a | b, hits))
    return df


def facet_counts(df: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, rows): rows for each value of every facet, nulls too, all in one pass."""
    if not facets:
        raise ValueError("a facet to count is required")
    counted = df.groupingSets([[c] for c in facets], *facets).agg(
        F.grouping_id(*facets).alias("__set"), F.count(F.lit(1)).alias("rows")
    )
    # the id has a bit for each facet left out, the first facet's highest
    every = (1 << len(facets)) - 1
    out = [every - (1 << (len(facets) - 1 - i)) for i in range(len(facets))]
    pick = lambda values: F.coalesce(*[F.when(F.col("__set") == n, v) for n, v in zip(out, values)])
    return counted.select(
        pick([F.lit(c) for c in facets]).alias("facet"),
        pick([F.col(c).cast("string") for c in facets]).alias("value"),
        "rows",
    )


def date_drilldown(df: DataFrame, column: str, unit: str = "month") -> DataFrame:
    """Rows per calendar unit."""
    return df.groupBy(F.date_trunc(unit, F.col(column)).alias("period")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def json_records(df: DataFrame) -> DataFrame:
    """Rows as JSON objects, NULL fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
