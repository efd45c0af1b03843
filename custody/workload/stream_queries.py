"""The same pipeline fed by a file stream; results equal the batch ones."""

from __future__ import annotations

from datetime import timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from custody.plans.incremental import IncrementalLedger
from custody.plans.ledger import Ledger
from custody.session import shared_dir
from custody.sinks.snapshots import TableStore
from custody.streaming import drive_state, polling
from custody.workload.adapters import RUN_1, SQL_EVENTS, SQL_ROWS, drive_events, sheet_rows
from custody.workload.ledger_queries import SQL_CONFIDENCE, SQL_PROMOTED, SQL_REASON, SQL_VERDICT
from custody.workload.registry import query, sql_ts, ts_text


def streamed(t):
    """The events table as a file stream, drained once."""
    source = polling.file_stream(t.spark, f"{t.folder}/events.parquet", t.events.schema)
    return SimpleNamespace(events=source, spark=t.spark)


def polled_ledger(t, label: str) -> Ledger:
    root = shared_dir(t.spark, label)
    ledger = Ledger(t.spark, f"{root}/tables")
    polling.poll(
        sheet_rows(streamed(t)), ledger, f"{root}/checkpoint", clock=lambda: RUN_1, once=True
    ).awaitTermination()
    return ledger


@query(
    "stream_ingest",
    f"""
    WITH {SQL_ROWS}
    SELECT event_id, kind || ':data:' || n AS source_row_key, {sql_ts("event_time")} AS source_timestamp, payload_hash FROM rows
    """,
)
def stream_ingest(t):
    rows = polled_ledger(t, "stream-ingest").bronze()
    return rows.select(
        "event_id", "source_row_key", ts_text("source_timestamp").alias("source_timestamp"), "payload_hash"
    )


@query(
    "stream_matching",
    f"""
    WITH {SQL_PROMOTED}
    SELECT serial_norm, {SQL_VERDICT} AS decision, {SQL_CONFIDENCE} AS confidence, {SQL_REASON} AS reason FROM sides
    """,
)
def stream_matching(t):
    return polled_ledger(t, "stream-matching").tables()["decisions"].select(
        "serial_norm", "decision", "confidence", "reason"
    )


@query(
    "stream_side_counts",
    f"""
    WITH {SQL_EVENTS}
    SELECT serial_norm, count(*) FILTER (kind = 'REMOVED') AS removed_count, count(*) FILTER (kind = 'SHREDDED') AS shredded_count
    FROM ev WHERE kind IS NOT NULL GROUP BY ALL
    """,
)
def stream_side_counts(t):
    root = shared_dir(t.spark, "side-counts")
    store = TableStore(t.spark, f"{root}/tables", {"side_counts": polling.SIDE_COUNTS})
    polling.keep_side_counts(
        drive_events(streamed(t)), store, f"{root}/checkpoint", once=True
    ).awaitTermination()
    return store.snapshot("side_counts").select(
        "serial_norm", F.col("removed_count"), F.col("shredded_count")
    )


# --- exports that arrive one after the other ----------------------------------------

QUARTERS, FILES = 4, 2  # of the day, and files an export has


def quarter(t, k: int):
    """The rows of one quarter of every day: most partners of a removal come with another export."""
    return sheet_rows(SimpleNamespace(events=t.events.where(F.expr("hour(ts) div 6") == k)))


def late_partners(t, mode: str) -> IncrementalLedger:
    """Four exports as a file stream, drained as four micro-batches."""
    root = shared_dir(t.spark, f"late-{mode}")
    for k in range(QUARTERS):
        quarter(t, k).repartition(FILES, "row_number").write.mode("append").parquet(f"{root}/exports")
    ledger = IncrementalLedger(t.spark, f"{root}/tables", buckets=8)
    stream = t.spark.readStream.schema(sheet_rows(t).schema).option("maxFilesPerTrigger", FILES).parquet(f"{root}/exports")
    polling.poll_changes(stream, ledger, f"{root}/checkpoint", clock=lambda: RUN_1, mode=mode, once=True).awaitTermination()
    return ledger


SQL_QUARTERS = f"""
    {SQL_PROMOTED},
    part AS (SELECT serial_norm, hour(ts) // 6 AS q, count(*) FILTER (event_type = 'REMOVED') AS r, count(*) FILTER (event_type = 'SHREDDED') AS s
             FROM good GROUP BY ALL),
    first_part AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY serial_norm ORDER BY q) = 1)
"""


@query(
    "stream_late_frozen",
    f"""
    WITH {SQL_QUARTERS}
    SELECT serial_norm, {SQL_VERDICT} AS decision, {SQL_CONFIDENCE} AS confidence, {SQL_REASON} AS reason FROM first_part
    """,
)
def stream_late_frozen(t):
    """A drive is decided by the export that it first comes with; a late partner changes nothing."""
    return late_partners(t, "frozen").store.read("decisions").select("serial_norm", "decision", "confidence", "reason")


@query(
    "stream_late_recompute",
    f"""
    WITH {SQL_QUARTERS}
    SELECT serial_norm, {SQL_VERDICT} AS decision, {SQL_CONFIDENCE} AS confidence, {SQL_REASON} AS reason, r AS removed_count, s AS shredded_count FROM sides
    """,
)
def stream_late_recompute(t):
    """A late partner has its drive decided anew, from the drive's stored counts."""
    store = late_partners(t, "recompute").store
    sides = store.read("sides").select("serial_norm", "removed_count", "shredded_count")
    return store.read("decisions").select("serial_norm", "decision", "confidence", "reason").join(sides, "serial_norm")


@query(
    "step_counters",
    f"""
    WITH {SQL_QUARTERS}
    SELECT 'export ' || q AS load, unnest(['bronze', 'duplicates', 'stg_shred', 'stg_removal', 'events', 'decisions']) AS step,
           unnest([count(*), 0, count(*) FILTER (kind = 'shred_log'), count(*) FILTER (kind = 'removal_log'),
                   (SELECT sum(r + s)::BIGINT FROM part p WHERE p.q = x.q), (SELECT count(*) FROM first_part p WHERE p.q = x.q)]) AS rows
    FROM (SELECT *, hour(ts) // 6 AS q FROM rows) x WHERE q < 2 GROUP BY q
    UNION ALL
    SELECT 'again', unnest(['bronze', 'duplicates', 'stg_shred', 'stg_removal', 'events', 'decisions']), unnest([0, count(*), 0, 0, 0, 0]) FROM rows WHERE hour(ts) // 6 = 1
    """,
)
def step_counters(t):
    """Rows of every step of two loads and of a repeated one."""
    ledger = IncrementalLedger(t.spark, shared_dir(t.spark, "steps"), buckets=8)
    for load, k in (("export 0", 0), ("export 1", 1), ("again", 1)):
        ledger.process(quarter(t, k), RUN_1, load)
    return ledger.store.read("steps")


IDLE_DAYS = 5


@query(
    "stream_drive_state",
    f"""
    WITH {SQL_EVENTS}
    SELECT serial_norm, count(*) FILTER (kind = 'REMOVED') AS removed_count, count(*) FILTER (kind = 'SHREDDED') AS shredded_count,
           max(ts) + INTERVAL {IDLE_DAYS} DAY < (SELECT max(ts) FROM ev WHERE kind IS NOT NULL) AS "left"
    FROM ev WHERE kind IS NOT NULL GROUP BY serial_norm
    """,
)
def stream_drive_state(t):
    """Counts kept as state over three stretches of time; the stream is stopped and restarted in between."""
    root = shared_dir(t.spark, "drive-state")
    events = drive_events(t).select("serial_norm", "event_type", "event_time")
    edges = ["2024-01-01", "2024-01-11", "2024-01-21", "2100-01-01"]
    for first, last in zip(edges, edges[1:], strict=False):
        stretch = events.where((F.col("event_time") < last) & ((F.col("event_time") >= first) | F.lit(first == edges[0])))
        stretch.write.mode("append").parquet(f"{root}/events")
        stream = t.spark.readStream.schema(events.schema).parquet(f"{root}/events")
        updates = drive_state.running_sides(stream, timedelta(days=IDLE_DAYS))
        writer = updates.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint")
        writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{root}/updates/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    return drive_state.final_sides(t.spark.read.parquet(f"{root}/updates")).select("serial_norm", "removed_count", "shredded_count", "left")
