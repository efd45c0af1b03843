"""The poll loop as a file stream feeding the same stored pipeline.

Each micro-batch runs the batch operators inside ``foreachBatch``. Appends are
anti-joined with what is stored, so a replayed batch adds nothing and no
deduplication state has to be kept.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from custody.operators import merge
from custody.plans.incremental import IncrementalLedger
from custody.plans.ledger import Ledger
from custody.sinks.snapshots import TableStore

# Fixed value: the default pull interval.
POLL_INTERVAL = "15 minutes"


def now() -> datetime:
    return datetime.now(timezone.utc)


def poll(
    rows: DataFrame,
    ledger: Ledger,
    checkpoint: str,
    clock: Callable[[], datetime] = now,
    mode: str = "frozen",
    once: bool = False,
) -> StreamingQuery:
    """Ingest, stage, promote and decide every micro-batch of a row stream.

    ``rows`` is a streaming frame of (source_sheet_id, source_tab, row_number,
    payload). ``once`` drains what is there and stops.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        run_ts = clock()
        ledger.ingest(batch, run_ts)
        ledger.run(run_ts, mode)

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL_INTERVAL)
    return writer.start()


def poll_changes(
    rows: DataFrame,
    ledger: IncrementalLedger,
    checkpoint: str,
    clock: Callable[[], datetime] = now,
    mode: str = "frozen",
    once: bool = False,
) -> StreamingQuery:
    """The same over a bucketed ledger: every micro-batch is a load, its work follows its own rows.

    A load is named after the stream and the batch, so a batch that is replayed after a stop
    completes what it began; a stream that lost its checkpoint has another name and finds
    all rows stored.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = spark.read.text(f"{checkpoint}/metadata").first()[0]
        ledger.process(batch, clock(), f"{json.loads(stream)['id']}-{batch_id:09d}", mode)

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL_INTERVAL)
    return writer.start()


def file_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet stream of a table folder, or of one file (a stream source wants its folder)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())


SIDE_COUNTS = "serial_norm STRING, removed_count BIGINT, shredded_count BIGINT"


def side_counts(events: DataFrame) -> DataFrame:
    """Running counts per drive of an event stream.

    Built-in stateful aggregation keeps two counters per drive; it combines inside
    each task first, so a drive with a huge history is no hot spot.
    """
    return events.groupBy("serial_norm").agg(
        F.count_if(F.col("event_type") == "REMOVED").alias("removed_count"),
        F.count_if(F.col("event_type") == "SHREDDED").alias("shredded_count"),
    )


def keep_side_counts(events: DataFrame, store: TableStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Continuous counterpart of the pairing step: only changed drives are upserted."""
    policies = {c: merge.replace for c in ["removed_count", "shredded_count"]}

    def handle(changed: DataFrame, batch_id: int) -> None:
        now_ = merge.upsert(
            store.snapshot("side_counts"), changed, ["serial_norm"], policies, small_changes=True
        )
        store.replace("side_counts", now_)

    writer = (
        side_counts(events).writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL_INTERVAL)
    return writer.start()
