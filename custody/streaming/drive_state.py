"""Running state per drive with expiry: keyed state instead of a stored table.

``running_sides`` keeps, for every drive of an event stream, how many removals and shreds were
seen and when the last one happened, in Spark's state store. A drive that sees no event for
``idle`` of event time leaves the state; its last row says so (``left``), so that a sink keeps
what the state forgets. Rows go out for changed drives only.

A call of Python costs some 2 ms whatever it holds, so drives are dealt by hash to a fixed number
of groups: the state has a row a group, with its drives in arrays, and a timer for the drive that
is due first. Counters are exact also after a restart from the checkpoint, as the state is restored
with the stream's offsets. Rows of one drive of one micro-batch meet in one task, which adds them
up Arrow batch by Arrow batch; where one drive may fill a micro-batch and nothing has to expire,
``polling.side_counts`` combines inside each task first.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from custody.operators.gold import REMOVED, SHREDDED

SIDES = "serial_norm STRING, removed_count BIGINT, shredded_count BIGINT, last_event_at TIMESTAMP, left BOOLEAN"
# Of a group: one entry a drive in each array; ``due_ms`` is when the drive leaves.
STATE = "serials ARRAY<STRING>, removed ARRAY<BIGINT>, shredded ARRAY<BIGINT>, last_ms ARRAY<BIGINT>, due_ms ARRAY<BIGINT>"


def running_sides(events: DataFrame, idle: timedelta = timedelta(days=365), late: str = "0 seconds", groups: int = 4096) -> DataFrame:
    """Changed drives of a stream of (serial_norm, event_type, event_time), in update mode.

    ``late`` is how far behind the newest event an event may come; older ones are not seen.
    A drive whose events all are forgotten starts again from zero: choose ``idle`` longer
    than a partner may take. ``groups`` belongs to the checkpoint: a stream keeps the number
    that it was begun with.
    """
    idle_ms = int(idle.total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        drives = {serial: row for serial, *row in zip(*state.get, strict=True)} if state.exists else {}
        changed = set()
        for part in () if state.hasTimedOut else parts:
            sums = part.groupby("serial_norm", dropna=False).agg({"removed_count": "sum", "shredded_count": "sum", "last_ms": "max"})
            for serial, removed, shredded, last in zip(sums.index, *[sums[c].tolist() for c in sums.columns], strict=True):
                serial = serial if isinstance(serial, str) else None
                old = drives.get(serial, (0, 0, last))
                last = max(old[2], last)
                drives[serial] = (old[0] + removed, old[1] + shredded, last, max(last + idle_ms, mark + 1))
                changed.add(serial)
        # drives of this micro-batch are due after its watermark
        gone = {serial for serial, row in drives.items() if row[3] < mark}
        rows = [(serial, *drives[serial][:3], serial in gone) for serial in [*changed, *gone]]
        for serial in gone:
            del drives[serial]
        if drives:
            columns = list(zip(*drives.values(), strict=True))
            state.update((list(drives), *[list(c) for c in columns]))
            state.setTimeoutTimestamp(min(columns[3]))
        elif state.exists:
            state.remove()
        if rows:
            serials, removed, shredded, last, left = zip(*rows, strict=True)
            yield pd.DataFrame(
                {
                    "serial_norm": pd.Series(serials, dtype=object), "removed_count": removed, "shredded_count": shredded,
                    "last_event_at": pd.to_datetime(list(last), unit="ms"), "left": left,
                }
            )

    per_event = events.select(
        F.pmod(F.hash("serial_norm"), F.lit(groups)).alias("group"), "serial_norm", "event_time",
        F.when(F.col("event_type") == REMOVED, 1).otherwise(0).cast("bigint").alias("removed_count"),
        F.when(F.col("event_type") == SHREDDED, 1).otherwise(0).cast("bigint").alias("shredded_count"),
        F.coalesce(F.unix_millis("event_time"), F.lit(0).cast("bigint")).alias("last_ms"),
    ).withWatermark("event_time", late)
    return per_event.groupBy("group").applyInPandasWithState(step, SIDES, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def final_sides(updates: DataFrame) -> DataFrame:
    """The last row of every drive among the stream's written updates; counts only grow until a drive leaves."""
    order = F.struct("last_event_at", F.col("removed_count") + F.col("shredded_count"), "left")
    last = updates.groupBy("serial_norm").agg(F.max_by(F.struct("removed_count", "shredded_count", "last_event_at", "left"), order).alias("last"))
    return last.select("serial_norm", "last.*")
