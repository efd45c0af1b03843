"""Match decisions: does every removal have exactly one shred?

Rules are registered by version. A rule takes one row per drive with the event
counts and earliest event ids of both sides and adds decision, confidence, reason.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.functions.hashing import key_hash
from custody.operators.bronze import at
from custody.operators.gold import REMOVED, SHREDDED

# The first rule's version and its confidence levels.
STRICT_V1 = "strict_serial_v1"
CONFIDENCE = {"MATCH": "1.00", "NO_MATCH": "0.00", "AMBIGUOUS": "0.50"}

RULES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def rule(version: str):
    def register(fn):
        RULES[version] = fn
        return fn

    return register


def pair_sides(events: DataFrame) -> DataFrame:
    """Counts and earliest event per drive and side, in one aggregation.

    Only counters and two small picks are kept per drive, combined in each task
    before the shuffle, so a drive with a huge history costs no more than others.
    """
    when = F.struct("event_time", "drive_event_id")

    def side(event_type: str, prefix: str) -> list[Column]:
        here = F.col("event_type") == event_type
        return [
            F.count_if(here).alias(f"{prefix}_count"),
            F.min_by("drive_event_id", F.when(here, when)).alias(f"{prefix}_event_id"),
        ]

    return events.groupBy("serial_norm").agg(*side(REMOVED, "removed"), *side(SHREDDED, "shredded"))


@rule(STRICT_V1)
def strict_serial(paired: DataFrame) -> DataFrame:
    r, s = F.col("removed_count"), F.col("shredded_count")
    many = (r > 1) | (s > 1)
    one_each = (r == 1) & (s == 1)
    decision = F.when(many, "AMBIGUOUS").when(one_each, "MATCH").otherwise("NO_MATCH")
    levels = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    reason = (
        F.when(many, F.concat(r.cast("string"), F.lit(" removals and "), s.cast("string"),
                              F.lit(" shreds share this serial")))
        .when(one_each, F.lit("one removal paired with one shred"))
        .when(r == 1, F.lit("removed, no shred on record"))
        .when(s == 1, F.lit("shredded, no removal on record"))
        .otherwise(F.lit("no events on record"))
    )
    return paired.withColumn("decision", decision).withColumns(
        {
            "confidence": F.try_element_at(levels, F.col("decision")).cast("decimal(3,2)"),
            "reason": reason,
        }
    )


def decide(
    drives: DataFrame,
    events: DataFrame,
    run_ts: datetime | Column,
    decisions: DataFrame | None = None,
    mode: str = "frozen",
    version: str = STRICT_V1,
) -> DataFrame:
    """Decision rows for the drives.

    ``frozen``: only drives without a decision of this version get one, so the
    result is to be appended. ``recompute``: all drives are decided again and the
    result replaces this version's rows; unchanged ones keep ``decided_at``.
    """
    universe = drives.select("serial_norm")
    past = None if decisions is None else decisions.filter(F.col("rule_version") == version)
    if mode == "frozen" and past is not None:
        universe = universe.join(past.select("serial_norm"), "serial_norm", "left_anti")
        past = None
    paired = universe.join(pair_sides(events), "serial_norm", "left").na.fill(
        0, ["removed_count", "shredded_count"]
    )
    return decide_pairs(paired, run_ts, past, mode, version)


def decide_pairs(
    paired: DataFrame,
    run_ts: datetime | Column,
    past: DataFrame | None = None,
    mode: str = "frozen",
    version: str = STRICT_V1,
) -> DataFrame:
    """Decision rows of drives given with their counts and earliest events.

    ``past`` holds this version's stored decisions of these drives: with ``frozen``
    they stay and their drives get none, with ``recompute`` unchanged ones keep their time.
    """
    if mode not in ("frozen", "recompute"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "frozen" and past is not None:
        paired = paired.join(past.select("serial_norm"), "serial_norm", "left_anti")
    decided = RULES[version](paired).select(
        key_hash("serial_norm", F.lit(version)).alias("decision_id"),
        "serial_norm", "removed_event_id", "shredded_event_id", "decision",
        F.lit(version).alias("rule_version"), "confidence", "reason",
        at(run_ts).alias("decided_at"),
    )
    if mode == "frozen" or past is None:
        return decided
    earlier = past.select(
        "serial_norm",
        F.struct("decision", "removed_event_id", "shredded_event_id", "reason").alias("__was"),
        F.col("decided_at").alias("__when"),
    )
    same = F.col("__was").eqNullSafe(
        F.struct("decision", "removed_event_id", "shredded_event_id", "reason")
    )
    return (
        decided.join(earlier, "serial_norm", "left")
        .withColumn("decided_at", F.when(same, F.col("__when")).otherwise(F.col("decided_at")))
        .drop("__was", "__when")
    )
