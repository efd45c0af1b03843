"""A key holding a third of all rows: results stay whole and Spark splits its partition."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from custody.operators import gold, links, matching, skew

AT = datetime(2024, 6, 1)
N = 200_000


def hot_links(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("PC-HOT")).otherwise(F.concat(F.lit("PC"), F.col("id") % 5000))
    return spark.range(0, N, 1, 8).select(
        key.alias("computer_serial"), F.concat(F.lit("D"), F.col("id")).alias("drive_serial")
    )


def test_hot_computer_serial_is_not_shuffled(spark):
    targets = hot_links(spark).groupBy("computer_serial").agg(F.max(F.concat(F.lit("A-"), "computer_serial")).alias("asset_tag"))
    joined = links.resolvable(hot_links(spark), targets, hot_rows=10_000)
    counts = {r.asset_tag: r["count"] for r in joined.groupBy("asset_tag").count().collect()}
    assert counts["A-PC-HOT"] == (N + 2) // 3 and sum(counts.values()) == N and len(counts) == 5001
    plain = hot_links(spark).join(targets, "computer_serial").select(*joined.columns)
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_rows", [0, 3, 10**6])
def test_join_unique_equals_the_plain_join(spark, how, hot_rows):
    facts = spark.range(100).select((F.sqrt("id").cast("int")).alias("k"), "id")
    unique = spark.range(0, 20, 3).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("v"))
    got = skew.join_unique(facts, unique, "k", how, hot_rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, facts.join(unique, "k", how).collect()))


def test_hot_drive_is_combined_in_each_task(spark):
    events = spark.range(0, N, 1, 8).select(
        F.lpad(F.col("id").cast("string"), 8, "0").alias("drive_event_id"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("S"), F.col("id") % 50_000)).alias("serial_norm"),
        F.when(F.col("id") % 2 == 0, gold.REMOVED).otherwise(gold.SHREDDED).alias("event_type"),
        F.timestamp_seconds(F.col("id") % 1000).alias("event_time"),
    )
    drives = events.select("serial_norm").distinct()
    hot = matching.decide(drives, events, AT).filter("serial_norm = 'HOT'").first()
    removed = (N // 3 + 2) // 2
    assert hot.decision == "AMBIGUOUS" and hot.reason.startswith(f"{removed} removals")
    assert (hot.removed_event_id, hot.shredded_event_id) == ("00000000", "00002001")
