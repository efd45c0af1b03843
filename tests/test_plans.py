"""What the physical plans must and must not contain."""

import os
from functools import reduce

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from custody import schemas
from custody.operators import bundles
from custody.session import spread
from custody.workload import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")
LAZY = sorted(n for n in catalog.QUERIES if not n.startswith("stream_") and n not in ("csv_source", "pair_files", "pipeline_counts", "pair_import_flow", "bundle_load", "bundle_rows"))


def plan(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().explainString(
        spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ("norm_serial_text", "resolve_drives", "resolve_links", "resolution_counts", "case_twins"):
        assert "ArrowEvalPython" not in text
    assert "BatchEvalPython" not in text and "MapInPandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "point_lookup")
    assert "EqualTo(o_orderpriority,1-URGENT)" in text
    assert "o_totalprice" not in text.split("ReadSchema:")[1].splitlines()[0]
    assert "EqualTo(user_id,7)" in plan(spark, "recent_touches")
    assert "ReadSchema: struct<o_custkey" in plan(spark, "scans_per_asset")


def test_reports_take_top_k(spark):
    for name in ["recent_assets", "recent_scans", "asset_list", "bulk_errors", "pair_errors"]:
        assert "TakeOrderedAndProject" in plan(spark, name)


def test_trees_need_no_shuffle_by_key(spark):
    for name in ["tree_nodes", "tree_lists", "tree_summary", "hardware_card", "scan_health"]:
        assert "hashpartitioning" not in plan(spark, name)


def test_pairing_combines_before_the_shuffle(spark):
    text = plan(spark, "match_decisions")
    assert "partial_count" in text or "Partial" in text or text.count("Aggregate") >= 4


def test_spread_deals_rows_however_many_splits_there_are(spark, tmp_path):
    rows = spark.range(1000)
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    lopsided = reduce(lambda a, b: a.union(b), [one] + [one.where("id < 0")] * 40)  # splits enough, all rows in one of them
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes(spread(lopsided, rows=50))) <= 60
    assert spread(one, rows=50).rdd.getNumPartitions() == 20
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_tool_texts_of_few_narrow_rows_are_read_by_all_tasks(spark):
    for name in ["battery_fields", "smart_fields", "panel_fields"]:
        assert "RoundRobinPartitioning" in plan(spark, name)


def test_documents_are_not_parsed_again_by_a_filter(spark, tmp_path):
    docs = spark.createDataFrame([("A", "A.json", "{}")], "asset_tag string, file_name string, raw string")
    docs.write.parquet(str(tmp_path / "docs"))
    done = bundles.classify(spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame([], schemas.SCAN))
    steps = done._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("parseJson" in step for step in steps)
    assert not [step for step in steps if "Filter" in step and "parseJson" in step]
