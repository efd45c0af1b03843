"""Search through the trigram index against the plain search, and facet counts."""

import pytest
from pyspark.sql import functions as F

from custody.operators import reports
from custody.plans import search_index
from custody.plans.search_index import PROBES, WORDS, SearchIndex
from custody.session import spread

ROWS = [
    (1, "a", "Dell Latitude 5400", "note"), (2, "b", "latitude", "DELL"), (3, "a", "de ll", None), (4, None, None, None),
    (5, "b", "", "50% off_now"), (6, "a", "\u00dcBERGR\u00d6SSE \U0001f600abc", ""), (7, "b", "ab", "cd"), (8, "a", "titude\nlat", "x\\y%z"),
    (None, "a", "latitude without id", "n"), (9, "a", "latitude " * 5000, "long"), (10, "b", "lati tude", "attitude"),
]
SEARCHES = [
    "latitude", "DELL lati", "de", "ab cd", "ll tude", "50%", "f_n", "\u00fcbergr\u00f6", "\U0001f600a", "x\\y", "zzz", "zzz de", "",
    "lat att", "note dell 5400", " ".join("dell latitude"[i:j] for i in range(4) for j in range(i + 3, i + 10)),
]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, "id INT, kind STRING, title STRING, note STRING").withColumn("id", F.col("id").cast("bigint"))
    index = SearchIndex(spark, str(tmp_path_factory.mktemp("search")), "id", ["title", "note"], buckets=4)
    index.add(rows.where("id <= 5"), "one")
    index.add(rows.where("id > 5 OR id IS NULL"), "two")
    index.add(rows.where("id > 5 OR id IS NULL"), "two")
    index.add(rows.where("id > 8"), "again")
    return rows, index


@pytest.mark.parametrize("text", SEARCHES)
def test_equals_the_plain_search(indexed, text):
    rows, index = indexed
    ids = lambda df: sorted(r.id for r in df.where("id IS NOT NULL").collect())
    assert ids(index.search(rows, text)) == ids(reports.search(rows, None, text, ["title", "note"]))
    assert ids(index.search(rows, text, {"kind": ["a"]})) == ids(reports.search(rows, {"kind": ["a"]}, text, ["title", "note"]))


def test_few_buckets_are_read(indexed):
    _, index = indexed
    plan = index.candidates({"5400": ["540"]})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(gram), EqualTo(gram,540)]" in plan


def test_probes_are_bounded(indexed):
    _, index = indexed
    probes = index.probes(SEARCHES[-1])
    assert 0 < len(probes) <= WORDS and all(0 < len(gs) <= PROBES for gs in probes.values())
    assert index.probes("zzz") is None and index.probes("de") == {}


def test_a_batch_without_counts_is_not_searched(spark, tmp_path):
    rows = spark.createDataFrame([(1, "abcdef")], "id BIGINT, t STRING")
    index = SearchIndex(spark, str(tmp_path), "id", ["t"], buckets=2)
    assert index.search(rows, "abc").count() == 0
    index.add(rows.limit(0), "none")
    index.add(rows, "stopped")
    fs, marker = index._fs(f"{tmp_path}/grams/batch=stopped/_SUCCESS")
    fs.delete(marker, False)
    assert index.batches() == ["none"] and index.search(rows, "abc").count() == 0
    index.add(rows, "stopped")
    assert index.search(rows, "abc").count() == 1


def test_facet_counts(spark):
    rows = spark.createDataFrame([("x", 1), ("x", None), (None, 1)], "a STRING, b INT")
    got = {tuple(r) for r in reports.facet_counts(rows, ["a", "b"]).collect()}
    assert got == {("a", "x", 2), ("a", None, 1), ("b", "1", 2), ("b", None, 1)}
    assert reports.facet_counts(rows.limit(0), ["a"]).count() == 0
    with pytest.raises(ValueError):
        reports.facet_counts(rows, [])


def test_texts_are_dealt_before_their_trigrams_are_read(spark, tmp_path, monkeypatch):
    dealt = []
    monkeypatch.setattr(search_index, "spread", lambda df: dealt.append(spread(df)) or dealt[-1])
    spark.createDataFrame(ROWS, "id INT, kind STRING, title STRING, note STRING").coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    index = SearchIndex(spark, str(tmp_path / "index"), "id", ["title", "note"], "INT", buckets=2)
    index.add(rows, "one")
    assert [(df.columns, df.rdd.getNumPartitions()) for df in dealt] == [(["id", "title", "note"], spark.sparkContext.defaultParallelism)]
    assert {r.id for r in index.search(rows, "latitude").collect()} == {1, 2, 9}
