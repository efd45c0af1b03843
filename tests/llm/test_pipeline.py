"""The corpus pipeline: each stage against brute force on what the stage before it kept."""

import os
import random

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_groups, brute_matches, documents

WORDS = [f"w{k}" for k in range(300)]


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(9)
    texts = [rng.choices(WORDS, k=rng.randrange(60, 200)) for _ in range(60)]
    passage = rng.choices(WORDS, k=70)
    items = [(k, " ".join(rng.choices(WORDS, k=25))) for k in range(3)]
    for k in range(5, 9):
        texts[k] = texts[k][:50] + passage + texts[k][50:]
    texts[20] = list(texts[3])
    texts[21] = [*texts[3][:-1], "edit"]
    texts[30][10:10] = items[0][1].split()
    for k in range(40, 60, 2):
        texts[k] += ["vilea", "vileb", "vilea", "vilec"] * 3
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(100, None), (101, ""), (None, "no id")]
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, int(k >= 40 and k % 2 == 0)) for k in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), items


def test_stages(spark, folder, tmp_path):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/out-{name}")
        rows = [(r.doc_id, r.text) for r in before.collect()]
        now = {r.doc_id: r.text for r in docs.collect()} if name != "packing" else {r.doc_id for r in docs.collect()}
        kept[name] = now
        if name == "minhash_dedup":
            groups = brute_groups([r for r in rows if r[0] is not None], 5, 80)
            assert set(now) == {i for i, (_, c) in groups.items() if i == c} | {None}
            assert not {20, 21} & set(now)
        if name == "substring_dedup":
            assert [k for k in range(5, 9) if "w" in now.get(k, "") and now[k] != dict(rows)[k]] == [k for k in range(6, 9) if k in now]
        if name == "decontamination":
            found = {d for d, _ in brute_matches(rows, items)}
            assert found and set(now) == {i for i, _ in rows} - found
        if name == "packing":
            assert now == {i for i, _ in rows}
    assert {100, 101, None} <= kept["packing"] and len(kept["toxicity"]) >= 45
    assert corpus_pipeline.run(spark, path).count() == docs.count()


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    empty = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0
    assert os.path.isdir(path)
