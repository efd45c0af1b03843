"""Language-model scores: counts and base against brute force, probabilities that add up, held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from custody.llm import mixing

CLASHING = ["item", "kind", "n", "block", "cells", "counts", "salt", "row", "tail", "learns", "h", "nats", "base"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit(c) for c in CLASHING})


def teaches(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def learning():
    return F.crc32(F.col("doc_id").cast("string")) % 10 != 0


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "on", "re", "ti", "É", "x", "Qu"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    return [" ".join(rng.choice(words[: rng.randrange(5, 400)]) for _ in range(rng.randrange(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    odd = [(500, None), (501, ""), (502, " \t\n"), (503, "solo"), (504, "漢字 かな"), (505, "the " * 20_000), (506, "never\x0bseen\x0cWORDS"), (None, "no id here"), (7, "again " * 30), (7, "and other words")]
    return list(enumerate(texts(400, 1))) + odd


@pytest.fixture(scope="module")
def scored(spark, rows):
    return mixing.score(documents(spark, rows), learning(), head=50).collect()


def test_counts_and_base_equal_brute_force(rows, scored):
    def split(t):
        return [w for w in (t or "").encode().lower().split()]

    counts, ends = Counter(), 0
    for i, t in rows:
        if teaches(i):
            counts.update(split(t))
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for i, t in rows:
        c = [counts[w] for w in split(t)] + [ends]
        base = sum(math.log10((n + 0.1) / (total + 0.1 * (kinds + 1))) for n in c)
        want.append((str(i), len(c), sum(n > 0 for n in c), round(base, 6)))
    got = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in scored]
    assert sorted(got) == sorted(want)
    assert {r["train_tokens"] for r in scored} == {total}


def test_scores_are_log_probabilities_that_gain_on_held_out_text(rows, scored):
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in scored)
    held = [r for r in scored if r["doc_id"] is not None and r["doc_id"] < 400 and not teaches(r["doc_id"])]
    plain = Counter(b"\n".join(b" ".join((t or "").encode().lower().split()) for _, t in rows[:400]))
    entropy = -sum(n * math.log2(n / plain.total()) for n in plain.values()) / plain.total()
    assert -sum(r["score"] for r in held) * math.log2(10) / sum(r["n_bytes"] for r in held) < 0.7 * entropy
    sizes = {i: len(b" ".join((t or "").encode().lower().split())) + 1 for i, t in rows if i != 7}
    assert all(r["n_bytes"] == sizes[r["doc_id"]] for r in scored if r["doc_id"] != 7)
    for r in scored:
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / r["n_bytes"])


def small_model():
    rng = np.random.default_rng(3)
    frequency = rng.integers(0, 1000, 256).astype(float)
    shape = mixing.tree(frequency, rng.integers(0, 9, mixing._CLASSES**3).astype(float))
    table = rng.integers(-60, 60, int(mixing._OFFSETS[-1])).astype(np.int8)
    return mixing._start(shape, table)


def test_next_bytes_have_probabilities_that_add_up_to_one():
    model = small_model()
    for before in (b"", b"some words ", "é漢".encode(), b"x" * 1500):
        alone = mixing.mixed([before], model)[0][0] if before else 0.0
        more = mixing.mixed([before + bytes([b]) for b in range(256)], model)[0]
        assert np.exp(alone - more).sum() == pytest.approx(1, abs=1e-3)


def test_scores_do_not_depend_on_the_batch():
    model = small_model()
    streams = [mixing.stream(mixing.tokens(t.encode())) for t in texts(60, 5)] + [b"\n", b"a" * 30_000 + b"\n"]
    together = mixing.mixed(streams, model)[0]
    apart = [mixing.mixed([s], model)[0][0] for s in streams]
    assert np.allclose(together, apart, rtol=1e-4)


def test_mixing_adapts_to_a_document():
    """Of the same text, a later part costs less than the first one did."""
    model = small_model()
    part = b"adaptive weights learn from what they have seen " * 60
    once, twice = (mixing.mixed([part * k], model)[0][0] for k in (1, 4))
    assert twice < 4 * once


def test_paths_form_a_prefix_code():
    shape = small_model().shape
    assert (0.5**shape.length).sum() == pytest.approx(1)
    codes = {tuple(zip(shape.nodes[c, :n], shape.signs[c, :n], strict=True)) for c, n in enumerate(shape.length)}
    assert len(codes) == mixing._CLASSES


def test_statistics_equal_plain_counts(spark):
    docs = texts(120, 9)
    streams = [mixing.stream(mixing.tokens(t.encode())) for t in docs]
    shape = small_model().shape
    table = mixing.statistics(documents(spark, enumerate(docs)).repartition(7), shape)
    data, starts = mixing.joined(streams)
    real, symbols = mixing._coded(data, starts), shape.symbols(data)
    counts = np.zeros(int(mixing._OFFSETS[-1]))
    for cells in mixing._cells(data):
        np.add.at(counts, (cells + symbols)[real], 1)
    counts = counts.reshape(-1, mixing._CLASSES)
    odds = np.log((counts @ shape.ones + 0.3) / (counts @ shape.zeros + 0.3))
    assert (table == np.clip(np.rint(odds * 16), -127, 127).astype(np.int8).reshape(-1)).all()


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "some text"), (2, None)])
    got = {r["doc_id"]: r for r in mixing.score(docs, F.lit(False)).collect()}
    assert got[1]["train_tokens"] == got[1]["n_known"] == 0 and got[1]["n_tokens"] == 3
    assert got[1]["base_score"] == pytest.approx(0) and got[1]["score"] < got[2]["score"] < 0
    assert mixing.score(documents(spark, []), F.lit(True)).count() == 0


def test_null_ids_teach_nothing(spark):
    got = mixing.score(documents(spark, [(None, "a b c"), (1, "a"), (2, "a")]), learning()).collect()
    assert {r["train_tokens"] for r in got} == {2 * sum(map(teaches, (1, 2)))}


def test_statistics_are_of_all_learning_texts(spark, monkeypatch):
    seen, plain = [], mixing.statistics
    monkeypatch.setattr(mixing, "statistics", lambda texts, shape: seen.append(texts.count()) or plain(texts, shape))
    mixing.score(documents(spark, [(i, f"text {i}") for i in range(60)]), F.lit(True))
    assert seen == [60]


def test_starting_weights_are_fitted_on_all_learning_texts(spark, monkeypatch):
    seen, plain = [], mixing.fit

    def watched(texts, shape, tables):
        model = plain(texts, shape, tables)
        seen.append((texts.count(), texts.select("text", "fold").distinct().count(), model))
        return model

    monkeypatch.setattr(mixing, "fit", watched)
    mixing.score(documents(spark, [(i, f"{t} {i}") for i, t in enumerate(texts(120, 4))]), F.lit(True))
    ((n, distinct, model),) = seen
    assert n == distinct == 120
    fixed = mixing._start(model.shape, model.table)
    assert not np.allclose(model.weights, fixed.weights) and not np.allclose(model.refine, fixed.refine)


def test_each_fold_has_the_table_of_its_own_texts(spark):
    shape = small_model().shape
    dealt = documents(spark, enumerate(texts(80, 6))).withColumn("fold", (F.col("doc_id") % 2).cast("int")).repartition(3)
    tables = mixing.statistics(dealt, shape)
    for table, own in zip(tables, (dealt, dealt.where("fold = 0"), dealt.where("fold = 1")), strict=True):
        assert (table == mixing.statistics(own.drop("fold"), shape)).all()


def test_tallies_hold_every_decision():
    model = small_model()
    streams = [mixing.stream(mixing.tokens(t.encode())) for t in texts(20, 8)]
    data, starts = mixing.joined(streams)
    real, symbols = mixing._coded(data, starts), model.shape.symbols(data)
    want = np.zeros(mixing._DEPTHS * 2 * mixing._BINS ** (mixing._INPUTS - 1), np.int64)
    want = want.reshape(mixing._DEPTHS, *[mixing._BINS] * (mixing._INPUTS - 1), 2)
    cells = [c.tolist() for c in mixing._cells(data)]
    for i in real.tolist():
        for depth in range(model.shape.length[symbols[i]]):
            node, one = model.shape.nodes[symbols[i], depth], int(model.shape.signs[symbols[i], depth] < 0)
            bins = [math.floor(int(model.table[c[i] + node]) / 8 + 0.5) + 16 for c in cells]
            want[min(depth, mixing._DEPTHS - 1), *reversed(bins), one] += 1
    whole = mixing._tallied(streams, model.shape, model.table)
    assert whole.sum() == model.shape.length[symbols[real]].sum()
    assert (want.reshape(-1) == whole).all()


def test_weights_are_the_most_likely_ones():
    rng = np.random.default_rng(5)
    inputs = rng.integers(12, 21, (40_000, mixing._INPUTS - 1))
    true = np.array([0.9, 0.2, -0.4, 0.3])
    p = 1 / (1 + np.exp(-((inputs - 16) / 2 @ true[:-1] + true[-1])))
    at = (inputs * mixing._BINS ** np.arange(mixing._INPUTS - 1)).sum(1) * 2 + (rng.random(len(p)) < p)
    tally = np.bincount(at, minlength=2 * mixing._BINS ** (mixing._INPUTS - 1)).reshape(-1, 2)
    weights = mixing._regressed(tally, np.array([0.3, 0.3, 0.3, 0]))
    assert np.abs(weights - true).max() < 0.05
    assert np.abs(mixing._calibrated(tally, weights) - np.linspace(-8, 8, mixing._BUCKETS))[8:17].max() < 0.2


def test_every_decision_is_refined():
    model = small_model()
    _, _, refine = mixing.mixed([b"some words that are seen again and again " * 40], model)
    moved = (refine[0] != model.refine).any(1)
    assert moved[: min(int(model.shape.length.min()), mixing._DEPTHS)].all() and moved.sum() > 1
