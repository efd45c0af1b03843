"""The Merkle manifest and the run finder against brute force, and their defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from custody.llm import manifest, runs

CLASHING = ["tree", "leaf", "claim", "pos", "word", "bits", "base", "total", "block", "slot", "runs", "best", "h", "w", "n"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of DOCS, with columns whose names the operators use inside."""
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in CLASHING})


# --- manifest ------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    fields = [doc_id, source, lang, n_chars, text]
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tampered(doc_id, text):
    return text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text


def tree(nodes):
    """All levels of a tree of runs of three."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        a = i - i % 3
        out.append((level[a:i], level[i + 1 : a + 3]))
        i //= 3
    return out


def by_hand(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        claim = leaf_of(doc_id, tampered(doc_id, text), lang, source, n_chars)
        groups.setdefault(source, []).append((doc_id is not None, doc_id, leaf_of(doc_id, text, lang, source, n_chars), claim))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2], x[3]))]) for s in names}
    over = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, doc_id, leaf, claim) in enumerate(sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2], x[3]))):
            steps = path(trees[s], i) + path(over, k)
            node = claim
            for left, right in steps:
                node = sha(*left, node, *right)
            proof = sha(*(x for left, right in steps for x in left + right))
            out.append((doc_id, leaf, trees[s][-1][0], over[-1][0], proof, node, node == over[-1][0]))
    return sorted(out, key=str)


def proved(spark, rows):
    docs = documents(spark, rows)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return sorted((tuple(r) for r in manifest.prove(manifest.leaves(docs, claimed=changed)).collect()), key=str)


def test_manifest_equals_brute_force(spark):
    rows = [(i * 7919 % 4001, f"text {i}\nline", "en", f"s{i % 7 and 1}", i) for i in range(1700)]  # one source beyond a block
    assert proved(spark, rows) == by_hand(rows)


def test_manifest_of_odd_rows(spark):
    rows = [
        (5, "a\nb", "en", "x", 3), (5, "a\nb", "en", "x", 3), (5, "other", "en", "x", 5), (4, None, None, "x", None), (6, "", "", "x", 0),
        (None, "n", "en", "x", 1), (None, "m\n", "en", "x", 1), (None, "n", "en", "x", 1), (-1, "minus\n", "de", "x", 6), (2**63 - 1, "most", "en", "x", 4),
        (-(2**63), "least", "en", "x", 5), (63, "q", "en", "x", 1), (64, "r", "en", "x", 1), (9, "alone\n", "en", None, 6), (10, "é\n", "fr", "", 2), (11, "é" * 50_000, "fr", "é", 50_000),
    ]
    assert proved(spark, rows) == by_hand(rows)


def test_manifest_of_one_id_for_a_third_of_the_rows(spark):
    rows = [(7, f"t{i % 400}\n", "en", "s", i % 400) for i in range(900)] + [(i, "t", "en", "s", 1) for i in range(1000, 2800)]
    assert proved(spark, rows) == by_hand(rows)


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(3, "x\n", "en", "s", 2)]
    assert proved(spark, rows) == by_hand(rows)
    assert proved(spark, rows)[0][4] == hashlib.sha256(b"").hexdigest()
    assert proved(spark, []) == []


def test_folding_follows_the_claim():
    levels = manifest.reduced([sha(str(i)) for i in range(10)], True)
    assert [len(x) for x in levels] == [10, 4, 2, 1]
    for i in range(10):
        assert manifest.folded(levels[0][i], manifest.siblings(levels, i)) == levels[-1][0]
        assert manifest.folded(sha("other"), manifest.siblings(levels, i)) != levels[-1][0]


# --- runs ----------------------------------------------------------------------------------


def runs_by_hand(text, least, times):
    best = {}
    for q in range(1, len(text) // times + 1):
        i = 0
        while i + q < len(text):
            if text[i] != text[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(text) and text[j] == text[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items())


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (2, 2), (10, 4), (30, 2)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least * 10 + times)
    for trial in range(150):
        text = []
        while len(text) < rng.randrange(1, 160):
            base = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 14))]
            text += (base * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        want = runs_by_hand(text, least, times)
        for piece in (1, 5, 1000) if trial < 40 else (rng.randrange(1, 50),):
            catchers = runs.Catchers(least, times)
            for i in range(0, len(text), piece):
                catchers.append(np.array(text[i : i + piece]))
            assert [tuple(r) for r in catchers.runs().tolist()] == want, (text, piece)


def test_runs_are_reported_while_words_arrive():
    catchers = runs.Catchers()
    catchers.append(np.arange(1000) % 10)
    assert catchers.runs().tolist() == [[0, 1000, 10]]
    catchers.append(np.arange(1000, 1500) % 10)
    assert catchers.runs().tolist() == [[0, 1500, 10]]
    catchers.append(np.array([77, 78]))
    assert catchers.runs().tolist() == [[0, 1500, 10]]


def test_words_that_collide_in_prefix_sums_make_no_run():
    """Thue-Morse words collide in sums modulo 2**64 whatever the base; the words themselves decide."""
    a = np.array([bin(i).count("1") % 2 for i in range(2048)])
    text = np.concatenate((a, 1 - a, a, a, 1 - a))
    catchers = runs.Catchers(24, 2)
    catchers.append(text)
    assert [tuple(r) for r in catchers.runs().tolist()] == runs_by_hand(text.tolist(), 24, 2)


def test_long_and_regular_texts():
    one = runs.of_documents([[b"a"] * 70_000, [], [b"b"], [b"x%d" % i for i in range(70_000)], [b"p%d" % (i % 20_011) for i in range(66_000)]], 24, 3)
    assert [f.tolist() for f in one] == [[[0, 70_000, 1]], [], [], [], [[0, 66_000, 20_011]]]


def test_neighbouring_documents_make_no_run_together():
    found = runs.of_documents([[b"a", b"b"] * 10] * 50, 24, 3)
    assert all(not len(f) for f in found)


def row_by_hand(doc_id, text):
    split = [] if text is None else text.encode().split()
    n = len(split)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        split = [split[i] if i < a else split[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(split, 24, 3)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(w for i, w in enumerate(split) if i not in dropped)
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_rows_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "a b " * 30 + "c", "É\x0bé\x0c" * 40, "x y z " * 12 + "x y", "a " * 5000]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 300))) for _ in range(150)]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)] + [(4, texts[4], None, "s", 0), (4, "other", None, "s", 0), (None, texts[4], None, "s", 0)]
    got = runs.digests(runs.repetitions(runs.planted(documents(spark, rows)))).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((row_by_hand(i, t) for i, t, *_ in rows), key=str)
    assert runs.digests(runs.repetitions(runs.planted(documents(spark, [])))).count() == 0
