"""Quality scores by co-training of a text view and a page-metadata view.

The text view sees hashed words and hashed pairs of neighbouring bytes, the metadata view
language, source, length and layout. Both are logistic models that start from the same
labelled documents. In each round either view labels the unlabelled documents of the pool of
which it is surest, in the proportion of the labels, and hands them to the other one as
examples. At the end each view is calibrated on labelled documents kept apart, and a logistic
model of the two calibrated views gives the score.

The fit uses bounded samples on the driver, in order of a hash of the id: at most LABELLED
labelled and POOL unlabelled documents, as features of TEXT_DIM numbers. Every document is
scored, from its whole text.

Defined cases: a null text or one without words has score 0; null metadata is a value of its
own; a document with several labels is good only if all say so; without labels of both kinds
every score is 0. Repeated rows score alike. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.llm import words

TEXT_DIM = 2048  # half for words, half for pairs of bytes
META_DIM = 64
LABELLED, POOL = 4000, 3000
ROUNDS, EXCHANGED, SURE = 5, 200, 0.9
_STEPS, _RATE = 80, 0.1
_PAIRS = np.array([zlib.crc32(bytes(divmod(i, 256))) % (TEXT_DIM // 2) for i in range(65536)], np.int64)
_UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def text_view(raw: bytes, hashes: np.ndarray) -> np.ndarray:
    half = TEXT_DIM // 2
    out = np.zeros(TEXT_DIM, np.float32)
    out[:half] = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % half, minlength=half)
    codes = np.frombuffer(raw, np.uint8).astype(np.int64)
    out[half:] = np.bincount(_PAIRS[codes[:-1] * 256 + codes[1:]], minlength=half)
    for part in (out[:half], out[half:]):
        np.log1p(part, out=part)
        part /= max(1e-6, float(np.sqrt((part * part).sum())))
    return out


def meta_view(raw: bytes, hashes: np.ndarray, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    codes = np.frombuffer(raw, np.uint8)
    n, lines = len(codes), raw.split(b"\n")
    out = np.zeros(META_DIM, np.float32)
    out[:11] = [
        1.0,
        np.log1p(max(0, n_chars or 0)) / 10,
        np.log1p(len(hashes)) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(n / len(lines)) / 10,
        len(np.unique(hashes)) / len(hashes),
        n / len(hashes) / 10,
        _UPPER[codes].mean() * 10,
        _DIGIT[codes].mean() * 10,
        _MARK[codes].mean() * 10,
        sum(not x.strip() for x in lines) / len(lines),
    ]
    out[12 + zlib.crc32(str(lang).encode()) % 12] = 1
    out[24 + zlib.crc32(str(source).encode()) % 40] = 1
    return out


def views(text: bytes | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray] | None:
    hashes = words.word_hashes(text, lower=True)
    return (text_view(text, hashes), meta_view(text, hashes, lang, source, n_chars)) if len(hashes) else None


def _probability(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, ridge: float = 1e-4) -> np.ndarray:
    """Weights (last one the shift) by Adam over all rows."""
    w = np.zeros(x.shape[1] + 1, np.float32) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, _STEPS + 1):
        error = ((_probability(x @ w[:-1] + w[-1]) - y) / len(y)).astype(np.float32)
        g = np.append(error @ x + ridge * w[:-1], error.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= _RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def calibrated(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a small logistic model of the columns of ``logits`` and a shift, by Newton steps."""
    x = np.column_stack((logits, np.ones(len(y))))
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _probability(x @ w)
        slope = x.T @ (y - p) - 0.05 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w += np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w


def co_train(labelled: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, pool: list[tuple[np.ndarray, np.ndarray]]) -> dict | None:
    """Models of both views and of their combination; None without labels of both kinds."""
    if len(set(y.tolist())) < 2:
        return None
    x = [np.stack([f[v] for f in labelled]) for v in (0, 1)]
    free = [np.stack([f[v] for f in pool]) if pool else np.empty((0, x[v].shape[1]), np.float32) for v in (0, 1)]
    apart = np.zeros(len(y), bool)
    for label in (0, 1):  # every fourth of either kind calibrates
        apart[np.flatnonzero(y == label)[3::4]] = True
    if len(set(y[apart].tolist())) < 2:
        apart[:] = False
    fitted, share = ~apart, float(y.mean())
    judge = apart if apart.any() else fitted
    given: list[tuple[list[int], list[int]]] = [([], []), ([], [])]  # pool rows and pseudo-labels a view was handed
    models: list[np.ndarray | None] = [None, None]
    for _ in range(ROUNDS):
        for v in (0, 1):
            rows, pseudo = given[v]
            models[v] = logistic(np.concatenate((x[v][fitted], free[v][rows])), np.concatenate((y[fitted], pseudo)), models[v])
        for v in (0, 1):
            p = _probability(free[v] @ models[v][:-1] + models[v][-1])
            left = np.setdiff1d(np.arange(len(p)), given[1 - v][0])
            for label, sure, count in ((1, p, share), (0, 1 - p, 1 - share)):
                best = left[np.argsort(-sure[left], kind="stable")][: max(1, round(EXCHANGED * count))]
                best = best[sure[best] >= SURE].tolist()
                given[1 - v][0].extend(best)
                given[1 - v][1].extend([label] * len(best))
    raw = [x[v][judge] @ models[v][:-1] + models[v][-1] for v in (0, 1)]
    scales = [calibrated(r[:, None], y[judge]) for r in raw]
    both = np.column_stack([r * s[0] + s[1] for r, s in zip(raw, scales, strict=True)])
    return {"views": models, "scales": scales, "both": calibrated(both, y[judge])}


def scores(model: dict | None, found: tuple[np.ndarray, np.ndarray] | None) -> tuple[float, float, float]:
    """(score, text score, metadata score)."""
    if model is None or found is None:
        return 0.0, 0.0, 0.0
    own = [float(f @ w[:-1] + w[-1]) * s[0] + s[1] for f, w, s in zip(found, model["views"], model["scales"], strict=True)]
    total = own[0] * model["both"][0] + own[1] * model["both"][1] + model["both"][2]
    return tuple(float(_probability(np.float64(t))) for t in (total, *own))


_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(batch: pa.RecordBatch):
    return zip(words.binaries(batch.column("text")), *(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)


def learn(docs: DataFrame, labels: DataFrame, learning: Column) -> dict | None:
    """Fit on the samples; ``learning`` is a condition on ``doc_id``."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = docs.select("doc_id").where(learning & F.col("doc_id").isNotNull())
    # once for all, so that both samples are bounded tables of ids
    chosen = known.where(learning).orderBy(*order).limit(LABELLED).select("doc_id", "quality")
    free = ids.join(known, "doc_id", "left_anti").orderBy(*order).limit(POOL).select("doc_id", F.lit(None).cast("int").alias("quality"))
    sample = F.broadcast(chosen.union(free))  # at most LABELLED + POOL rows
    rows = docs.select(*_COLUMNS).join(sample, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [views(*r) for r in _rows(batch)]
            data = [b"".join(x.tobytes() for x in f) if f else None for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(data, pa.binary())], ["doc_id", "quality", "data"])

    got = sorted((r["doc_id"], bytes(r["data"]), r["quality"]) for r in rows.mapInArrow(run, "doc_id long, quality int, data binary").where("data is not null").collect())
    opened = lambda data: tuple(np.split(np.frombuffer(data, np.float32), [TEXT_DIM]))
    labelled = [(opened(d), q) for _, d, q in got if q is not None]
    return co_train([f for f, _ in labelled], np.array([q for _, q in labelled], np.float64), [opened(d) for _, d, q in got if q is None])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score, text_score, meta_score), one row per document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scores(held.value, views(*r)) for r in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([g[k] for g in got], pa.float64()) for k in range(3))], ["doc_id", "score", "text_score", "meta_score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    return rows.mapInArrow(run, "doc_id long, score double, text_score double, meta_score double")
