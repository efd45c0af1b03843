"""Toxicity of documents by a bidirectional gated recurrent network, in numpy.

A text is cut into overlapping windows of WINDOW words. A word enters as its own vector (if
frequent in the learning sample) beside the mean of the vectors of its character n-grams, so
unseen forms are read by their letters. Two gated recurrent layers run over a window, one each
way; attention pools their states into one logit. The network learns from document labels:
a document is toxic if any window is (noisy or). All windows of every text are scored; a
small logistic model over the window logits gives the document's score.

The fit uses a bounded sample on the driver: at most POSITIVES and NEGATIVES labelled
documents of at most FIT_CHARS characters, taken in order of a hash of the id. Everything else
runs over all rows; a text is never cut.

Defined cases: a null text or one without words has the score of a clean window-less document,
0; a document with several labels is toxic if one says so; null labels teach nothing; without
labels of both kinds every score is 0. Repeated rows score alike. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, STRIDE = 64, 48
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 12, 8
CHAR_ROWS = 1 << 14
LEAST_COUNT = 3
POSITIVES, NEGATIVES, FIT_CHARS = 1500, 2400, 4000
EPOCHS, BATCH_DOCS, RATE = 5, 32, 0.02
_CHUNK_WORDS = 150_000  # words taken together while scoring
_CHUNK_WINDOWS = 1024
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of the windows that cover n words."""
    if not n:
        return []
    return [(s, min(n, s + WINDOW)) for s in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


def char_rows(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of the character n-grams of all words, start of each word among them)."""
    raw = np.frombuffer(("^" + "$^".join(found) + "$").encode("utf-8"), np.uint8).astype(np.uint64)
    lengths = np.array([len(w.encode()) + 2 for w in found], np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(raw))
    rows, owner = [], []
    word = np.repeat(np.arange(len(found)), lengths)
    for n in (3, 4, 5, 6):
        use = np.flatnonzero(at + n <= ends)
        h = np.full(len(use), n, np.uint64)
        for j in range(n):
            h = (h ^ raw[use + j]) * np.uint64(0x100000001B3)
        rows.append(((h ^ (h >> np.uint64(29))) % np.uint64(CHAR_ROWS)).astype(np.int64))
        owner.append(word[use])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.searchsorted(owner[order], np.arange(len(found)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Weights; ``vocabulary`` numbers the words that have a vector of their own, from 1."""

    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    document: np.ndarray = field(default_factory=lambda: np.zeros(5))

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        normal = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        return cls(
            vocabulary,
            {
                "word": normal(len(vocabulary) + 1, WORD_DIM, by=0.1),
                "char": normal(CHAR_ROWS, CHAR_DIM, by=0.3),
                "in": normal(d, 6 * h, by=d**-0.5),
                "bias": np.zeros(6 * h, np.float32),
                "fore": normal(h, 3 * h, by=h**-0.5),
                "back": normal(h, 3 * h, by=h**-0.5),
                "att": normal(2 * h, ATTENTION, by=(2 * h) ** -0.5),
                "query": normal(ATTENTION, by=1.0),
                "out": normal(2 * h, by=(2 * h) ** -0.5),
                "shift": np.full(1, -3, np.float32),
            },
        )

    def inputs(self, found: list[str]) -> tuple[np.ndarray, tuple]:
        """Vectors of distinct words."""
        own = np.array([self.vocabulary.get(w, 0) for w in found], np.int64)
        rows, starts = char_rows(found)
        counts = np.diff(np.append(starts, len(rows))).astype(np.float32)
        mean = np.add.reduceat(self.weights["char"][rows], starts, axis=0) / counts[:, None]
        return np.concatenate((self.weights["word"][own], mean), axis=1), (own, rows, counts)

    def _pass(self, x: np.ndarray, ids: np.ndarray, valid: np.ndarray, u: np.ndarray, keep: bool):
        """States (T, N, H) of one direction; x (words, 3H) holds the input shares."""
        h, size = np.zeros((ids.shape[1], HIDDEN), np.float32), HIDDEN
        states, trace = np.empty((*ids.shape, HIDDEN), np.float32), []
        for t in range(len(ids)):
            g, r_in = x[ids[t]], h @ u
            zr = _sigmoid(g[:, : 2 * size] + r_in[:, : 2 * size])
            z, r = zr[:, :size], zr[:, size:]
            n = np.tanh(g[:, 2 * size :] + r * r_in[:, 2 * size :])
            m = valid[t][:, None]
            if keep:
                trace.append((h, z, r, n, r_in[:, 2 * size :], m))
            h = h + m * (1 - z) * (n - h)
            states[t] = h
        return states, trace

    def logits(self, vectors: np.ndarray, ids: np.ndarray, valid: np.ndarray, keep: bool = False):
        """Logits of N windows; ids and valid (T, N)."""
        w, size = self.weights, 3 * HIDDEN
        x = vectors @ w["in"] + w["bias"]
        fore, trace_f = self._pass(np.ascontiguousarray(x[:, :size]), ids, valid, w["fore"], keep)
        back, trace_b = self._pass(np.ascontiguousarray(x[:, size:]), ids[::-1], valid[::-1], w["back"], keep)
        states = np.concatenate((fore, back[::-1]), axis=2)
        hidden = np.tanh(states @ w["att"])
        score = np.where(valid > 0, hidden @ w["query"], np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        out = pooled @ w["out"] + w["shift"][0]
        return out, (states, hidden, weight, pooled, trace_f, trace_b, x) if keep else None

    def gradients(self, found: list[str], ids: np.ndarray, valid: np.ndarray, d_out) -> dict[str, np.ndarray]:
        """Gradients of a loss; ``d_out`` maps the logits to its derivatives by them."""
        w, size = self.weights, 3 * HIDDEN
        vectors, (own, rows, counts) = self.inputs(found)
        out, (states, hidden, weight, pooled, trace_f, trace_b, x) = self.logits(vectors, ids, valid, keep=True)
        g = d_out(out).astype(np.float32)
        grad = {"shift": np.array([g.sum()], np.float32), "out": pooled.T @ g}
        d_pooled = g[:, None] * w["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["query"] = np.einsum("tn,tna->a", d_score, hidden)
        d_hidden = d_score[:, :, None] * w["query"] * (1 - hidden * hidden)
        grad["att"] = np.einsum("tnh,tna->ha", states, d_hidden)
        d_states = d_states + d_hidden @ w["att"].T
        d_x = np.zeros_like(x)
        for name, trace, d, order, part in (("fore", trace_f, d_states[:, :, :HIDDEN], ids, slice(0, size)), ("back", trace_b, d_states[::-1, :, HIDDEN:], ids[::-1], slice(size, 2 * size))):
            u, d_u, d_h, shares = w[name], np.zeros_like(w[name]), 0, []
            for t in range(len(order) - 1, -1, -1):
                h, z, r, n, rec, m = trace[t]
                total = d[t] + d_h
                step = m * total
                d_n = step * (1 - z) * (1 - n * n)
                d_z = step * (h - n) * z * (1 - z)
                d_r = d_n * rec * r * (1 - r)
                d_rec = np.concatenate((d_z, d_r, d_n * r), axis=1)
                d_u += h.T @ d_rec
                d_h = total * (1 - m) + step * z + d_rec @ u.T
                shares.append(np.concatenate((d_z, d_r, d_n), axis=1))
            grad[name] = d_u
            flat, words = np.concatenate(shares[::-1]), order.reshape(-1)
            by = np.argsort(words, kind="stable")
            used, first = np.unique(words[by], return_index=True)
            d_x[used, part] += np.add.reduceat(flat[by], first, axis=0)
        grad["bias"], grad["in"] = d_x.sum(axis=0), vectors.T @ d_x
        d_vectors = d_x @ w["in"].T
        grad["word"] = np.zeros_like(w["word"])
        np.add.at(grad["word"], own, d_vectors[:, :WORD_DIM])
        spread = np.repeat(d_vectors[:, WORD_DIM:] / counts[:, None], counts.astype(int), axis=0)
        grad["char"] = np.stack([np.bincount(rows, spread[:, k], CHAR_ROWS) for k in range(CHAR_DIM)], axis=1).astype(np.float32)
        return grad


def laid_out(docs: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, ids (T, N), valid (T, N), document of each window)."""
    number: dict[str, int] = {}
    flat = [[number.setdefault(w, len(number)) for w in d] for d in docs]
    cuts = [(i, s, e) for i, d in enumerate(flat) for s, e in windows(len(d))]
    steps = max((e - s for _, s, e in cuts), default=0)
    ids, valid = np.zeros((len(cuts), steps), np.int64), np.zeros((len(cuts), steps), np.float32)
    for k, (i, s, e) in enumerate(cuts):
        ids[k, : e - s] = flat[i][s:e]
        valid[k, : e - s] = 1
    return list(number), ids.T.copy(), valid.T.copy(), np.array([c[0] for c in cuts], np.int64)


def noisy_or(owner: np.ndarray, labels: np.ndarray, weights: np.ndarray):
    """Derivative of the documents' loss by their windows' logits."""

    def derive(logits: np.ndarray) -> np.ndarray:
        p = _sigmoid(logits.astype(np.float64))
        clean = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(labels)))[owner]
        y, weight = labels[owner], weights[owner]
        return weight * np.where(y == 1, -p * clean / np.maximum(1 - clean, 1e-6), p) / len(labels)

    return derive


def summary(logits: np.ndarray) -> np.ndarray:
    """Features of a document from its windows' logits."""
    top = np.sort(logits)[::-1][:3]
    return np.array([1.0, top[0], top.mean(), _sigmoid(logits).mean(), np.log1p(len(logits))])


def fit(sample: list[tuple[str, int]], toxic_share: float, seed: int = 5) -> Network:
    """Network of labelled texts, by Adam over shuffled documents."""
    docs = [(tokens(t), y) for t, y in sample]
    docs = [(d, y) for d, y in docs if d]
    counts = Counter(w for d, _ in docs for w in set(d))
    vocabulary = {w: k for k, w in enumerate(sorted(w for w, n in counts.items() if n >= LEAST_COUNT), 1)}
    net, rng = Network.fresh(vocabulary, seed), np.random.default_rng(seed)
    labels = np.array([y for _, y in docs])
    if len(set(labels.tolist())) < 2:
        net.document[0] = -50
        return net
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step, total = 0, EPOCHS * -(-len(docs) // BATCH_DOCS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH_DOCS):
            chosen = order[at : at + BATCH_DOCS]
            found, ids, valid, owner = laid_out([docs[i][0] for i in chosen])
            grad = net.gradients(found, ids, valid, noisy_or(owner, labels[chosen], np.ones(len(chosen))))
            step += 1
            rate = RATE * (1 - step / (total + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (size + 1e-12))
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.weights[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    features = np.array([summary(x) for x in window_logits(net, [d for d, _ in docs])])
    share = labels.mean()
    weight = np.where(labels == 1, toxic_share / share, (1 - toxic_share) / (1 - share))
    beta = np.zeros(features.shape[1])
    for _ in range(30):  # Newton steps of a ridge logistic model
        p = _sigmoid(features @ beta)
        slope = features.T @ (weight * (labels - p)) - 0.1 * beta
        curve = (features * (weight * p * (1 - p))[:, None]).T @ features + 0.1 * np.eye(len(beta))
        beta += np.clip(np.linalg.solve(curve, slope), -2, 2)
    net.document = beta
    return net


def window_logits(net: Network, docs: list[list[str]]) -> list[np.ndarray]:
    """Logits of all windows of each document, taken in pieces of bounded size."""
    out: list[np.ndarray] = [np.empty(0)] * len(docs)
    at = 0
    while at < len(docs):
        end, size = at, 0
        while end < len(docs) and (end == at or size + len(docs[end]) <= _CHUNK_WORDS):
            size += len(docs[end])
            end += 1
        found, ids, valid, owner = laid_out(docs[at:end])
        if found:
            vectors, _ = net.inputs(found)
            got = np.concatenate([net.logits(vectors, ids[:, k : k + _CHUNK_WINDOWS], valid[:, k : k + _CHUNK_WINDOWS])[0] for k in range(0, ids.shape[1], _CHUNK_WINDOWS)])
            edges = np.searchsorted(owner, np.arange(end - at + 1))
            for i in range(end - at):
                out[at + i] = got[edges[i] : edges[i + 1]]
        at = end
    return out


def learn(docs: DataFrame, labels: DataFrame, learning: Column) -> Network:
    """Fit on the sample; ``learning`` is a condition on ``doc_id``. Only the sample reaches the driver."""
    known = labels.where(learning & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if share is None:
        return fit([], 0.0)
    short = docs.where(F.length("text") <= FIT_CHARS).select("doc_id", "text")
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, POSITIVES), (0, NEGATIVES))]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most POSITIVES + NEGATIVES rows
    rows = short.join(chosen, "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return fit([(r["text"], int(r["toxic"])) for r in rows], float(share))


def _scores(model: Network, texts: list[str | None]) -> list[float]:
    logits = window_logits(model, [tokens(t) for t in texts])
    return [float(_sigmoid(summary(x) @ model.document)) if len(x) else 0.0 for x in logits]


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score), one row per document."""
    held = docs.sparkSession.sparkContext.broadcast((net.vocabulary, net.weights, net.document))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(*held.value)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(model, part.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast((net.vocabulary, net.weights, net.document))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(*held.value)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array([s < threshold for s in _scores(model, part.column("text").to_pylist())]))

    return docs.mapInArrow(run, docs.schema)
