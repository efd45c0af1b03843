"""Maximal word repetitions of every document, by online dyadic square catching.

Words are appended a piece at a time. Whenever a block of 2**k words is complete, its
catcher looks back: an equal block q words earlier, with q in the octave of periods that
belongs to k, is the seed of a square. The comparison goes on to the left at once and to
the right with every further piece, by binary descent over fingerprints of the text; squares
with one start and period merge into a run, which is closed when its next word differs.

Why nothing is missed: a run of period q and length L has L - q consecutive words that equal
the word q earlier, and any 2**(k+1) - 1 consecutive words hold a whole aligned block of
2**k. The octave of k is chosen so that L - q is that long.

Fingerprints are prefix sums modulo 2**64 of random values of the words, so equal stretches
always have equal ones. Every run is confirmed on the words themselves; where one fails
(certain words collide in any such sum), the seeds' periods are compared word by word.

A document is one row and stays in its task; short documents are joined, with separators
that equal nothing, and handled together. Memory is a few numbers a word.

Defined cases: a null or empty text and one without words has no runs and an empty
collapsed text. Rows are judged by themselves, so repeated and null ids need no rule. The
best run has the greatest length / period, then the smallest start, then the smallest
period. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custody.llm import words

PIECE = 1 << 16  # words appended at a time
_SLAB = 1 << 18  # comparisons made at a time
_BASE = 0x9E3779B97F4A7C15
_powers = _inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of the base and of its inverse modulo 2**64, up to the n-th."""
    global _powers, _inverse
    if n < len(_powers):
        return
    n = max(2 * n, 1 << 16)
    with np.errstate(over="ignore"):
        _powers = np.full(n + 1, _BASE, np.uint64)
        _inverse = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        _powers[0] = _inverse[0] = 1
        _powers, _inverse = np.cumprod(_powers, dtype=np.uint64), np.cumprod(_inverse, dtype=np.uint64)


class Catchers:
    """Runs of at least ``least`` words and ``times`` periods in a sequence of numbers.

    ``longest`` bounds the length of a run, where the caller knows one.
    """

    def __init__(self, least: int = 24, times: int = 3, longest: int | None = None):
        if least < 2 or times < 2:
            raise ValueError("a run has two periods and two words at least")
        self.least, self.times, self.longest = least, times, longest
        self.text = np.empty(0, np.int64)
        self.sums = np.zeros(1, np.uint64)
        self.start = self.period = self.end = np.empty(0, np.int64)
        overlap = min(max(least, times * q) - q for q in range(1, least + 1))
        self.lowest = ((overlap + 1) // 2).bit_length() - 1

    def _octave(self, k: int) -> tuple[int, int]:
        """Least and greatest period that the catchers of 2**k words look for."""

        def first(k: int) -> int:
            return -((1 - 2 ** (k + 1)) // (self.times - 1))

        return (1 if k == self.lowest else first(k)), first(k + 1) - 1

    def append(self, piece: np.ndarray) -> None:
        before, after = len(self.text), len(self.text) + len(piece)
        _grow(after + 1)
        self.text = np.concatenate((self.text, piece))
        values = words.mix(piece.astype(np.uint64) * np.uint64(_BASE) + np.uint64(0x632BE59BD9B4E019))
        sums = np.cumsum(values * _powers[before:after], dtype=np.uint64) + self.sums[-1]
        self.sums = np.concatenate((self.sums, sums))
        waiting = np.flatnonzero(self.end == before)
        if len(waiting):
            self.end[waiting] += self._ahead(self.end[waiting], self.end[waiting] - self.period[waiting])
        found_at, found_q = [], []
        most = after if self.longest is None else self.longest // self.times
        k = self.lowest
        while self._octave(k)[0] <= most:
            at, q = self._seeds(k, before, after, most)
            found_at.append(at)
            found_q.append(q)
            k += 1
        if not sum(map(len, found_at)):
            return
        size = np.repeat([1 << (self.lowest + j) for j in range(len(found_at))], [len(x) for x in found_at])
        at, q = np.concatenate(found_at), np.concatenate(found_q)
        start = at - q - self._behind(at, at - q)
        end = at + size + self._ahead(at + size, at + size - q)
        start, q, end = (np.concatenate(x) for x in ((self.start, start), (self.period, q), (self.end, end)))
        order = np.lexsort((-end, q, start))
        start, q, end = start[order], q[order], end[order]
        new = np.ones(len(order), bool)
        new[1:] = (start[1:] != start[:-1]) | (q[1:] != q[:-1])
        self.start, self.period, self.end = start[new], q[new], end[new]

    def _seeds(self, k: int, before: int, after: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that this piece completed and that equal one a period earlier; of a series of such blocks the first."""
        size = 1 << k
        low, high = self._octave(k)
        high = min(high, most)
        first = max(before // size * size, size)  # the block that holds word ``before`` is the first to be completed now
        starts = np.arange(first, after - size + 1, size)
        starts = starts[starts >= low]
        none = np.empty(0, np.int64)
        if not len(starts) or high < low:
            return none, none
        origin = starts[0] - high
        floor = max(origin, 0)
        with np.errstate(over="ignore"):
            prints = (self.sums[floor + size : after + 1] - self.sums[floor : after + 1 - size]) * _inverse[floor : after + 1 - size]
        if origin < 0:
            prints = np.concatenate((np.zeros(-origin, np.uint64), prints))
        width = high - low + 1
        earlier = np.lib.stride_tricks.sliding_window_view(prints, width)
        rows = max(1, _SLAB // width)
        at, periods, last = [], [], None
        for i in range(0, len(starts), rows):
            part = starts[i : i + rows]
            equal = earlier[part[0] - high - origin : part[-1] - high - origin + 1 : size] == prints[part - origin][:, None]
            if equal.any():
                fresh = equal.copy()
                fresh[1:] &= ~equal[:-1]
                if last is not None:
                    fresh[0] &= ~last
                r, c = np.nonzero(fresh)
                q = high - c
                real = part[r] >= q
                at.append(part[r][real])
                periods.append(q[real])
            last = equal[-1]
        return (np.concatenate(at), np.concatenate(periods)) if at else (none, none)

    def _same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[a + n] - self.sums[a]) * _inverse[a] == (self.sums[b + n] - self.sums[b]) * _inverse[b]

    def _behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b, b < a."""
        out = np.zeros(len(a), np.int64)
        step = 1 << (int(b.max()).bit_length() if len(b) else 0)
        while step:
            can = np.flatnonzero(b - out >= step)
            if len(can):
                x, y = a[can] - out[can] - step, b[can] - out[can] - step
                out[can[self._same(x, y, step)]] += step
            step >>= 1
        return out

    def _ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on, b < a."""
        n = len(self.text)
        out = np.zeros(len(a), np.int64)
        step = 1 << (int((n - a).max()).bit_length() if len(a) else 0)
        while step:
            can = np.flatnonzero(a + out + step <= n)
            if len(can):
                x, y = a[can] + out[can], b[can] + out[can]
                out[can[self._same(x, y, step)]] += step
            step >>= 1
        return out

    def runs(self) -> np.ndarray:
        """(start, length, period) of all runs so far, by start and period; one still open ends with the text."""
        keep = self.end - self.start >= np.maximum(self.least, self.times * self.period)
        start, period, end = self.start[keep], self.period[keep], self.end[keep]
        order = np.lexsort((period, end, start))  # of one stretch the smallest period stays
        start, period, end = start[order], period[order], end[order]
        new = np.ones(len(order), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, period, end = start[new], period[new], end[new]
        text = self.text
        for s, q, e in zip(start.tolist(), period.tolist(), end.tolist(), strict=True):
            if not np.array_equal(text[s + q : e], text[s : e - q]):
                return self._by_word()
        order = np.lexsort((period, start))
        return np.stack((start, end - start, period), 1)[order]

    def _by_word(self) -> np.ndarray:
        """The same from the words themselves, for the periods of all seeds."""
        best: dict[tuple[int, int], int] = {}
        for q in np.unique(self.period).tolist():
            same = np.zeros(len(self.text) - q + 2, bool)
            same[1:-1] = self.text[q:] == self.text[:-q]
            turn = np.flatnonzero(same[1:] != same[:-1])
            for s, e in zip(turn[::2].tolist(), (turn[1::2] + q).tolist(), strict=True):
                if e - s >= max(self.least, self.times * q):
                    best.setdefault((s, e), q)
        return np.array(sorted((s, e - s, q) for (s, e), q in best.items()), np.int64).reshape(-1, 3)


def collapsed(split: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(found):
        return b" ".join(split)
    edge = np.zeros(len(split) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return b" ".join([split[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def best(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length / period, in whole numbers; the first of equals."""
    top = None
    for s, n, q in found.tolist():
        if top is None or n * top[2] > top[1] * q:
            top = (s, n, q)
    return top


def of_documents(docs: list[list[bytes]], least: int, times: int) -> list[np.ndarray]:
    """Runs of several documents, found in one sequence with separators between them."""
    number: dict[bytes, int] = {}
    parts, starts, at = [], [], 0
    for i, split in enumerate(docs):
        parts += [np.fromiter((number.setdefault(w, len(number)) for w in split), np.int64, len(split)), np.array([-1 - i], np.int64)]
        starts.append(at)
        at += len(split) + 1
    text = np.concatenate(parts)
    catchers = Catchers(least, times, max(map(len, docs)))
    for i in range(0, len(text), PIECE):
        catchers.append(text[i : i + PIECE])
    found = catchers.runs()
    cut = np.searchsorted(found[:, 0], [*starts, at])
    return [found[a:b] - [s, 0, 0] for a, b, s in zip(cut[:-1], cut[1:], starts, strict=True)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, best struct<start:bigint,length:bigint,period:bigint>, collapsed string"


def repetitions(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of every document.

    ``runs`` lists (start, length, period) by start and period; ``best`` is null without
    one; ``collapsed`` keeps of every run its first period.
    """

    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = of_documents(texts, least, times)
        listed = [[dict(start=s, length=n, period=q) for s, n, q in f.tolist()] for f in found]
        tops = [None if (b := best(f)) is None else dict(start=b[0], length=b[1], period=b[2]) for f in found]
        kept = pa.array([collapsed(t, f) for t, f in zip(texts, found, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(listed, pa.list_(_RUN)), pa.array(tops, _RUN), kept.view(pa.string())],
            ["doc_id", "n_words", "runs", "best", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), words.binaries(batch.column("text")), strict=True):
                split = words.split(text)
                if texts and size + len(split) > PIECE:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(split)
                size += len(split)
            if texts:
                yield rows(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


# --- the query's digests -------------------------------------------------------------------

_PLANTED = """
aggregate(array(struct(crc32(cast(cast(doc_id as string) as binary)) as h, filter(split(text, '[ \\t-\\r]+', -1), w -> w <> '') as w)),
  cast(null as string),
  (none, x) -> array_join(transform(x.w, (v, i) ->
    x.w[if(i < (x.h div 10) % size(x.w), i, cast((x.h div 10) % size(x.w) + (i - (x.h div 10) % size(x.w)) % (1 + (size(x.w) - (x.h div 10) % size(x.w)) div (3 + (x.h div 10) % 8)) as int))]), ' '))
"""


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which those with crc32(id) divisible by 10 repeat a stretch of themselves to their end."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return docs.select("doc_id", F.when(chosen & F.col("text").rlike(r"[^ \t-\r]"), F.expr(_PLANTED)).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """A row of numbers and digests for each row of ``repetitions``."""
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# Runs by pairs of equal 16-word stretches: a run has 16 words at least that equal those a period earlier.
ORACLE = """
WITH byte AS (
  SELECT x, list_reduce([CAST(x AS UBIGINT)] || list_transform(range(8), lambda k: CAST(0 AS UBIGINT)),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS crc
  FROM range(256) r(x)
), crcs AS (
  SELECT list(crc ORDER BY x) AS t FROM byte
), doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         CAST(xor(list_reduce([4294967295::UBIGINT] || list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k + 1, 1)) AS UBIGINT)),
           lambda c, b: xor(c >> 8, t[1 + CAST(xor(c, b) & 255 AS BIGINT)])), 4294967295::UBIGINT) AS BIGINT) AS h
  FROM documents, crcs
), part AS (
  SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM doc
), planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w
  FROM part
), word AS (
  SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM planted
), stretch AS (
  SELECT doc_id, i, md5(array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING), ' ')) AS gram,
         count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS size
  FROM word
), pair AS (
  SELECT a.doc_id, a.i AS x, b.i - a.i AS q FROM stretch a JOIN stretch b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.i < b.i WHERE a.size = 16 AND b.size = 16
), island AS (
  SELECT doc_id, q, x, x - row_number() OVER (PARTITION BY doc_id, q ORDER BY x) AS part FROM pair
), found AS (
  SELECT doc_id, q, min(x) AS s, max(x) + 16 + q AS e FROM island GROUP BY doc_id, q, part HAVING max(x) + 16 + q - min(x) >= greatest(24, 3 * q)
), run AS (
  SELECT doc_id, s, e - s AS n, min(q) AS q FROM found GROUP BY doc_id, s, e
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         list(struct_pack(s := s, n := n, q := q) ORDER BY CAST(n AS DOUBLE) / q DESC, s, q)[1] AS top
  FROM run GROUP BY doc_id
), edge AS (
  SELECT doc_id, i, sum(d) AS d FROM (SELECT doc_id, s + q AS i, 1 AS d FROM run UNION ALL SELECT doc_id, s + n, -1 FROM run) GROUP BY ALL
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM (
    SELECT w.doc_id, w.i, w.word, sum(coalesce(d, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS UNBOUNDED PRECEDING) AS depth
    FROM word w LEFT JOIN edge e ON e.doc_id = w.doc_id AND e.i = w.i)
  WHERE depth = 0 GROUP BY doc_id
)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.n AS length, top.q AS period, 1000 * top.n // top.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM planted p LEFT JOIN listed l ON l.doc_id = p.doc_id LEFT JOIN kept k ON k.doc_id = p.doc_id
"""
