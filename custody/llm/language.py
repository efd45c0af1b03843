"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of a language; a document goes to the language
whose profile its own ranking is least out of place with (Cavnar and Trenkle, 1994).

Defined cases: a null text or one without a letter is ``und`` with score 0; ties of counts
are broken by n-gram, ties of distance by language name; documents without language or
outside the learning rows teach nothing; with nothing learned every document is ``und``.
Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400  # n-grams of a profile
_PIECE = 1 << 20  # characters counted at a time while learning
_SPACE = 32
_letters: np.ndarray | None = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
    out = _letters[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        out[high] = [chr(c).isalpha() for c in points[high]]
    return out


def letters(text: str) -> np.ndarray:
    """Lower-cased code points, each run of other characters one blank, blanks around."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.concatenate(([_SPACE], np.where(_is_letter(points), points, _SPACE), [_SPACE])).astype(np.int64)
    blank = points == _SPACE
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return points[keep]


def gram_codes(points: np.ndarray) -> np.ndarray:
    """n-grams of one to three characters that don't cross a word's end, 21 bits a character."""
    two = (points[:-1] << 21) | points[1:]
    three = (two[:-1] << 21) | points[2:]
    return np.concatenate((points[points != _SPACE], two, three[points[1:-1] != _SPACE]))


def counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order, with their counts.

    Few different characters (any alphabet) are numbered first, which makes the n-grams
    small integers; the many of ideographic writing are counted as they are.
    """
    if points.max() <= 0xFFFF:
        present = np.zeros(0x10000, bool)
        present[points] = True
        alphabet = np.flatnonzero(present)
    else:
        alphabet = np.unique(points)
    n = len(alphabet)
    if n >= 256:
        return np.unique(gram_codes(points), return_counts=True)
    if points.max() <= 0xFFFF:
        number = np.empty(0x10000, np.int32)
        number[alphabet] = np.arange(n, dtype=np.int32)
        d = number[points]
    else:
        d = np.searchsorted(alphabet, points).astype(np.int32)
    word = points != _SPACE
    two = d[:-1] * n + d[1:]
    parts = (d[word], two, (two[:-1] * n + d[2:])[word[1:-1]])
    found, counts = [], []
    for k, part in enumerate(parts):
        if len(part) * 8 > n ** (k + 1):
            all_counts = np.bincount(part, minlength=n ** (k + 1))
            codes = np.flatnonzero(all_counts)
            counts.append(all_counts[codes])
        else:
            part = np.sort(part)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1])))
            codes = part[first].astype(np.int64)
            counts.append(np.diff(np.append(first, len(part))))
        wide = alphabet[codes % n]
        for shift in range(1, k + 1):
            wide = wide | (alphabet[codes // n**shift % n] << (21 * shift))
        found.append(wide)
    return np.concatenate(found), np.concatenate(counts)


def ranked(points: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, best first."""
    codes, counts = counted(points)
    if len(codes) > 4 * size:  # only those that can be among the first
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): n-gram counts of pieces of the batches, by language."""

    def piece(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        codes, counts = counted(np.concatenate(parts))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            points = letters(text)
            held.setdefault(lang, []).append(points)
            sizes[lang] = sizes.get(lang, 0) + len(points)
            if sizes[lang] >= _PIECE:
                yield piece(lang, held.pop(lang))
                sizes[lang] = 0
    for lang, parts in held.items():
        yield piece(lang, parts)


def learn(docs: DataFrame, learning, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of all languages of the learning rows; only ``size`` n-grams a language reach the driver."""
    rows = docs.where(learning & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    profiles: dict[str, np.ndarray] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, np.int64) for lang, grams in profiles.items()}


def distance(doc: np.ndarray, grams: np.ndarray, ranks: np.ndarray, size: int) -> int:
    """Out-of-place distance; ``grams`` sorted, with their ranks; a missing n-gram costs ``size``."""
    at = np.minimum(np.searchsorted(grams, doc), len(grams) - 1)
    found = grams[at] == doc
    return int(np.where(found, np.abs(ranks[at] - np.arange(len(doc))), size).sum())


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score); score is 1 less the distance's share of the largest possible one."""
    tables = [(lang, np.sort(p), np.argsort(p, kind="stable")) for lang, p in sorted(profiles.items())]

    def judge(text: str | None) -> tuple[str, float]:
        if text is None or not tables:
            return "und", 0.0
        points = letters(text)
        if not (points != _SPACE).any():
            return "und", 0.0
        own = ranked(points, size)
        best, lang = min((distance(own, g, r, size), lang) for lang, g, r in tables)
        return lang, 1.0 - best / (size * len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
