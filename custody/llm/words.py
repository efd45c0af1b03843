"""Words, hashes and shingle sets inside tasks.

A word is a run of bytes other than the six ASCII blanks (space, tab, line feed, vertical
tab, form feed, carriage return); that is what ``bytes.split`` cuts at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_VALUES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)
_PLACES = 64
_DRAWN = np.random.default_rng(20260301).integers(0, 2**64, _PLACES << 8, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers = _inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of the base and of its inverse modulo 2**64, up to the n-th."""
    global _powers, _inverse
    n = max(n, 1 << 14)
    with np.errstate(over="ignore"):
        _powers = np.full(n + 1, _BASE, np.uint64)
        _inverse = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        _powers[0] = _inverse[0] = 1
        _powers, _inverse = np.cumprod(_powers, dtype=np.uint64), np.cumprod(_inverse, dtype=np.uint64)


def split(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words of a UTF-8 text; ``lower`` folds A-Z only. Null gives no words."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def word_hashes(text: bytes | None, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word, in order: the sum of one random value per (place, byte), mixed.

    Values of the first _PLACES places are drawn; a later place takes the value of its place
    modulo _PLACES, mixed with how often that went round. No value depends on another by a
    rule that words could follow, so there are no families of words that always collide.
    """
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _BLANK[raw]
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    lengths = turn[1::2] - turn[::2]
    if not len(lengths):
        return np.empty(0, np.uint64)
    letters = raw[~blank[1:-1]]
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    values = _DRAWN[(place & (_PLACES - 1)) << 8 | (_LOWER[letters] if lower else letters)]
    late = np.flatnonzero(place >= _PLACES) if lengths.max() > _PLACES else ()
    if len(late):
        values[late] = mix(values[late] + (place[late] // _PLACES).astype(np.uint64) * np.uint64(_BASE))
    return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, in order; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n] + np.uint64(j + 1))
    return out


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words are none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(grams(hashes, min(size, len(hashes))))


def binaries(column: pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def ids(column: pa.Array) -> list[int | None]:
    return column.to_pylist()
