"""A full-text index in minute space over word sequences, for many queries at a time.

The texts, each followed by an end mark, are one sequence of small integers. Its suffixes are
sorted to the depth of the longest pattern that will be asked for (which is all that backward
search of such patterns needs), and the last column is held as a wavelet matrix: one bit
vector per bit of a symbol, with counts per 64 bits. Backward steps of all pending queries
are taken together.
"""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Wavelet tree of a sequence, its levels laid side by side."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = ((now >> b) & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, bool))), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))
        self.first = self._walk(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            word, low = at >> 6, (at & 63).astype(np.uint64)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << low) - np.uint64(1)))
            at = np.where((symbols >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbols, at) - self.first[symbols]


class FMIndex:
    """Index of texts (arrays of word hashes) for patterns of ``depth`` words."""

    def __init__(self, texts: list[np.ndarray], depth: int):
        self.depth = depth
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.alphabet, codes = np.unique(np.concatenate(texts), return_inverse=True)
        n = int(lengths.sum()) + len(texts)
        symbols = np.zeros(n, np.int64)  # 0 is the end mark
        symbols[np.arange(len(codes)) + np.repeat(np.arange(len(texts)), lengths)] = codes + 1
        ranks, reach = [symbols], 1
        while reach < depth:
            ranks.append(self._doubled(ranks[-1], reach))
            reach *= 2
        order = np.argsort(ranks[-1], kind="stable")
        self.rows = order  # row -> place in the sequence
        last = symbols[order - 1]
        self.wavelet = Wavelet(last, len(self.alphabet) + 1)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=len(self.alphabet) + 1))))
        self.shorter = self._groups(ranks, depth - 1)  # rows that share depth - 1 words
        self.full = self._groups(ranks, depth)

    @staticmethod
    def _doubled(rank: np.ndarray, reach: int) -> np.ndarray:
        shifted = np.zeros_like(rank)
        if reach < len(rank):
            shifted[:-reach] = rank[reach:]
        key = rank * (len(rank) + 1) + shifted
        order = np.argsort(key)
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        out = np.empty_like(rank)
        out[order] = new + 1
        return out

    def _groups(self, ranks: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row after the last) of the rows that share ``depth`` words with each row."""
        n = len(self.rows)
        if depth == 0:
            return np.zeros(n, np.int64), np.full(n, n)
        level = depth.bit_length() - 1
        rank, gap = ranks[level], depth - (1 << level)
        later = np.zeros_like(rank)
        later[: n - gap] = rank[gap:]
        a, b = rank[self.rows], later[self.rows]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        return first[group], np.append(first[1:], n)[group]

    def encode(self, text: np.ndarray) -> np.ndarray:
        """Symbols of words; -1 for words that the index lacks."""
        at = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == text, at + 1, -1)

    def matches(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(lo, hi) rows of each window of ``depth`` words of each streamed text; lo = hi where it occurs nowhere.

        Windows are met from the right. After a full match the interval is widened to the rows that
        share all but the last word and takes one backward step; after a miss the next window
        starts anew.
        """
        d = self.depth
        lengths = np.array([len(t) for t in texts], np.int64)
        offset = np.concatenate(([0], np.cumsum(lengths)))
        flat = self.encode(np.concatenate(texts)) if len(texts) and offset[-1] else np.empty(0, np.int64)
        lo_of, hi_of = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        lane = np.flatnonzero(lengths >= d)
        start = offset[lane] + lengths[lane] - d  # place of the window that is being searched
        base = offset[lane]
        done = np.zeros(len(lane), np.int64)  # words of it matched so far
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), len(self.rows))
        while len(start):
            symbol = flat[start + d - 1 - done]
            known = symbol > 0
            s = np.where(known, symbol, 0)
            both = self.wavelet.rank(np.concatenate((s, s)), np.concatenate((lo, hi)))
            lo, hi = self.before[s] + both[: len(s)], self.before[s] + both[len(s) :]
            done = done + 1
            missed = ~known | (lo >= hi)
            full = (done == d) & ~missed
            lo_of[start[full]], hi_of[start[full]] = lo[full], hi[full]
            wide = np.minimum(lo, len(self.rows) - 1)
            lo = np.where(full, self.shorter[0][wide], np.where(missed, 0, lo))
            hi = np.where(full, self.shorter[1][wide], np.where(missed, len(self.rows), hi))
            done = np.where(full, d - 1, np.where(missed, 0, done))
            start = start - (full | missed)
            on = start >= base
            start, base, done, lo, hi = start[on], base[on], done[on], lo[on], hi[on]
        return [(lo_of[a : max(a, b - d + 1)], hi_of[a : max(a, b - d + 1)]) for a, b in zip(offset[:-1], offset[1:], strict=True)]

    def least(self, values: np.ndarray) -> np.ndarray:
        """For each row the least value among the rows of its full match; ``values`` by place."""
        first = np.flatnonzero(self.full[0] == np.arange(len(self.rows)))
        lows = np.minimum.reduceat(values[self.rows], first)
        return lows[np.searchsorted(first, self.full[0])]
