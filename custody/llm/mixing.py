"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is the sequence of its tokens: lower-cased words (A-Z only) and one end. It is coded
as bytes, one space between words and a line feed at the end. A byte is named by its rank
among what followed the two bytes before it in the corpus, and coded as binary decisions down
a Huffman tree of ranks: some three bits a byte. Ranks are those of 64 classes, the 63 most
frequent bytes and one class for the others, which are told apart by their plain frequencies.

Corpus statistics. For every position of the learning documents and every context (the last
4 and 6 bytes, and the word so far), the byte's rank is counted in a slot of the
hashed context. Tasks count whole partitions, counts of the same slots are added up in two
shuffled rounds, and a slot's subtree sums give, for each node of the tree, the predicted
log-odds of its bit. The tables have a fixed number of slots (``BITS``), so they can be
broadcast whatever the corpus; what flows into them grows with it.

Mixing. The predictions of a bit are added with weights chosen by a gate, the decision's depth
in the tree, and adapted document by document, piece by piece: a piece is scored with the
weights that the text before it left. An adaptive map of the mixed log-odds refines every
decision in the same way, and both are averaged. Every document starts from the same weights, so
a score doesn't depend on other rows' places.

Starting weights and maps are fitted on all learning documents. These are dealt by their text into two
folds, and each fold is predicted from the counts of the other one, so that no document meets its
own counts. A decision's inputs are tallied in steps of half a unit of log-odds; the tallies of all
tasks are added up, and the weights of each depth are the most likely ones of a logistic
regression over them.

Base score: a unigram model over tokens. Counts of the ``HEAD`` most frequent words at most
go to all tasks; the others of each document meet their counts in a shuffled join.

Defined cases: a null or empty text is its end token alone. Rows are scored by themselves;
repeated and null ids are rows like others, and null ids teach nothing. With nothing to
learn from, every byte is coded evenly. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.llm import words
from custody.llm.work import written

BITS = 18  # slots of a hashed context, as a power of two
HEAD = 1 << 17  # words whose counts all tasks get, at most
RATE, REFINE = 0.015, 0.02
_ORDERS = (4, 6)
_INPUTS = len(_ORDERS) + 2  # and the word so far, and a constant
_PAD = 6  # line feeds that stand before a document
_CLASSES = 64
_CELLS = 1 << 14  # cells of a block of counts: 256 slots
_SCALE = 16  # steps of a stored log-odds
_DEPTHS = 12
_BINS = 33  # of an input in the tallies: half units of log-odds from -8 to 8
_BUCKETS = 25  # of the adaptive map, over log-odds from -8 to 8
_FLUSH = 1 << 21  # bytes counted at a time
_HELD = 1 << 22  # distinct cells that a task holds before it sends them
_BATCH = 3 << 17  # bytes scored at a time
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = [0, 256, 1024, 4096]  # where pieces end; then every 8192 bytes


def _slots(order: int) -> int:
    """Slots of a context: all that there are, or hashed ones."""
    return min(1 << (8 * order), 1 << BITS) if order else 1 << BITS


_OFFSETS = np.cumsum([0] + [_slots(o) * _CLASSES for o in (*_ORDERS, 0)])


def tokens(text: bytes | None) -> list[bytes]:
    return words.split(text, lower=True)


def stream(split: list[bytes]) -> bytes:
    return b" ".join(split) + b"\n"


# --- contexts ------------------------------------------------------------------------------


def _cells(data: np.ndarray) -> Iterator[np.ndarray]:
    """First cell of every byte's slot, context by context; documents have _PAD line feeds before them."""
    value = np.zeros(len(data), np.uint64)
    for k, order in enumerate(_ORDERS):
        for back in range(_ORDERS[k - 1] + 1 if k else 1, order + 1):
            value[back:] |= data[:-back].astype(np.uint64) << np.uint64(8 * (back - 1))
        slot = value if 8 * order <= BITS else (value * _ODD) >> np.uint64(64 - BITS)
        yield (slot.astype(np.int64) << 6) + _OFFSETS[k]
    place = np.arange(len(data))
    blank = np.zeros(len(data), np.int64)
    blank[1:] = np.where((data[:-1] == 32) | (data[:-1] == 10), place[1:], 0)
    start = np.maximum.accumulate(blank)
    if len(data) >= len(words._powers):
        words._grow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(words._VALUES[data] * words._powers[: len(data)], out=sums[1:])
    slot = words.mix((sums[:-1] - sums[start]) * words._inverse[start]) >> np.uint64(64 - BITS)
    yield (slot.astype(np.int64) << 6) + _OFFSETS[len(_ORDERS)]


def joined(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All streams in one array, each after its pad, and where each begins."""
    pad = b"\n" * _PAD
    data = np.frombuffer(b"".join(pad + s for s in streams), np.uint8)
    lengths = np.array([len(s) + _PAD for s in streams], np.int64)
    return data, np.cumsum(lengths) - lengths + _PAD


def _coded(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions that are coded: all but the pads."""
    real = np.ones(len(data), bool)
    for back in range(1, _PAD + 1):
        real[starts - back] = False
    return np.flatnonzero(real)


# --- the tree ------------------------------------------------------------------------------


@dataclass
class Tree:
    """Symbols of bytes and the paths to them: node and bit (1 as -1, 0 as 1) of every decision."""

    of: np.ndarray  # class of each byte
    rare: np.ndarray  # nats of each byte within its class
    rank: np.ndarray  # of each class after each two classes
    nodes: np.ndarray
    signs: np.ndarray
    length: np.ndarray
    ones: np.ndarray  # (symbols, nodes): the symbol lies beyond a 1 of the node
    zeros: np.ndarray

    def symbols(self, data: np.ndarray) -> np.ndarray:
        """Every byte's rank after the two bytes before it."""
        c = self.of[data]
        place = c.copy()
        place[1:] += c[:-1] << 6
        place[2:] += c[:-2] << 12
        return self.rank.take(place)


def byte_classes(frequency: np.ndarray) -> np.ndarray:
    """The most frequent bytes are classes of their own, the others one class."""
    of = np.full(256, _CLASSES - 1, np.int64)
    of[np.lexsort((np.arange(256), -frequency))[: _CLASSES - 1]] = np.arange(_CLASSES - 1)
    return of


def tree(frequency: np.ndarray, triples: np.ndarray) -> Tree:
    """Ranks and the Huffman tree over them, from counts of bytes and of three classes in a row.

    Heavy nodes have small numbers.
    """
    of = byte_classes(frequency)
    weight = np.ones(256) + frequency
    rare = np.zeros(256)
    others = of == _CLASSES - 1
    rare[others] = -np.log(weight[others] / weight[others].sum())
    triples = triples.reshape(-1, _CLASSES)
    order = np.argsort(-triples, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(_CLASSES)[None, :], 1)
    symbols = 1 + np.take_along_axis(triples, order, 1).sum(0)
    symbols = np.maximum(symbols, symbols.sum() / 1024)  # no path gets long
    heap: list = [(w, c, c) for c, w in enumerate(symbols.tolist())]
    heapq.heapify(heap)
    made = []
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, _CLASSES + len(made), _CLASSES + len(made)))
        made.append((left, right))
    paths: dict[int, list[tuple[int, int]]] = {_CLASSES + len(made) - 1: []}
    for i in range(len(made) - 1, -1, -1):
        node = len(made) - 1 - i  # the root is 0
        for bit, child in enumerate(made[i]):
            paths[child] = [*paths[_CLASSES + i], (node, bit)]
    length = np.array([len(paths[c]) for c in range(_CLASSES)])
    nodes, bits = np.zeros((2, _CLASSES, length.max()), np.int64)
    ones, zeros = np.zeros((2, _CLASSES, _CLASSES))
    for c in range(_CLASSES):
        for d, (node, bit) in enumerate(paths[c]):
            nodes[c, d], bits[c, d] = node, bit
            (ones if bit else zeros)[c, node] = 1
    signs = (1 - 2 * bits).astype(np.float32)
    return Tree(of, rare, rank.reshape(-1), np.asfortranarray(nodes), np.asfortranarray(signs), length, ones, zeros)


# --- corpus statistics ---------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, item, n): words, three bytes in a row, and ends of the batches' texts."""

    def rows(kind: str, items: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(items), pa.string()), pa.array(items, pa.binary()), pa.array(counts, pa.int64())], ["kind", "item", "n"])

    def triples(streams: list[bytes]) -> pa.RecordBatch:
        data, starts = joined(streams)
        wide = data.astype(np.int32)
        wide[2:] += (wide[1:-1] % 256 << 8) + (wide[:-2] % 256 << 16)
        codes, counts = np.unique(wide[_coded(data, starts)], return_counts=True)
        return rows("triple", [c.to_bytes(3, "big") for c in codes.tolist()], counts.tolist())

    _unpacked.cache_clear()  # of an earlier run in this process
    found: Counter = Counter()
    held, size, ends = [], 0, 0
    for batch in batches:
        for text in words.binaries(batch.column("text")):
            split = tokens(text)
            found.update(split)
            held.append(stream(split))
            size += len(held[-1])
            ends += 1
            if len(found) > 150_000:
                yield rows("word", list(found), list(found.values()))
                found = Counter()
            if size > _FLUSH:
                yield triples(held)
                held, size = [], 0
    yield rows("word", list(found), list(found.values()))
    yield rows("end", [b""], [ends])
    if held:
        yield triples(held)


def _blobs(block: list, cells: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], ["block", "cells", "counts"])


_BLOBS = "block int, cells binary, counts binary"


def _summed(cells: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in ascending order, with how often they occur or the sums of their counts."""
    if counts is None:
        cells = np.sort(cells)
    else:
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), cells[1:] != cells[:-1])))
    if counts is None:
        return cells[first], np.diff(np.append(first, len(cells))).astype(np.uint32)
    return cells[first], np.add.reduceat(counts, first)


def _flushed(cells: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct cells in ascending order, in blocks."""
    block = cells // _CELLS
    inside = (cells % _CELLS).astype(np.uint16)
    cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(cells)), bool), block[1:] != block[:-1])))
    pairs = list(zip(cut.tolist(), np.append(cut[1:], len(cells)).tolist(), strict=True))
    for i in range(0, len(pairs), 256):
        part = pairs[i : i + 256]
        yield _blobs([int(block[a]) for a, _ in part], [inside[a:b].tobytes() for a, b in part], [counts[a:b].tobytes() for a, b in part])


def _counter(shape: Tree):
    """Task that counts (context, rank) cells and yields them in blocks, those of a later fold behind the first one's."""

    def counted(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        data, starts = joined(streams)
        real = _coded(data, starts)
        symbols = shape.symbols(data)[real]
        return [_summed((cells[real] + symbols).astype(np.int32)) for cells in _cells(data)]

    def added(parts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        return [_summed(np.concatenate([c for c, _ in own]), np.concatenate([n for _, n in own])) for own in zip(*parts, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds: dict[int, tuple[list, list]] = {}
        size = 0

        def count() -> None:
            for fold, (held, parts) in folds.items():
                if held:
                    parts.append([(c + np.int32(fold * _OFFSETS[-1]), n) for c, n in counted(held)])
                    held.clear()
                if len(parts) >= 4:
                    parts[:] = [added(parts)]

        for batch in batches:
            marks = batch.column("fold").to_pylist() if "fold" in batch.schema.names else [0] * batch.num_rows
            for text, fold in zip(words.binaries(batch.column("text")), marks, strict=True):
                held = folds.setdefault(fold, ([], []))[0]
                held.append(stream(tokens(text)))
                size += len(held[-1])
                if size >= _FLUSH:
                    count()
                    size = 0
                    if sum(len(c) for _, parts in folds.values() for own in parts for c, _ in own) > _HELD:
                        for _, parts in folds.values():
                            for cells, counts in added(parts) if parts else []:
                                yield from _flushed(cells, counts)
                            parts.clear()
        count()
        for _, parts in folds.values():
            for cells, counts in added(parts) if parts else []:
                yield from _flushed(cells, counts)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Added up cells of every block; its rows follow each other."""
    at, total = None, np.zeros(_CELLS, np.int64)
    for batch in batches:
        for block, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "counts")), strict=True):
            if block != at:
                if at is not None:
                    yield at, total
                at, total = block, np.zeros(_CELLS, np.int64)
            total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint64 if len(counts) == 4 * len(cells) else np.uint32).astype(np.int64)
    if at is not None:
        yield at, total


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, total in _blocks(batches):
        cells = np.flatnonzero(total)
        yield _blobs([block], [cells.astype(np.uint16).tobytes()], [total[cells].astype(np.uint64).tobytes()])


def _odds(shape: Tree, folds: int):
    """Task that turns added up cells into log-odds of every node's bit, in 256 steps: of all folds, and of each if there are more.

    A block of all folds comes first, then that of each fold.
    """
    blocks = int(_OFFSETS[-1]) // _CELLS

    def odds(counts: np.ndarray) -> bytes:
        counts = counts.reshape(-1, _CLASSES).astype(float)
        found = np.log((counts @ shape.ones + 0.3) / (counts @ shape.zeros + 0.3))
        return np.clip(np.rint(found * _SCALE), -127, 127).astype(np.int8).tobytes()

    def out(block: int, own: dict[int, np.ndarray]) -> pa.RecordBatch:
        kinds = {0: sum(own.values())} | ({1 + f: n for f, n in own.items()} if folds > 1 else {})
        return _blobs([block + blocks * k for k in kinds], [odds(n) for n in kinds.values()], [b""] * len(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}
        for block, total in _blocks(batches):
            if at is not None and block % blocks != at:
                yield out(at, own)
                own = {}
            at = block % blocks
            own[block // blocks] = total
        if own:
            yield out(at, own)

    return run


def _totals(found: DataFrame) -> DataFrame:
    """Blocks added up in a first shuffled round."""
    found = found.withColumn("salt", F.spark_partition_id() % 16).repartition("block", "salt").sortWithinPartitions("block", "salt")
    return found.drop("salt").mapInArrow(_added, _BLOBS)  # a block of another salt may follow: then it is added up later


def _shape(triples: DataFrame) -> Tree:
    """The tree from counts of three bytes in a row; their classes make 2**18 rows at most."""
    number = [F.conv(F.hex(F.substring("item", k, 1)), 16, 10).cast("int") for k in (1, 2, 3)]
    frequency = np.zeros(256)
    for r in triples.groupBy(number[2].alias("b")).agg(F.sum("n").alias("n")).collect():
        frequency[r["b"]] = r["n"]
    of = F.lit(byte_classes(frequency).tolist())
    a, b, c = (F.element_at(of, x + 1) for x in number)
    counts = np.zeros(_CLASSES**3)
    for r in triples.groupBy((a * _CLASSES**2 + b * _CLASSES + c).alias("k")).agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    return tree(frequency, counts)


def statistics(texts: DataFrame, shape: Tree) -> np.ndarray:
    """The table of log-odds, one byte a cell, from all texts.

    With a column ``fold`` (0 or 1) three tables: of all texts, then of each fold's.
    """
    folds = 2 if "fold" in texts.columns else 1
    own = F.col("block") % (int(_OFFSETS[-1]) // _CELLS)
    found = _totals(texts.select("text", *["fold"][: folds - 1]).mapInArrow(_counter(shape), _BLOBS))
    found = found.repartition(own).sortWithinPartitions(own, "block").mapInArrow(_odds(shape, folds), _BLOBS)
    table = np.zeros(int(_OFFSETS[-1]) * (3 if folds > 1 else 1), np.int8)
    for r in found.select("block", "cells").toLocalIterator():
        table[r["block"] * _CELLS : (r["block"] + 1) * _CELLS] = np.frombuffer(r["cells"], np.int8)
    return table.reshape(3, -1) if folds > 1 else table


# --- mixing --------------------------------------------------------------------------------


@dataclass
class Model:
    shape: Tree
    table: np.ndarray
    weights: np.ndarray  # depth, input
    refine: np.ndarray  # depth, bucket


def _start(shape: Tree, table: np.ndarray) -> Model:
    weights = np.full((_DEPTHS, _INPUTS), 0.3, np.float32)
    weights[:, -1] = 0
    return Model(shape, table, weights, np.tile(np.linspace(-8, 8, _BUCKETS, dtype=np.float32), (_DEPTHS, 1)))


@lru_cache(maxsize=1)
def _unpacked(packed: bytes) -> np.ndarray:
    """The table in a task's process; most cells of a small corpus are zero, so it travels packed."""
    return np.frombuffer(zlib.decompress(packed), np.int8)


def _bounds(longest: int) -> list[int]:
    return [*_STEPS, *range(8192, longest + 8192, 8192)]


def mixed(streams: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nats of each stream, and the weights and maps that it ends with."""
    shape, table = model.shape, model.table
    data, starts = joined(streams)
    lengths = np.array([len(s) for s in streams], np.int64)
    contexts = list(_cells(data))
    symbols = shape.symbols(data)
    docs = len(streams)
    weights = np.tile(model.weights, (docs, 1, 1))
    refine = np.tile(model.refine, (docs, 1, 1))
    real = _coded(data, starts)
    nats = np.bincount(np.repeat(np.arange(docs), lengths), shape.rare[data[real]], docs)
    bounds = _bounds(int(lengths.max()))
    for low, high in zip(bounds, bounds[1:], strict=False):
        alive = np.flatnonzero(lengths > low)
        if not len(alive):
            break
        n = np.minimum(lengths[alive], high) - low
        at = np.arange(n.sum()) + np.repeat(starts[alive] + low - (np.cumsum(n) - n), n)
        sizes = np.zeros(docs, np.int64)
        sizes[alive] = n
        _piece(shape, table, [c[at] for c in contexts], symbols[at], sizes, weights, refine, nats)
    return nats, weights, refine


def _piece(shape: Tree, table: np.ndarray, cells: list, symbols: np.ndarray, sizes: np.ndarray, weights: np.ndarray, refine: np.ndarray, nats: np.ndarray) -> None:
    """Score one piece of all documents, depth by depth, then move weights and maps along its errors.

    Bytes are ordered by document; ``sizes`` counts each one's.
    """
    moves = []
    moved, met = np.zeros((2, refine.size))
    maps = refine.reshape(-1)
    scale = np.float32(1 / _SCALE)
    groups = np.flatnonzero(sizes)
    sizes = sizes[groups]
    for depth in range(shape.nodes.shape[1]):
        if depth:
            deeper = shape.length[symbols] > depth
            sizes = np.add.reduceat(deeper, first, dtype=np.int64)
            kept = np.flatnonzero(deeper)
            if not len(kept):
                break
            cells = [c.take(kept) for c in cells]
            symbols = symbols.take(kept)
            groups, sizes = groups[sizes > 0], sizes[sizes > 0]
        first = np.cumsum(sizes) - sizes
        d = min(depth, _DEPTHS - 1)
        node = shape.nodes[:, depth].take(symbols)
        sign = shape.signs[:, depth].take(symbols)  # -1 for a bit 1
        own = weights[groups, d] * scale
        mix = np.repeat(own[:, -1] / scale, sizes)
        inputs = []
        for k, c in enumerate(cells):
            inputs.append(table.take(c + node).astype(np.float32))
            mix += np.repeat(own[:, k], sizes) * inputs[-1]
        np.clip(mix, -7.99, 7.99, out=mix)
        wrong = 1 / (1 + np.exp(-mix * sign))  # probability of the other bit
        error = sign * wrong
        step = (np.minimum(sizes, 64) / sizes * RATE).astype(np.float32)  # a long piece counts as 64 steps
        gradient = np.stack([np.add.reduceat(error * x, first) * scale for x in inputs] + [np.add.reduceat(error, first)], 1)
        moves.append((groups, d, gradient * step[:, None]))
        place = (mix + 8) * np.float32((_BUCKETS - 1) / 16)
        left = place.astype(np.int64)
        part = place - left
        left += np.repeat((groups * _DEPTHS + d) * _BUCKETS, sizes)
        low = maps.take(left)
        fine = low + (maps.take(left + 1) - low) * part
        wrong_fine = 1 / (1 + np.exp(-fine * sign))
        right = 1 - np.float32(0.5) * (wrong + wrong_fine)
        near = left + (part > 0.5)
        moved += np.bincount(near, sign * wrong_fine, moved.size)
        met += np.bincount(near, minlength=met.size)
        nats -= np.bincount(groups, np.add.reduceat(np.log(np.maximum(right, np.float32(1e-4))), first), len(nats))
    for groups, d, move in moves:
        weights[groups, d] -= move
    maps -= (moved * REFINE * np.minimum(met, 64) / np.maximum(met, 1)).astype(np.float32)


def _batched(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Rows of other columns and tokens, some _BATCH bytes at a time."""
    rows, split, size = [], [], 0
    for batch in batches:
        for text, *other in zip(words.binaries(batch.column("text")), *(batch.column(c).to_pylist() for c in columns), strict=True):
            rows.append(other)
            split.append(tokens(text))
            size += len(text or b"") + _PAD + 1
            if size >= _BATCH:
                yield rows, split
                rows, split, size = [], [], 0
    if rows:
        yield rows, split


# --- starting weights ----------------------------------------------------------------------


def _tallied(streams: list[bytes], shape: Tree, table: np.ndarray) -> np.ndarray:
    """How often each (depth, bins of the inputs, bit) occurs."""
    data, starts = joined(streams)
    real = _coded(data, starts)
    cells = [c[real] for c in _cells(data)]
    symbols = shape.symbols(data)[real]
    bins = (np.arange(256) + 4 >> 3).astype(np.int64)  # of a log-odds read as unsigned, from -128 on
    places = [np.roll(bins * 2 * _BINS**k, 128) for k in range(len(cells))]
    size = 2 * _BINS ** len(cells)
    found = np.zeros((_DEPTHS, size), np.int64)
    for depth in range(shape.nodes.shape[1]):
        if depth:
            kept = np.flatnonzero(shape.length[symbols] > depth)
            if not len(kept):
                break
            cells, symbols = [c.take(kept) for c in cells], symbols.take(kept)
        node = shape.nodes[:, depth].take(symbols)
        at = (shape.signs[:, depth].take(symbols) < 0).astype(np.int64)
        for c, place in zip(cells, places, strict=True):
            at += place.take(table.take(c + node).view(np.uint8))
        found[min(depth, _DEPTHS - 1)] += np.bincount(at, minlength=size)
    return found.reshape(-1)


def _tally(texts: DataFrame, shape: Tree, packed: Broadcast) -> DataFrame:
    """Blocks of the tallies of all texts, predicted from a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, split in _batched(batches):
            total = total + _tallied([stream(s) for s in split], shape, _unpacked(packed.value))
        if np.ndim(total):
            cells = np.flatnonzero(total)
            yield from _flushed(cells, total[cells].astype(np.uint32))

    return texts.select("text").mapInArrow(run, _BLOBS)


def _regressed(tally: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The most likely weights of one depth; what no decision speaks for stays as it was."""
    at = np.flatnonzero(tally.sum(1))
    inputs = np.stack([(at // _BINS**k % _BINS - 16) / 2 for k in range(_INPUTS - 1)] + [np.ones(len(at))], 1)
    zeros, ones = tally[at].T.astype(float)
    weights = start.astype(float)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -7.99, 7.99)))
        slope = inputs.T @ ((zeros + ones) * p - ones) + weights - start
        bend = (inputs.T * ((zeros + ones) * p * (1 - p))) @ inputs + np.eye(_INPUTS)
        weights -= np.clip(np.linalg.solve(bend, slope), -0.5, 0.5)
    return weights


def _calibrated(tally: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The map of one depth: what the mixed log-odds of each bucket are short of the seen ones is added to them."""
    at = np.flatnonzero(tally.sum(1))
    mix = weights[-1] + sum(w * (at // _BINS**k % _BINS - 16) / 2 for k, w in enumerate(weights[:-1]))
    mix = np.clip(mix, -7.99, 7.99)
    near = np.rint((mix + 8) * (_BUCKETS - 1) / 16).astype(np.int64)
    zeros, ones = (np.bincount(near, tally[at, bit], _BUCKETS) + 1 for bit in (0, 1))
    said = np.bincount(near, tally[at].sum(1) / (1 + np.exp(-mix)), _BUCKETS) + 1
    return np.linspace(-8, 8, _BUCKETS) + np.log(ones / zeros) - np.log(said / (zeros + ones - said))


def fit(texts: DataFrame, shape: Tree, tables: list[Broadcast]) -> Model:
    """Starting weights and maps from all texts, each predicted from the packed table of the other ``fold``."""
    parts = [_tally(texts.where(F.col("fold") == f), shape, tables[1 - f]) for f in (0, 1)]
    found = _totals(parts[0].union(parts[1])).repartition("block").sortWithinPartitions("block").mapInArrow(_added, _BLOBS)
    tally = np.zeros(_DEPTHS * 2 * _BINS ** (_INPUTS - 1))
    for r in found.collect():  # as many cells at most, whatever the corpus
        tally[r["block"] * _CELLS + np.frombuffer(r["cells"], np.uint16).astype(np.int64)] = np.frombuffer(r["counts"], np.uint64)
    model = _start(shape, np.empty(0, np.int8))
    for d, own in enumerate(tally.reshape(_DEPTHS, -1, 2)):
        if own.any():
            weights = _regressed(own, model.weights[d])
            model.weights[d], model.refine[d] = weights, _calibrated(own, weights)
    return model


# --- scores --------------------------------------------------------------------------------


def _head(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """The most frequent words, at most ``most`` of them, and the least count that all such words have."""
    octave = F.floor(F.log2("n") * 16)
    sizes = counts.where("kind = 'word'").groupBy(octave.alias("octave")).agg(F.count("*").alias("n"), F.min("n").alias("least"))
    room, least = most, None
    for r in sorted(sizes.collect(), key=lambda r: -r["octave"]):  # sixteenths of octaves: a thousand rows at most
        room -= r["n"]
        if room < 0:
            break
        least = r["least"]
    if least is None:
        return {}, 1 << 62
    return {bytes(r["item"]): r["n"] for r in counts.where((F.col("kind") == "word") & (F.col("n") >= least)).select("item", "n").collect()}, least


def score(docs: DataFrame, learning: Column, head: int = HEAD) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every document.

    ``learning`` says which documents are learned from. Scores are log10 probabilities of
    the token sequence.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learning, F.lit(False)).alias("learns"))
    taught = rows.where("learns")
    counts = taught.select("text").mapInArrow(_count_words, "kind string, item binary, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"))
    counts = written(counts, "token-counts")
    totals = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("items")).collect()}
    ends = totals["end"]["n"] if "end" in totals else 0
    train = ends + (totals["word"]["n"] if "word" in totals else 0)
    known = (totals["word"]["items"] if "word" in totals else 0) + (ends > 0)
    frequent, least = _head(counts, head)
    shape = _shape(counts.where("kind = 'triple'"))
    dealt = taught.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))
    packed, *halves = (spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1)) for table in statistics(dealt, shape))
    model = fit(dealt, shape, halves)
    shared = spark.sparkContext.broadcast((model.weights, model.refine, frequent))
    scale = train + 0.1 * (known + 1)
    schema = "doc_id long, n_tokens long, n_known long, base double, nats double, n_bytes long, tail array<struct<item:binary,tf:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, refine, frequent = shared.value
        model = Model(shape, _unpacked(packed.value), weights, refine)
        for ids, split in _batched(batches, "doc_id"):
            streams = [stream(s) for s in split]
            nats = mixed(streams, model)[0]
            out = []
            for (doc_id,), text, coded, cost in zip(ids, split, streams, nats.tolist(), strict=True):
                n_known, found, tail = int(ends > 0), [(1, ends)], []
                for word, tf in Counter(text).items():
                    n = frequent.get(word)
                    if n is None:
                        tail.append(dict(item=word, tf=tf))
                    else:
                        n_known += tf
                        found.append((tf, n))
                tf, n = np.array(found, float).T
                out.append((doc_id, len(text) + 1, n_known, float(tf @ np.log10((n + 0.1) / scale)), cost, len(coded), tail))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.struct([("item", pa.binary()), ("tf", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_tokens", "n_known", "base", "nats", "n_bytes", "tail"])

    found = written(rows.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    tail = found.select("row", F.explode("tail").alias("t")).select("row", "t.item", "t.tf")
    fewer = counts.where((F.col("kind") == "word") & (F.col("n") < least)).select("item", "n")
    met = tail.join(fewer.hint("merge"), "item", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = met.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * F.log10((F.col("n") + 0.1) / F.lit(float(scale)))).alias("low"))
    both = found.drop("tail").join(rest, "row", "left")
    nats = F.col("nats")
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("low", F.lit(0.0))).alias("base_score"),
        (-nats / np.log(10)).alias("score"),
        "n_bytes",
        (nats / F.lit(float(np.log(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
