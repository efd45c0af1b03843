"""Near-duplicate documents by chosen-path set similarity join.

1. Each document becomes its set of word shingles; equal sets are one class, held by the
   smallest id. Of each class's set the values of HASHES minwise functions are kept.
2. Independent trees branch the classes: a node picks, by a hash of itself, BRANCHES of the
   minwise functions, and a class goes to the child of each picked function and its token
   there. A pair of similarity J goes on together along a branch with probability J, so with
   two branches it meets in a tree of DEPTH levels with more than 0.94 at J = 0.8, and misses
   all TREES trees with about 1 in 80,000. Nodes of at most NODE classes are compared
   exhaustively, by two bits of every minwise value. Larger nodes are compared with their
   first class: classes of which at most _JOINED values differ from its values join its group.
   A node whose classes that joins, or links of the first levels in whatever node, is
   finished; else those go on, again by BRANCHES functions a level, that may be close to an
   open class: differing values are a metric, so a class is _FAR values away at most from
   classes close to it, and one nearer to the first class than the least open class by more
   than that is done here. What still is large after LEVELS levels is linked to its first
   class unseen.
3. Links join classes into candidate groups, a superset of the true ones. In each group the
   full sets are compared exactly: a search from class to class that asks only for classes not
   reached yet. A group of more than CHUNK classes is cut into chunks, each with the group's
   first class; what is not joined to the largest part then is compared with all chunks.
   So all exact links that can join two parts are asked, and no group meets in one task.

Defined cases: a null text or one without words has an empty set and links with nothing; a
text of fewer words than a shingle is one shingle. Repeated rows are one class. A null id
links with nothing, has no component and is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custody.llm import words
from custody.llm.work import connected_components, written

HASHES = 128
TREES, BRANCHES, DEPTH, LEVELS = 4, 2, 3, 4
NODE = 48
CHUNK = 200
SALTS = 32
# 2-bit agreement of sets at similarity J is J + (1 - J) / 4 of HASHES; five deviations are
# left below what J = 0.8 gives, so a link is lost here once in some million.
_FAR = HASHES - 88
# Classes this near to the first one of a large node join its group, a superset that full sets
# judge later; some J = 0.42, so texts that only share a stock of words seldom join.
_JOINED = 56
_LOW = 0x5555555555555555
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """HASHES minwise values of a set, taken over pieces of it to bound memory."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        best = np.minimum(best, (low[at : at + 4096, None] * _A + _B).min(axis=0))
    return best


def children(nodes: np.ndarray, mins: np.ndarray) -> np.ndarray:
    """(n, m) nodes of n classes to their (n, m * BRANCHES) children."""
    picked = words.mix(nodes + np.uint64(0x1234567))
    out = []
    for j in range(BRANCHES):
        at = (picked >> np.uint64(8 * j)) % np.uint64(HASHES // BRANCHES) + np.uint64(j * (HASHES // BRANCHES))
        token = np.take_along_axis(mins, at.astype(np.int64), axis=1).astype(np.uint64)
        out.append(words.mix((nodes * np.uint64(0x9E3779B97F4A7C15)) ^ words.mix(token + (at << np.uint64(32)))))
    return np.concatenate(out, axis=1)


def roots(mins: np.ndarray) -> np.ndarray:
    nodes = np.broadcast_to(words.mix(np.arange(1, TREES + 1, dtype=np.uint64)), (len(mins), TREES))
    for _ in range(DEPTH):
        nodes = children(nodes, mins)
    return nodes


def _mins_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, mins) per row; digest and mins are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, mins = [], [], []
            for text in words.binaries(batch.column("text")):
                s = words.shingle_set(words.word_hashes(text, lower=True), size)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                mins.append(minwise(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(mins, pa.binary())], ["doc_id", "n_shingles", "digest", "mins"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, mins binary")


def _sketched(reps: DataFrame) -> DataFrame:
    """(rep, s0..s3): two bits of each minwise value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            mins = _mins_of(batch.column("mins"))
            bits = np.stack((mins & 1, (mins >> np.uint32(1)) & 1), axis=2).astype(np.uint8).reshape(len(mins), -1)
            longs = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("rep"), *(pa.array(np.ascontiguousarray(longs[:, k])) for k in range(4))], ["rep", "s0", "s1", "s2", "s3"])

    return reps.mapInArrow(run, "rep long, s0 long, s1 long, s2 long, s3 long")


def _branched(reps: DataFrame, from_node: bool) -> DataFrame:
    """(node, rep) of the first levels at once, or the children of the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            mins = _mins_of(batch.column("mins"))
            rep = batch.column("rep").to_numpy()
            if from_node:
                nodes = children(batch.column("node").to_numpy().view(np.uint64)[:, None], mins)
            else:
                nodes = roots(mins)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.reshape(-1).view(np.int64)), pa.array(np.repeat(rep, nodes.shape[1]))], ["node", "rep"])

    return reps.mapInArrow(run, "node long, rep long")


def _compare_nodes(rows: DataFrame) -> DataFrame:
    """(a, b) links that join the close classes of each small node."""

    def links(node: np.ndarray, rep: np.ndarray, s: np.ndarray) -> tuple[list[int], list[int]]:
        parent: dict[int, int] = {}

        def top(i: int) -> int:
            while parent.get(i, i) != i:
                i = parent[i]
            return i

        for gap in range(1, len(node)):
            i = np.flatnonzero(node[:-gap] == node[gap:])
            if not len(i):
                break
            x = s[i] ^ s[i + gap]
            far = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_LOW)).sum(axis=1)
            for k in i[far <= _FAR].tolist():
                p, q = top(k), top(k + gap)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        pairs = [(int(rep[top(i)]), int(rep[i])) for i in parent]
        return [p[0] for p in pairs], [p[1] for p in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches_with_end(batches):
            if batch is None:
                now, held = held, None
            else:
                new = [batch.column(c).to_numpy() for c in ("node", "rep", "s0", "s1", "s2", "s3")]
                now = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
                cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last node may go on
                held, now = [x[cut:] for x in now], [x[:cut] for x in now]
            if now is None or not len(now[0]):
                continue
            a, b = links(now[0], now[1], np.stack(now[2:], axis=1).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def batches_with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _salted(of_pivot: DataFrame) -> DataFrame:
    """A copy for every salt: one pivot may lead a third of all rows, whose salt is their rep's."""
    return of_pivot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _from_pivot(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """(pivot, rep, apart, and with labelled sketches label, own) of the distinct pairs of a class and the first class of a large node of it."""
    s = ["s0", "s1", "s2", "s3"]
    named = [c for c in ("label",) if c in sketches.columns]
    pairs = large.select("pivot", "rep").distinct().join(sketches, "rep").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    first = sketches.select(F.col("rep").alias("pivot"), *[F.col(c).alias(f"p{c}") for c in s], *[F.col(c).alias("own") for c in named])
    first = first.join(large.select("pivot").distinct(), "pivot")
    apart = sum((F.bit_count((F.col(c).bitwiseXOR(F.col(f"p{c}"))).bitwiseOR(F.shiftrightunsigned(F.col(c).bitwiseXOR(F.col(f"p{c}")), 1)).bitwiseAND(F.lit(_LOW))) for c in s), F.lit(0))
    return written(pairs.join(_salted(first), ["pivot", "salt"]).select("pivot", "rep", apart.alias("apart"), *named, *["own" for _ in named]), "pivots")


def _labelled(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the labels of both, for pairs that were judged before there were labels."""
    of_rep = judged.join(labels.select("rep", F.col("component_id").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    own = judged.select("pivot").distinct().join(labels, F.col("pivot") == F.col("rep"), "left").select("pivot", F.coalesce("component_id", "pivot").alias("own"))
    return of_rep.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(_salted(own), ["pivot", "salt"])


def _unfinished(large: DataFrame, judged: DataFrame) -> DataFrame:
    """(node, rep) of the large nodes with open classes, which nothing has joined to the first one: these and all that may be close to one."""
    is_open = (F.col("apart") > _JOINED) & (F.col("label") != F.col("own"))
    placed = large.select("node", "pivot", "rep").join(judged.select("pivot", "rep", "apart", is_open.alias("open")), ["pivot", "rep"])
    placed = written(placed.select("node", "rep", "apart", "open"), "placed")
    least = placed.where("open").groupBy("node").agg(F.min("apart").alias("least"))
    return written(placed.join(least.hint("merge"), "node").where(F.col("apart") >= F.col("least") - _FAR).select("node", "rep"), "unfinished")


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(rep, grp): the groups of classes that some tree found close; reps (rep, mins)."""
    sketches = written(_sketched(reps), "sketches")
    rows, found, labels = _branched(reps, from_node=False), None, None
    for level in range(LEVELS):
        shared = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1")
        met = written(rows.join(shared, "node"), "nodes")
        links = _compare_nodes(met.where(F.col("n") <= NODE).join(sketches, "rep").select("node", "rep", "s0", "s1", "s2", "s3"))
        links = links if found is None else found.union(links)
        large = met.where(F.col("n") > NODE)
        if large.isEmpty():
            found = links
            break
        if level + 1 == LEVELS:
            found = links.union(large.select("pivot", "rep").distinct())
            break
        judged = _from_pivot(large, sketches)
        found = links.union(judged.where(F.col("apart") <= _JOINED).select("pivot", "rep"))
        if labels is None:
            labels = written(connected_components(found, "a", "b", "rep"), "labels")
            judged = _labelled(judged, labels)
            named = sketches.join(labels.select("rep", F.col("component_id").alias("label")), "rep", "left")
            sketches = written(named.withColumn("label", F.coalesce("label", "rep")), "sketches")
            found = labels.select(F.col("component_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
        still = _unfinished(large, judged)
        if still.isEmpty():
            if level == 0:
                return labels.withColumnRenamed("component_id", "grp")
            break
        rows = _branched(still.join(reps, "rep").select("node", "rep", "mins"), from_node=True).distinct()
    return written(connected_components(found, "a", "b", "rep").withColumnRenamed("component_id", "grp"), "groups")


class Group:
    """Sets of one chunk, for intersections of one of them with many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        distinct, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)

    def linked(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``others`` with 100 * intersection >= percent * union."""
        own = self.codes[self.offsets[i] : self.offsets[i + 1]]
        self.mark[own] = True
        near = others[(100 * np.minimum(self.sizes[others], self.sizes[i]) >= percent * np.maximum(self.sizes[others], self.sizes[i]))]
        if 2 * self.sizes[near].sum() > len(self.codes):  # one pass over all sets costs less than one a set
            shared = np.add.reduceat(self.mark[self.codes], self.offsets[:-1], dtype=np.int64)[near]
        else:
            shared = np.array([np.count_nonzero(self.mark[self.codes[self.offsets[j] : self.offsets[j + 1]]]) for j in near], dtype=np.int64)
        self.mark[own] = False
        return near[100 * shared >= percent * (self.sizes[near] + self.sizes[i] - shared)] if len(near) else near


def joined(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of the sets."""
    group, left, out = Group(sets), np.arange(len(sets)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            got = group.linked(i, left, percent)
            out += [(i, int(j)) for j in got]
            queue += got.tolist()
            left = np.setdiff1d(left, got, assume_unique=True)
    return out


def crossed(sets: list[np.ndarray], asked: list[bool], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Links from the asked sets to sets of other labels, one a label."""
    group, names, out = Group(sets), np.array(labels), []
    rest = np.flatnonzero(~np.array(asked))
    for i in np.flatnonzero(asked):
        got = group.linked(int(i), rest[names[rest] != names[i]], percent)
        out += [(int(i), int(j)) for j in got[np.unique(names[got], return_index=True)[1]]] if len(got) else []
    return out


def _by_chunk(rows: DataFrame, keys: list[str], work, percent: int) -> DataFrame:
    """Links (a, b) that ``work`` finds among the rows of each key; a key has a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def links() -> pa.RecordBatch:
            sets = [np.frombuffer(r[1], np.uint64) for r in held]
            got = work(sets, held, percent)
            a, b = [held[i][0] for i, _ in got], [held[j][0] for _, j in got]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("rep", "set", "asked", "label")]
            of = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            for k, row in zip(of, zip(*columns, strict=True), strict=True):
                if k != key:
                    if len(held) > 1:
                        yield links()
                    held, key = [], k
                held.append(row)
        if len(held) > 1:
            yield links()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def exact_links(docs: DataFrame, groups: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) pairs whose components are the exact ones inside the candidate groups (rep, grp)."""
    counted = groups.join(groups.groupBy("grp").agg(F.count("*").alias("m")), "grp").select("rep", "grp", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [words.shingle_set(words.word_hashes(t, lower=True), size).tobytes() for t in words.binaries(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "grp", "chunks")), pa.array(sets, pa.binary())], ["rep", "grp", "chunks", "set"])

    # always by shuffle: candidates grow with the corpus, so one plan serves all sizes
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(counted.hint("merge"), "rep").select("rep", "grp", "chunks", "text")
    sets = written(texts.mapInArrow(run, "rep long, grp long, chunks int, set binary"), "sets")
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    all_chunks = F.sequence(F.lit(0), F.col("chunks") - 1)
    rows = sets.select("rep", "grp", "chunks", "set", F.explode(F.when(F.col("rep") == F.col("grp"), all_chunks).otherwise(F.array(own))).alias("chunk"))
    first = _by_chunk(rows.withColumns({"asked": F.lit(True), "label": F.col("rep")}), ["grp", "chunk"], lambda s, _, p: joined(s, p), percent)
    first = written(first, "exact")
    if counted.where("chunks > 1").isEmpty():
        return first
    labels = written(connected_components(first, "a", "b", "rep"), "labels")
    big = written(counted.where("chunks > 1").join(labels, "rep", "left").select("rep", "grp", "chunks", F.coalesce("component_id", "rep").alias("label")), "labels")
    parts = big.groupBy("grp", "label").agg(F.count("*").alias("n"))
    hub = parts.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("hub"))
    judged = written(big.join(hub, "grp").select("rep", "grp", "chunks", "label", (F.col("label") != F.col("hub")).alias("outside")), "outside")
    blocks = judged.where("outside").groupBy("grp").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks"))
    if blocks.isEmpty():
        return first
    again = written(sets.select("rep", "set").join(judged, "rep").join(blocks, "grp"), "sets")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    asked = again.where("outside").select("rep", "set", "label", F.lit(True).alias("asked"), "grp", block.alias("block"), F.explode(all_chunks).alias("chunk"))
    rest = again.select("rep", "set", "label", F.lit(False).alias("asked"), "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), own.alias("chunk"))
    cross = _by_chunk(asked.union(rest), ["grp", "block", "chunk"], lambda s, held, p: crossed(s, [h[2] for h in held], [h[3] for h in held], p), percent)
    return labels.select(F.col("component_id").alias("a"), F.col("rep").alias("b")).where("a <> b").union(cross)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document; candidates are sought for 80 percent and more."""
    if percent < 80:
        raise ValueError("trees and sketches find links of 80 percent and more")
    own = written(signatures(docs, size), "signatures")
    full = own.where("doc_id is not null and digest is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = written(full.select(F.col("doc_id").alias("rep"), "mins").join(classes.select("rep"), "rep", "left_semi").dropDuplicates(["rep"]), "reps")
    exact = exact_links(docs, candidate_groups(reps), size, percent)
    parts = connected_components(exact, "a", "b", "rep")
    of_class = classes.join(parts, "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    out = own.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
