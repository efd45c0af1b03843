"""Removal of repeated passages by matching statistics over compressed full-text indexes.

A passage is repeated if a window of ``window`` consecutive words also starts earlier, in a
document of a smaller id or earlier in the same one. All words covered by repeated windows go.

1. Each window has an anchor, its least ANCHOR-word gram by hash, the leftmost of equal ones.
   Equal windows have equal anchors, so windows meet by anchors. The windows of one anchor
   place are neighbours and make up a context. Only contexts whose anchor occurs again are used.
2. Contexts are dealt to shards by anchor. A shard indexes its distinct contexts (equal ones
   once, with their first place) in an FM-index and streams them through backward search;
   each window's matches tell its first place in the corpus. An anchor of more than
   SHARD_CONTEXTS places can have that many distinct contexts, so it goes to no shard: the
   windows of its distinct contexts meet by fingerprint, in an aggregate and a join that
   Spark combines and splits.
3. Marks of windows go back to their documents.

A document equal to an earlier one is settled by its digest: all of it goes. A passage that a
third of all documents hold is merged before it moves and spread again by Spark's skew join.

Defined cases: a null text has no words; a text shorter than a window loses nothing; rows of
one id are one document listed more than once (they should be equal); a row without id
neither loses anything nor counts for others. Other columns are kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custody.llm import words
from custody.llm.fmindex import FMIndex
from custody.llm.work import written

WINDOW = 20
ANCHOR = 5
SHARD_CONTEXTS = 8000


def contexts(hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first window, last window) of each anchor place, in order."""
    empty = np.empty(0, np.int64)
    if len(hashes) < window:
        return np.empty(0, np.uint64), empty, empty, empty
    grams = words.grams(hashes, min(ANCHOR, window))
    span = len(grams) - (len(hashes) - window)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    at = view.argmin(axis=1) + np.arange(len(view))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    place = at[first]
    return grams[place], place, first, np.append(first[1:], len(at)) - 1


def shares(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Digests (doc_id, digest, n_words) and anchors (anchor, doc_id, place) of the documents."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [words.split(t) for t in words.binaries(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in split], pa.binary()), pa.array([len(w) for w in split], pa.int64())], ["doc_id", "digest", "n_words"]
            )

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                found = [contexts(words.word_hashes(t), window)[:2] for t in words.binaries(part.column("text"))]
                counts = [len(f[0]) for f in found]
                ids = np.repeat(part.column("doc_id").to_numpy(), counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), pa.array(ids), pa.array(np.concatenate([f[1] for f in found]).astype(np.int32))], ["anchor", "doc_id", "place"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    return rows.mapInArrow(digests, "doc_id long, digest binary, n_words long"), rows.mapInArrow(anchors, "anchor long, doc_id long, place int")


def _cut(docs: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """(anchor, hot, content, doc_id, first, n, body): contexts at the given places of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c) for c in ("places", "hot")]
            for doc_id, text, places, crowded in zip(batch.column("doc_id").to_pylist(), words.binaries(batch.column("text")), *columns, strict=True):
                hashes = words.word_hashes(text)
                anchor, place, first, last = contexts(hashes, window)
                hot = np.isin(place, crowded.values.to_numpy())
                for k in np.flatnonzero(np.isin(place, places.values.to_numpy())).tolist():
                    body = hashes[first[k] : last[k] + window]
                    raw = body.tobytes()
                    # the place of the anchor tells apart equal words under another anchor place
                    content = xxhash.xxh3_64_intdigest(raw, seed=int(place[k] - first[k])) - (1 << 63)
                    out.append((int(anchor[k].view(np.int64)), bool(hot[k]), content, doc_id, int(first[k]), int(last[k] - first[k]) + 1, (body >> np.uint64(32)).astype(np.uint32).tobytes() + (body & np.uint64(0xFF)).astype(np.uint8).tobytes()))
                if len(out) > 20_000:
                    yield as_batch(out)
                    out = []
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "hot", "content", "doc_id", "first", "n", "body"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(repeated.hint("merge"), "doc_id").select("doc_id", "text", "places", "hot")
    return texts.mapInArrow(run, "anchor long, hot boolean, content long, doc_id long, first int, n int, body binary")


def _body(raw: bytes) -> np.ndarray:
    """Words of a context, 40 bits each: windows that differ in one word are taken as equal once in 10**12."""
    n = len(raw) // 5
    return (np.frombuffer(raw, np.uint32, n).astype(np.uint64) << np.uint64(8)) | np.frombuffer(raw, np.uint8, n, 4 * n)


def repeated_windows(rows: list[tuple], window: int) -> list[int]:
    """Bits of the windows of each distinct context that start earlier elsewhere; rows (doc_id, first, body)."""
    texts = [_body(r[2]) for r in rows]
    index = FMIndex(texts, window)
    lengths = np.array([len(t) for t in texts])
    docs = np.repeat(np.array([r[0] for r in rows], np.int64), lengths + 1)
    place = np.concatenate([np.arange(n + 1) for n in lengths]) + np.repeat(np.array([r[1] for r in rows], np.int64), lengths + 1)
    order = np.lexsort((place, docs))
    corpus = np.empty(len(order), np.int64)  # equal places of the corpus are one place
    corpus[order] = np.cumsum(np.concatenate(([0], (docs[order][1:] != docs[order][:-1]) | (place[order][1:] != place[order][:-1]))))
    least = index.least(corpus)
    out = []
    for start, (lo, hi) in zip(index.starts, index.matches(texts), strict=True):
        earlier = (hi > lo) & (least[np.minimum(lo, len(least) - 1)] < corpus[start : start + len(lo)])
        out.append(sum(1 << int(k) for k in np.flatnonzero(earlier)))
    return out


def _searched(distinct: DataFrame, shards: int, window: int) -> DataFrame:
    """(anchor, content, doc_id, first, bits) of the first places of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "content", "doc_id", "first"]
        held: list[tuple] = []
        shard = None

        def result() -> pa.RecordBatch:
            bits = repeated_windows([r[2:5] for r in held], window)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)), pa.array([b - (1 << 64) if b >> 63 else b for b in bits], pa.int64())], [*names, "bits"])

        for batch in batches:
            numbers = batch.column("shard").to_pylist()
            for s, row in zip(numbers, zip(*(batch.column(c).to_pylist() for c in [*names, "body"]), strict=True), strict=True):
                if s != shard:
                    if held:
                        yield result()
                    held, shard = [], s
                held.append(row)
        if held:
            yield result()

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "anchor long, content long, doc_id long, first int, bits long")


def _fingerprinted(distinct: DataFrame, window: int) -> DataFrame:
    """(doc_id, first, bits) of the windows of distinct contexts that start earlier elsewhere, one window a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 5000):
                part = batch.slice(at, 5000)
                texts = [_body(b) for b in part.column("body").to_pylist()]
                lengths = np.array([len(t) for t in texts])
                counts = lengths - window + 1
                ends = np.cumsum(counts)
                k = np.arange(ends[-1]) - np.repeat(ends - counts, counts)  # window of its context
                prints = words.grams(np.concatenate(texts), window)[np.repeat(np.cumsum(lengths) - lengths, counts) + k]
                start = (np.repeat(part.column("first").to_numpy(), counts) + k).astype(np.int32)
                columns = [np.repeat(part.column(c).to_numpy(), counts) for c in ("anchor", "doc_id")]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(prints.view(np.int64)), pa.array(columns[1]), pa.array(start)], ["anchor", "print", "doc_id", "start"])

    prints = written(distinct.mapInArrow(run, "anchor long, print long, doc_id long, start int"), "prints")
    firsts = prints.groupBy("anchor", "print").agg(F.min(F.struct("doc_id", "start")).alias("at"), F.count("*").alias("n")).where("n > 1")
    # written, so that both sides of the join are plain shuffles and a very common window can be split
    firsts = written(firsts.select("anchor", "print", F.col("at.doc_id").alias("own_id"), F.col("at.start").alias("own_start")), "firsts")
    later = prints.join(firsts.hint("merge"), ["anchor", "print"]).where("doc_id > own_id or (doc_id = own_id and start > own_start)")
    return later.select("doc_id", F.col("start").alias("first"), F.lit(1).cast("long").alias("bits"))


def marks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, copied, places, bits): one row per document that may lose words."""
    if not ANCHOR <= window < ANCHOR + 64:
        raise ValueError(f"a window takes {ANCHOR} to {ANCHOR + 63} words")
    digests, anchors = shares(docs, window)
    digests = written(digests, "digests")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    copies = written(digests.join(firsts.where("first_id < last_id"), "digest").where(F.col("doc_id") > F.col("first_id")).where(F.col("n_words") >= window).select("doc_id").distinct(), "copies")
    # written, so that both sides of the join are plain shuffles and a very common anchor can be split
    again = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    again = written(again.select("anchor", (F.col("n") > SHARD_CONTEXTS).alias("hot")), "anchors")
    places = anchors.join(again, "anchor").groupBy("doc_id").agg(F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("hot"), F.col("place"))).alias("hot"))
    places = written(places.join(copies, "doc_id", "left_anti"), "places")
    cut = written(_cut(docs, places, window), "contexts")

    def distinct(rows: DataFrame) -> DataFrame:
        merged = rows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "first")).alias("at"), F.first("body").alias("body"))
        return merged.select("anchor", "content", "at.doc_id", "at.first", "body")

    shards = max(1, -(-cut.where("not hot").count() // SHARD_CONTEXTS))
    found, windows = _searched(distinct(cut.where("not hot")), shards, window), None
    if not again.where("hot").isEmpty():
        crowded = written(distinct(cut.where("hot")), "crowded")
        windows = _fingerprinted(crowded.select("anchor", "doc_id", "first", "body"), window)
        # windows of first places are marked one by one, all others through their contexts
        found = found.union(crowded.select("anchor", "content", "doc_id", "first", F.lit(0).cast("long")))
    found = found.withColumnsRenamed({"doc_id": "own_id", "first": "own_first"})
    own = (F.col("doc_id") == F.col("own_id")) & (F.col("first") == F.col("own_first"))
    all_bits = F.when(F.col("n") >= 64, F.lit(-1)).otherwise(F.expr("shiftleft(1L, n) - 1"))
    hits = cut.select("anchor", "content", "doc_id", "first", "n").join(found, ["anchor", "content"]).select("doc_id", "first", F.when(own, F.col("bits")).otherwise(all_bits).alias("bits"))
    hits = hits if windows is None else hits.union(windows)
    per_doc = hits.where("bits <> 0").groupBy("doc_id").agg(F.collect_list(F.struct("first", "bits")).alias("m"))
    marked = per_doc.select("doc_id", F.lit(False).alias("copied"), F.col("m.first").alias("places"), F.col("m.bits").alias("bits"))
    return marked.union(copies.select("doc_id", F.lit(True), F.lit(None), F.lit(None)))


def covered(n: int, window: int, copied: bool, places: list[int] | None, bits: list[int] | None) -> np.ndarray:
    """Which of n words go."""
    if copied:
        return np.ones(n, bool)
    starts = np.zeros(n + 1, np.int64)
    for place, word in zip(places or [], bits or [], strict=True):
        own = word & 0xFFFFFFFFFFFFFFFF
        while own:
            low = own & -own
            start = place + low.bit_length() - 1
            if start + window <= n:
                starts[start] += 1
                starts[start + window] -= 1
            own ^= low
    # a start may be listed more than once; what counts is whether any window covers a word
    return np.cumsum(starts)[:n] > 0


def _joined(docs: DataFrame, window: int) -> DataFrame:
    """(row, marked_id, copied, places, bits): each document whole, as one struct, beside its marks."""
    whole = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.struct(*docs.columns).alias("row"))
    found = marks(docs.select("doc_id", "text"), window).withColumnRenamed("doc_id", "marked_id")
    return whole.join(found.hint("merge"), F.col("own_id") == F.col("marked_id"), "left").select("row", "marked_id", "copied", "places", "bits")


def kept_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("copied", "places", "bits")]
            for text, copied, places, bits in zip(words.binaries(batch.column("text")), *columns, strict=True):
                split = words.split(text)
                gone = covered(len(split), window, bool(copied), places, bits)
                kept = [w for w, g in zip(split, gone.tolist(), strict=True) if not g] if gone.any() else split
                total.append(len(split)), removed.append(len(split) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _joined(docs.select(F.col("doc_id").cast("long"), "text"), window).select("row.doc_id", "row.text", "copied", "places", "bits")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without repeated passages; changed texts have their kept words joined by
    single spaces and ``n_chars`` set anew, documents that lose all their words go."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, alive = [], []
            columns = [batch.column(c).to_pylist() for c in ("marked_id", "copied", "places", "bits")]
            whole = batch.column("row")
            for text, marked, copied, places, bits in zip(words.binaries(whole.field("text")), *columns, strict=True):
                if marked is None:
                    texts.append(text), alive.append(True)
                    continue
                split = words.split(text)
                gone = covered(len(split), window, bool(copied), places, bits)
                kept = [w for w, g in zip(split, gone.tolist(), strict=True) if not g]
                texts.append(b" ".join(kept) if gone.any() else text)
                alive.append(bool(kept) or not gone.any())
            out = [pa.array(texts, pa.binary()).cast(whole.field("text").type) if c == "text" else whole.field(c) for c in fields.names]
            yield pa.RecordBatch.from_arrays(out, fields.names).filter(pa.array(alive))

    made = _joined(docs, window).mapInArrow(run, fields)
    return made.withColumn("n_chars", F.length("text").cast(fields["n_chars"].dataType)) if "n_chars" in fields.names else made
