"""Benchmark decontamination by SimHash windows, in DataFrame and SQL functions only.

A document matches an item if a window of the item's size holds a multiset of word shingles
whose weighted Jaccard similarity (sum of smaller counts by sum of larger ones) with the
item's is ``similarity`` or more.

1. Places where a document has a shingle of an item mark the only windows that can have a
   similarity above 0. Windows of equal words are fingerprinted once.
2. SimHash: each bit of a 64-bit fingerprint is the majority of that bit over the hashes of
   the window's shingles, repeated ones counting repeatedly.
3. Fingerprints are cut into BLOCKS blocks. Within RADIUS differing bits, some block differs
   in at most RADIUS // BLOCKS bits, so items are listed under all block values that near
   theirs; windows meet items of their size by (size, block, value), which finds every pair
   within RADIUS. At similarity 0.8 two fingerprints differ in 9.7 bits on average with a
   deviation of 2.9; RADIUS lies 4.6 deviations above.
4. Pairs within RADIUS are verified by the exact weighted similarity.

Defined cases: null texts and texts without words match nothing; an item of fewer words than
a shingle is one shingle; a document shorter than an item is one window. Case is folded.
Repeated rows and items of equal text match each for itself. Null ids are carried as they are
for items; documents without id are not judged. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.llm.work import written

SHINGLE = 5
SIMILARITY = 0.8
RADIUS, BLOCKS = 23, 12
BROADCAST_ROWS = 1_000_000  # of item shingles (16 bytes each); more are joined by shuffle
_STEPS = [(b * 64) // BLOCKS for b in range(BLOCKS + 1)]


def split_words(text: Column) -> Column:
    low = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(low != "", F.split(low, "[ \\t\\n\\x0B\\f\\r]+"))


def shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from place ``at`` on (from 0)."""
    return F.xxhash64(*(F.get(words, at + j) for j in range(size)))


def _mask(block: int) -> int:
    value = ((1 << (_STEPS[block + 1] - _STEPS[block])) - 1) << _STEPS[block]
    return value - (1 << 64) if value >> 63 else value


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp) of rows (keys, words): SimHash of the shingles of each."""
    size = F.size("words")
    opened = rows.select(*keys, "words", F.explode(F.sequence(F.lit(0), F.greatest(size - SHINGLE, F.lit(0)))).alias("at"))
    # a text of fewer words has nulls beyond its end, which the hash passes over
    hashed = opened.select(*keys, shingle(F.col("words"), F.col("at"), SHINGLE).alias("h"))
    # two counters of 32 bits in each sum
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(0x100000001))).alias(f"c{j}") for j in range(32)]
    counted = hashed.groupBy(*keys).agg(F.count("*").alias("n"), *lanes)
    bits = []
    for j in range(32):
        for q in (0, 1):
            votes = F.shiftrightunsigned(f"c{j}", 32 * q).bitwiseAND(F.lit(0xFFFFFFFF))
            bits.append(F.shiftleft((2 * votes > F.col("n")).cast("long"), j + 32 * q))
    return counted.select(*keys, reduce(Column.bitwiseOR, bits).alias("fp"))


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_key, item_id, words, size) of the items with words; equal rows stay apart."""
    items = benchmark.select("item_id", split_words(F.col("text")).alias("words")).where("words is not null")
    return items.select(F.xxhash64("item_id", "words").alias("item_key"), "item_id", "words", F.size("words").alias("size"))


def marked_places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, size, n, lows, highs): ranges of the starts of the windows that share a shingle with an item."""
    # the different shingle lengths of the items, at most SHINGLE of them
    lengths = sorted(r[0] for r in items.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().collect())
    texts = docs.where("doc_id is not null").select("doc_id", split_words(F.col("text")).alias("words")).where("words is not null")
    parts = []
    for k in lengths:
        of = items.where(F.least("size", F.lit(SHINGLE)) == k)
        shared = of.select("size", "words", F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("at")).select(shingle(F.col("words"), F.col("at"), k).alias("h"), "size").distinct()
        shared = written(shared, "item-shingles")
        if shared.count() <= BROADCAST_ROWS:
            shared = F.broadcast(shared)
        opened = texts.where(F.size("words") >= k).select("doc_id", "words", F.size("words").alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("at"))
        hit = opened.select("doc_id", "n", "at", shingle(F.col("words"), F.col("at"), k).alias("h")).join(shared, "h")
        low, high = F.greatest(F.col("at") - F.col("size") + k, F.lit(0)), F.least("at", F.greatest(F.col("n") - F.col("size"), F.lit(0)))
        parts.append(hit.select("doc_id", "size", "n", F.struct(low.alias("low"), high.alias("high")).alias("range")).where("range.low <= range.high"))
    if not parts:
        return docs.limit(0).select("doc_id", F.lit(0).alias("size"), F.lit(0).alias("n"), F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"))).alias("ranges"))
    return reduce(DataFrame.union, parts).groupBy("doc_id", "size", "n").agg(F.collect_set("range").alias("ranges"))


def windows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, size, start, body): the words of each marked window, one blank between."""
    starts = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["low"], r["high"]))))
    marked = places.select(F.col("doc_id").alias("marked"), "size", "n", starts.alias("starts"))
    # the text travels, not its words, and always by shuffle: marked documents grow with the corpus
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    joined = texts.join(marked.hint("merge"), F.col("doc_id") == F.col("marked"))
    joined = joined.select("doc_id", "size", "n", "starts", split_words(F.col("text")).alias("words")).where(F.size("words") == F.col("n"))
    opened = joined.select("doc_id", "size", "words", F.explode("starts").alias("start"))
    return opened.select("doc_id", "size", "start", F.array_join(F.expr("slice(words, start + 1, size)"), " ").alias("body"))


def near_pairs(prints: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (size, fp, key columns of both) within RADIUS; prints (size, fp, ...), items (size, item_fp, ...)."""
    reach = RADIUS // BLOCKS
    if reach != 1:
        raise ValueError("blocks are listed with at most one differing bit")
    value = [F.shiftrightunsigned("fp", _STEPS[b]).bitwiseAND(F.lit((1 << (_STEPS[b + 1] - _STEPS[b])) - 1)) for b in range(BLOCKS)]
    own = [F.shiftrightunsigned("item_fp", _STEPS[b]).bitwiseAND(F.lit((1 << (_STEPS[b + 1] - _STEPS[b])) - 1)) for b in range(BLOCKS)]
    near = F.array(*(F.struct(F.lit(b).alias("block"), own[b].bitwiseXOR(F.lit(flip)).alias("value")) for b in range(BLOCKS) for flip in [0, *(1 << k for k in range(_STEPS[b + 1] - _STEPS[b]))]))
    listed = items.withColumn("e", F.explode(near)).select("*", "e.block", "e.value").drop("e")
    asked = prints.withColumn("e", F.explode(F.array(*(F.struct(F.lit(b).alias("block"), value[b].alias("value")) for b in range(BLOCKS))))).select("*", "e.block", "e.value").drop("e")
    met = asked.join(listed, ["size", "block", "value"])
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair counts at the first block where it meets
    earliest = reduce(lambda later, b: F.when(F.bit_count(apart.bitwiseAND(F.lit(_mask(b)))) <= reach, b).otherwise(later), reversed(range(BLOCKS)), F.lit(BLOCKS))
    return met.where(F.bit_count(apart) <= RADIUS).where(earliest == F.col("block")).withColumn("hamming", F.bit_count(apart)).drop("block", "value")


def numbered_shingles(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name) of rows (keys, words): shingle hashes, each with its how-manieth occurrence,
    so that sets of them are multisets of shingles."""
    size = F.greatest(F.size("words") - SHINGLE, F.lit(0))
    plain = F.transform(F.sequence(F.lit(0), size), lambda i: shingle(F.col("words"), i, SHINGLE))
    # a column of its own: inside the next step's lambda the sort would run once an element
    ordered = rows.select(*keys, F.array_sort(plain).alias("ordered"))
    return ordered.select(*keys, F.transform("ordered", lambda x, i: F.xxhash64(x, i - F.array_position("ordered", x))).alias(name))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, n_words, hamming, similarity): the best window of each matching pair.

    The fingerprints' RADIUS is made for SIMILARITY and more.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"fingerprints find pairs of similarity {SIMILARITY} and more")
    items = written(item_table(benchmark), "items")
    places = written(marked_places(docs, items), "places")
    found = written(windows(docs, places).withColumns({"h1": F.xxhash64("body"), "h2": F.xxhash64(F.lit(1), "body")}), "windows")
    bodies = found.groupBy("size", "h1", "h2").agg(F.first("body").alias("body")).select("size", "h1", "h2", F.split("body", " ").alias("words"))
    bodies = written(bodies, "bodies")
    prints = fingerprints(bodies, ["size", "h1", "h2"])
    item_prints = fingerprints(items, ["item_key", "size"]).withColumnRenamed("fp", "item_fp")
    pairs = written(near_pairs(prints, item_prints).select("size", "h1", "h2", "item_key", "hamming"), "pairs")
    # shingles are numbered once for each text that is in a pair
    key = ["size", "h1", "h2"]
    asked = bodies.join(pairs.select(*key).distinct(), key, "left_semi")
    own = written(numbered_shingles(asked, key, "own"), "own-shingles")
    theirs = written(numbered_shingles(items, ["item_key", "item_id"], "theirs"), "their-shingles")
    met = pairs.join(own, key).join(theirs, "item_key")
    shared = F.size(F.array_intersect("own", "theirs"))
    counted = written(met.select(*key, "item_id", "hamming", shared.alias("shared"), (F.size("own") + F.size("theirs")).alias("both")), "counted")
    judged = counted.withColumn("similarity", F.col("shared") / (F.col("both") - F.col("shared"))).where(F.col("similarity") >= similarity)
    judged = judged.select(*key, "item_id", "hamming", "similarity")
    matches = found.select("doc_id", "size", "start", "h1", "h2").join(judged, ["size", "h1", "h2"])
    best = F.max_by(F.struct("start", "size", "hamming", "similarity"), F.struct("similarity", -F.col("start")))
    return matches.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.start", F.col("m.size").alias("n_words"), "m.hamming", "m.similarity")
