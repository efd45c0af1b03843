"""Merkle manifest of a dataset with leaf coordinates from bitmap ranks.

Every row is a leaf; leaves of a source form a tree in the order of their ids, and the
sources' roots form one more. A leaf's place is its rank among the ids of its source. Ids
are kept as compressed bitmaps: a word of 64 ids is stored only where it has a bit, and
popcount directories over runs of 2**16 words, of 2**16 such runs, and so on hold what lies
before each word. A rank is one lookup of the word and the popcount of its lower bits, so
leaves are never sorted and no task sees more than 2**16 directory rows of a source.

Nodes then meet by (tree, place div 3**DEPTH): a block is an array with a slot for each of
its places, which is reduced DEPTH levels at once. Blocks of blocks follow until one is
left, and the siblings on the way from each block to the root go back down to its leaves.

Defined cases: ids may be null (they come first) or repeat; rows of one id are ordered by
leaf and then by claim, equal rows beside each other. A null field counts as ``-``. Sources
are ordered bytewise, null first. An empty table has no rows, and no root. Columns other
than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custody.llm.work import written

FAN = 3
DEPTH = 6  # levels that a block takes at once
BLOCK = FAN**DEPTH
_RUN = 16  # bits of a word's number that a directory level takes off
_COPIES = 100_000  # equal rows numbered by one task

_NODES = "array<struct<slot:int, doc_id:bigint, leaf:binary, claim:binary>>"
_PATH = "array<struct<l:string, r:string>>"


def digest(*fields: Column) -> Column:
    """SHA-256 (32 bytes) of fields, each as its length in bytes, a colon and its text; ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame, text: Column | None = None, claimed: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, claim): claim is the leaf of the row with ``claimed`` in place of its text."""
    text = F.col("text") if text is None else text

    def leaf(t: Column) -> Column:
        return digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)

    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    return docs.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(text).alias("leaf"), leaf(text if claimed is None else claimed).alias("claim")
    )


# --- places --------------------------------------------------------------------------------


def _before(*keys: str, order: str):
    """Window of what precedes a row in its run."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def directory(ids: DataFrame) -> DataFrame:
    """(tree, word, bits, n, base, total) of (tree, doc_id): base leaves of the tree precede the word's.

    One row for each 64 ids that hold one at least. ``n`` counts rows and is above the
    popcount of ``bits`` where ids repeat; rows without id precede all others.
    """
    spread = ids.where("doc_id is not null").select("tree", F.expr("shiftright(doc_id, 6)").alias("word"), F.expr("shiftleft(1L, cast(doc_id & 63 as int))").alias("bit"))
    words = written(spread.groupBy("tree", "word").agg(F.expr("bit_or(bit)").alias("bits"), F.count("*").alias("n")), "bitmap-words")
    levels = [words.select("tree", F.col("word").alias("k"), "n")]
    for _ in range(3):
        up = levels[-1].groupBy("tree", F.expr(f"shiftright(k, {_RUN})").alias("up")).agg(F.sum("n").alias("n"))
        levels.append(up.select("tree", F.col("up").alias("k"), "n"))
    nulls = ids.groupBy("tree").agg(F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count("*").alias("total"))
    found = levels[3].withColumn("base", F.coalesce(F.sum("n").over(_before("tree", order="k")), F.lit(0)))
    found = found.join(nulls, "tree").select("tree", F.col("k").alias("up"), (F.col("base") + F.col("nulls")).alias("base"), "total")
    for level in levels[2::-1]:
        own = level.withColumn("up", F.expr(f"shiftright(k, {_RUN})"))
        own = own.withColumn("own", F.coalesce(F.sum("n").over(_before("tree", "up", order="k")), F.lit(0)))
        found = own.join(found, ["tree", "up"]).select("tree", F.col("k").alias("up"), (F.col("own") + F.col("base")).alias("base"), "total")
    return words.join(found.withColumnRenamed("up", "word"), ["tree", "word"])


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share ``keys`` with ``nth``, their number from 0 by leaf and claim; equal rows are merged meanwhile.

    A group is cut by the first two bytes of its leaves: counts of the cuts give what
    precedes a cut, and only the different leaves of one cut are ordered in a task.
    """
    apart = rows.withColumn("cut", F.substring("leaf", 1, 2)).groupBy(*keys, "cut", "leaf", "claim").agg(F.count("*").alias("copies"))
    apart = written(apart, "repeated-ids")
    cuts = apart.groupBy(*keys, "cut").agg(F.sum("copies").alias("n"))
    cuts = cuts.select(*keys, "cut", F.coalesce(F.sum("n").over(_before(*keys, order="cut")), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*keys, "cut").orderBy("leaf", "claim").rowsBetween(Window.unboundedPreceding, -1)
    placed = apart.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(cuts, [*keys, "cut"])
    parts = placed.withColumn("part", F.explode(F.expr(f"sequence(0L, copies - 1, {_COPIES}L)"))).repartition(*keys, "leaf", "part")
    copy = F.explode(F.expr(f"sequence(part, least(part + {_COPIES - 1}, copies - 1))"))
    return parts.withColumn("copy", copy).withColumn("nth", F.col("first") + F.col("inside") + F.col("copy")).drop("cut", "copies", "first", "inside", "part", "copy")


def placed(rows: DataFrame) -> DataFrame:
    """(tree, total, pos, doc_id, leaf, claim): every leaf's place in its tree, from its id's rank."""
    words = written(directory(rows), "directory")
    bit = F.expr("cast(doc_id & 63 as int)")
    lower = F.expr("bit_count(bits & ~shiftleft(-1L, cast(doc_id & 63 as int)))")
    again = words.where("n > bit_count(bits)").select("tree", "word")
    keyed = rows.where("doc_id is not null").withColumn("word", F.expr("shiftright(doc_id, 6)"))
    if again.isEmpty():
        out = keyed.join(words.hint("merge"), ["tree", "word"]).select("tree", "total", (F.col("base") + lower).alias("pos"), "doc_id", "leaf", "claim")
    else:
        more = keyed.join(again, ["tree", "word"], "left_semi").groupBy("tree", "word", bit.alias("bit")).agg((F.count("*") - 1).alias("extra")).where("extra > 0")
        more = more.groupBy("tree", "word").agg(F.collect_list(F.struct("bit", "extra")).alias("more"))
        words = written(words.join(more, ["tree", "word"], "left"), "directory")
        earlier = F.expr("coalesce(aggregate(filter(more, x -> x.bit < cast(doc_id & 63 as int)), 0L, (s, x) -> s + x.extra), 0L)")
        both = keyed.join(words.hint("merge"), ["tree", "word"]).withColumn("pos", F.col("base") + lower + earlier)
        twice = F.expr("coalesce(exists(more, x -> x.bit = cast(doc_id & 63 as int)), false)")
        out = both.where(~twice).select("tree", "total", "pos", "doc_id", "leaf", "claim")
        alike = _numbered(both.where(twice).select("tree", "total", "pos", "doc_id", "leaf", "claim"), ["tree", "total", "pos", "doc_id"])
        out = out.union(alike.select("tree", "total", (F.col("pos") + F.col("nth")).alias("pos"), "doc_id", "leaf", "claim"))
    absent = rows.where("doc_id is null")
    if absent.isEmpty():
        return out
    counts = rows.groupBy("tree").agg(F.count("*").alias("total"))
    first = _numbered(absent.select("tree", "leaf", "claim"), ["tree"]).join(written(counts, "totals").hint("merge"), "tree")
    return out.union(first.select("tree", "total", F.col("nth").alias("pos"), F.lit(None).cast("long").alias("doc_id"), "leaf", "claim"))


# --- blocks --------------------------------------------------------------------------------


def _sha(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduced(nodes: list[str], alone: bool) -> list[list[str]]:
    """All levels of a block, from its nodes up: to one node if the block is a whole tree, else DEPTH levels."""
    levels = [nodes]
    while len(levels[-1]) > 1 if alone else len(levels) <= DEPTH:
        below = levels[-1]
        levels.append([_sha(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def siblings(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """What stands left and right of a node in its run, at every level of its block."""
    out = []
    for level in levels[:-1]:
        first = slot - slot % FAN
        out.append(("".join(level[first:slot]), "".join(level[slot + 1 : first + FAN])))
        slot //= FAN
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = _sha([left, node, right])
    return node


def _nodes(slots: list[dict]) -> tuple[list[dict], list[str]]:
    """A block's slots in their places."""
    array: list = [None] * len(slots)
    for s in slots:
        array[s["slot"]] = s
    return array, [s["leaf"].hex() for s in array]


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alone = batch.column("alone").to_pylist()
        tops = [bytes.fromhex(reduced(_nodes(s)[1], a)[-1][0]) for s, a in zip(batch.column("slots").to_pylist(), alone, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree", "total", "block", "alone")), pa.array(tops, pa.binary())], ["tree", "total", "block", "alone", "top"])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node of a block: its number, its path to the root, and the roots on the way."""
    for batch in batches:
        for row in batch.to_pylist():
            array, nodes = _nodes(row["slots"])
            levels = reduced(nodes, row["alone"])
            up = [(p["l"], p["r"]) for p in row["path"]]
            path = [[dict(l=left, r=right) for left, right in siblings(levels, i) + up] for i in range(len(array))]
            n = len(array)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["tree"]] * n, pa.string()),
                    pa.array([row["block"] * BLOCK + i for i in range(n)], pa.int64()),
                    pa.array(nodes, pa.string()),
                    pa.array(path, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))),
                    pa.array([row["subroot"]] * n, pa.string()),
                    pa.array([row["root"]] * n, pa.string()),
                ],
                ["tree", "block", "node", "path", "subroot", "root"],
            )


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _PROOF.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            array, nodes = _nodes(row["slots"])
            levels = reduced(nodes, row["alone"])
            up = [(p["l"], p["r"]) for p in row["path"]]
            out = []
            for i, s in enumerate(array):
                path = siblings(levels, i) + up
                proof = _sha([side for step in path for side in step])
                root = folded(s["claim"].hex(), path)
                out.append((s["doc_id"], nodes[i], row["subroot"], row["root"], proof, root, root == row["root"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.bool_() if k == 6 else pa.string()) for k, c in enumerate(zip(*out, strict=True))], names)


def _blocks(nodes: DataFrame, label: str) -> DataFrame:
    """(tree, total, block, alone, slots) of (tree, total, pos, doc_id, leaf, claim), at most BLOCK slots each."""
    slot = F.struct((F.col("pos") % BLOCK).cast("int").alias("slot"), F.col("doc_id").cast("long").alias("doc_id"), "leaf", "claim")
    keyed = nodes.select("tree", "total", F.expr(f"pos div {BLOCK}").alias("block"), slot.alias("s"))
    gathered = keyed.groupBy("tree", "total", "block").agg(F.collect_list("s").alias("slots"))
    return written(gathered.select("tree", "total", "block", (F.col("total") <= BLOCK).alias("alone"), F.col("slots").cast(_NODES).alias("slots")), label)


def _forest(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every stage, and (tree, leaf) of each tree's root."""
    stages, roots = [], None
    while True:
        stages.append(_blocks(nodes, f"blocks-{len(stages)}"))
        tops = written(stages[-1].mapInArrow(_tops, "tree string, total long, block long, alone boolean, top binary"), "tops")
        done = tops.where("alone").select("tree", F.col("top").alias("leaf"))
        roots = done if roots is None else roots.union(done)
        rest = tops.where("not alone")
        if rest.isEmpty():
            return stages, roots
        nodes = rest.select("tree", F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), F.col("block").alias("pos"), F.lit(None).alias("doc_id"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("claim"))


def _ranked(roots: DataFrame) -> DataFrame:
    """Roots as leaves of one more tree, placed by the sorted sources; a few rows beside the leaves."""
    ordered = written(roots.sort("tree").select("tree", "leaf", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "roots")
    counts = ordered.groupBy("part").agg(F.min("row").alias("least"), F.count("*").alias("n"))
    starts = counts.select("part", "least", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed_roots = ordered.join(starts, "part").select("tree", "total", (F.col("row") - F.col("least") + F.col("first")).alias("pos"), "leaf")
    return written(placed_roots, "ranked-roots")


def _descend(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The paths of the lowest stage's blocks; ``tops`` has those of the trees: (tree, path, subroot, root)."""
    paths = None
    for stage in reversed(stages):
        own = stage.where("alone").join(tops, "tree")
        if paths is not None:
            own = own.unionByName(stage.where("not alone").join(paths, ["tree", "block"]))
        if stage is stages[0]:
            return own
        below = own.mapInArrow(_down, f"tree string, block long, node string, path {_PATH}, subroot string, root string")
        paths = written(below.drop("node"), "paths")
    raise AssertionError("a forest has a stage")


def prove(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of (tree, doc_id, leaf, claim).

    The proof is all siblings from the leaf to the root, level by level, left to right.
    ``folded_root`` is what the claim gives when it's hashed with them.
    """
    rows = written(rows, "leaves")
    stages, roots = _forest(placed(rows))
    ranks = _ranked(roots)
    upper, top = _forest(ranks.select(F.lit("").alias("tree"), "total", "pos", F.lit(None).alias("doc_id"), "leaf", F.lit(None).cast("binary").alias("claim")))
    root = top.select("tree", F.lower(F.hex("leaf")).alias("root"), F.lit(None).cast("string").alias("subroot"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    over = _descend(upper, root).mapInArrow(_down, f"tree string, block long, node string, path {_PATH}, subroot string, root string")
    over = over.select(F.col("block").alias("pos"), "path", F.col("node").alias("subroot"), "root").join(ranks.select("tree", "pos"), "pos").drop("pos")
    return _descend(stages, written(over, "root-paths")).mapInArrow(_proofs, _PROOF)


ORACLE = """
WITH RECURSIVE field AS (
  SELECT doc_id, source, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
         || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
         || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head
  FROM documents
), bits AS (
  SELECT x, CAST(list_reduce([CAST(x AS UBIGINT)] || list_transform(range(8), lambda k: CAST(0 AS UBIGINT)),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS UBIGINT) AS crc
  FROM range(256) r(x)
), crcs AS (
  SELECT list(crc ORDER BY x) AS t FROM bits
), leaf AS (
  SELECT doc_id, source,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END) AS cut,
         (xor(list_reduce([4294967295::UBIGINT] || list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k + 1, 1)) AS UBIGINT)),
           lambda c, b: xor(c >> 8, t[1 + CAST(xor(c, b) & 255 AS BIGINT)])), 4294967295::UBIGINT)) % 2 = 0 AS tampered
  FROM field, crcs
), placed AS (
  SELECT doc_id, source, leaf, CASE WHEN tampered THEN cut ELSE leaf END AS claim,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaf
), node(source, level, pos, hash, total) AS (
  SELECT source, 0, pos, leaf, count(*) OVER (PARTITION BY source) FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), max((total + 2) // 3)
  FROM node WHERE total > 1 GROUP BY source, level, pos // 3
), subroot AS (
  SELECT source, hash, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM node WHERE total = 1
), over(level, pos, hash, total) AS (
  SELECT 0, pos, hash, count(*) OVER () FROM subroot
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), max((total + 2) // 3)
  FROM over WHERE total > 1 GROUP BY level, pos // 3
), every AS (
  SELECT 's' || coalesce('=' || source, '') AS tree, level, pos, hash FROM node WHERE total > 1
  UNION ALL SELECT 'o', level, pos, hash FROM over WHERE total > 1
), run AS (
  SELECT tree, level, pos // 3 AS run, list(hash ORDER BY pos) AS hashes FROM every GROUP BY ALL
), fold(doc_id, leaf, source, tree, level, pos, height, hash, proof) AS (
  SELECT doc_id, leaf, p.source, 's' || coalesce('=' || p.source, ''), 0, p.pos, s.height, claim, ''
  FROM placed p JOIN subroot s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT doc_id, leaf, f.source,
         CASE WHEN f.level < f.height OR f.tree = 'o' THEN f.tree ELSE 'o' END,
         CASE WHEN f.level < f.height OR f.tree = 'o' THEN f.level + 1 ELSE 0 END,
         CASE WHEN f.level < f.height OR f.tree = 'o' THEN f.pos // 3 ELSE s.pos END,
         f.height,
         CASE WHEN f.level < f.height OR f.tree = 'o' THEN sha256(array_to_string(list_transform(hashes, lambda h, i: CASE WHEN i = f.pos % 3 + 1 THEN f.hash ELSE h END), '')) ELSE f.hash END,
         CASE WHEN f.level < f.height OR f.tree = 'o' THEN f.proof || array_to_string(list_filter(hashes, lambda h, i: i <> f.pos % 3 + 1), '') ELSE f.proof END
  FROM fold f JOIN subroot s ON f.source IS NOT DISTINCT FROM s.source
  LEFT JOIN run r ON r.tree = f.tree AND r.level = f.level AND r.run = f.pos // 3
  WHERE (f.tree <> 'o') OR f.level < (SELECT max(level) FROM over)
), root AS (
  SELECT hash FROM over WHERE total = 1
)
SELECT f.doc_id, f.leaf, s.hash AS subroot, root.hash AS root, sha256(f.proof) AS proof_sha256, f.hash AS folded_root, f.hash = root.hash AS verified
FROM fold f JOIN subroot s ON f.source IS NOT DISTINCT FROM s.source, root
WHERE f.tree = 'o' AND f.level = (SELECT max(level) FROM over)
"""
