"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are scaled to length 1. In each of several tables a vector's bucket is the tuple of
k quantised random projections, floor((a.x + b) / WIDTH). For unit vectors a cosine is a
distance, so the chance that two of a given cosine share a bucket is known: k is set so that
orthogonal vectors of n rows seldom meet, the number of tables so that a pair at the
threshold meets in none with at most MISS. Bucket mates are compared by exact cosine in
double precision; a pair counts in the first table in which it meets, so nothing is listed
twice and only counts and spanning links leave a task, never all pairs of a group.

Equal vectors are one class with a weight. A bucket of more than BLOCK classes is cut into
blocks, and each pair of blocks is a unit of work of its own.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component
links with nothing (n_links 0, its own component, kept); vectors of different length never
link. Repeated rows link with each other. A null id has no component and is kept; its vector
takes no part. Other columns, labels among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custody.llm.work import connected_components, written

WIDTH = 2.0
MISS = 1e-3
BLOCK = 1000
_ROWS = "vec_id long, digest binary, unit binary, dim int"


def meets(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection puts two points of this distance together."""
    t = width / distance
    tail = 0.5 * (1 + erf(-t / sqrt(2)))
    return 1 - 2 * tail - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def settings(n: int, cosine: float) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    k = max(4, ceil(log(max(n, 2)) / -log(meets(sqrt(2)))) + 1)
    return k, ceil(log(MISS) / log(1 - meets(sqrt(2 - 2 * cosine)) ** k))


@lru_cache(8)
def _projections(dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, 11])
    return rng.standard_normal((dim, count)), rng.uniform(0, WIDTH, count)


def buckets(units: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(n, tables) bucket hashes of n unit vectors."""
    a, b = _projections(units.shape[1], k * tables)
    codes = np.floor((units @ a + b) / WIDTH).astype(np.int64).reshape(len(units), tables, k)
    weights = np.random.default_rng([units.shape[1], 12]).integers(1, 2**63, (tables, k), dtype=np.int64) | 1
    mixed = (codes * weights).sum(axis=2)
    return mixed ^ (mixed >> 29)


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, digest, unit, dim) of each row; digest is null where the vector takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, units, dims = [], [], []
            for v in batch.column("embedding").to_pylist():
                x = np.array(v if v else [], np.float64) if v is None or None not in v else np.empty(0)
                top = np.abs(x).max() if len(x) else 0.0
                if not (np.isfinite(top) and top > 0):
                    digests.append(None), units.append(None), dims.append(None)
                    continue
                x = x / top  # so that squares neither vanish nor overflow
                x = x / np.sqrt((x * x).sum())
                digests.append(xxhash.xxh3_128_digest(x.tobytes())), units.append(x.tobytes()), dims.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(units, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "digest", "unit", "dim"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, _ROWS)


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def hashed(classes: DataFrame, k: int, tables: int) -> DataFrame:
    """(rep, keys): bucket hashes of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            keys: list[bytes | None] = [None] * len(batch)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for piece in np.array_split(at, ceil(len(at) / 500)):
                    for i, row in zip(piece, buckets(_stack(batch.column("unit").take(pa.array(piece))), k, tables), strict=True):
                        keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(keys, pa.binary())], ["rep", "keys"])

    return classes.select("rep", "unit", "dim").mapInArrow(run, "rep long, keys binary")


def _opened(keys: DataFrame, tables: int) -> DataFrame:
    """(rep, tab, bucket), one row per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            rep = np.repeat(batch.column("rep").to_numpy(), tables)
            tab = np.tile(np.arange(tables, dtype=np.int32), len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(tab), pa.array(flat)], ["rep", "tab", "bucket"])

    return keys.mapInArrow(run, "rep long, tab int, bucket long")


def compared(rows: list[tuple], tab: int, cosine: float, left: int | None, right: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the new links of each row, smallest row reached); rows (rep, weight, unit, keys, part).

    With two different parts only pairs between them are looked at.
    """
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float64).reshape(len(rows), -1)
    keys = np.frombuffer(b"".join(r[3] for r in rows), np.int64).reshape(len(rows), -1)[:, :tab]
    weight = np.array([r[1] for r in rows], np.int64)
    part = np.array([r[4] for r in rows])
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if left != right:
        near &= part[:, None] != part[None, :]
    fresh = np.zeros(len(rows), np.int64)
    i, j = np.nonzero(np.triu(near))
    for at in range(0, len(i), 20_000):
        p, q = i[at : at + 20_000], j[at : at + 20_000]
        new = ~(keys[p] == keys[q]).any(axis=1)
        np.add.at(fresh, p[new], weight[q[new]])
        np.add.at(fresh, q[new], weight[p[new]])
    label, before = np.arange(len(rows)), None
    while before is None or (label != before).any():
        before = label
        label = np.minimum(label, np.where(near, label[None, :], len(rows)).min(axis=1))
        label = label[label]
    return fresh, label


def _compare(rows: DataFrame, cosine: float) -> DataFrame:
    """(rep, other, fresh) of each row of each unit of work that links anything."""
    keys = ["tab", "bucket", "dim", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        unit = None

        def result() -> pa.RecordBatch:
            fresh, label = compared(held, unit[0], cosine, unit[3], unit[4])
            use = [n for n in range(len(held)) if fresh[n] or label[n] != n]
            return pa.RecordBatch.from_arrays(
                [pa.array([held[n][0] for n in use], pa.int64()), pa.array([held[label[n]][0] for n in use], pa.int64()), pa.array([int(fresh[n]) for n in use], pa.int64())], ["rep", "other", "fresh"]
            )

        for batch in batches:
            of = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            for u, row in zip(of, zip(*(batch.column(c).to_pylist() for c in ("rep", "weight", "unit", "keys", "part")), strict=True), strict=True):
                if u != unit:
                    if len(held) > 1:
                        yield result()
                    held, unit = [], u
                held.append(row)
        if len(held) > 1:
            yield result()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, other long, fresh long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    own = written(scaled(vectors), "vectors")
    full = own.where("vec_id is not null and digest is not null")
    # classes go by numbers of their own, since one id may be listed with several vectors; the
    # numbers hold because the table is written, and an aggregate takes a hot vector along
    classes = full.groupBy("digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("unit").alias("unit"), F.first("dim").alias("dim"))
    reps = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    k, tables = settings(reps.count(), cosine)
    keys = written(hashed(reps, k, tables), "keys")
    rows = _opened(keys, tables).join(reps.select("rep", "dim"), "rep")
    shared = rows.groupBy("tab", "bucket", "dim").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(shared, ["tab", "bucket", "dim"]).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("left"), F.greatest(p, F.col("part")).alias("right")))
    units = met.withColumn("part", part).withColumn("pair", F.explode(pairs)).select("tab", "bucket", "dim", "rep", "part", "pair.left", "pair.right")
    rows = units.join(reps.select("rep", "weight", "unit"), "rep").join(keys, "rep")
    found = written(_compare(rows, cosine), "found")
    fresh = found.groupBy("rep").agg(F.sum("fresh").alias("fresh"))
    parts = connected_components(found, "rep", "other", "rep")
    labelled = reps.select("rep", "weight", "digest", "first_id").join(fresh, "rep", "left").join(parts, "rep", "left").select(
        "digest", "first_id", (F.coalesce("fresh", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("part")
    )
    labelled = written(labelled, "labelled")
    # written, so that both sides of the join are plain shuffles and a very large component can be split
    least = written(labelled.groupBy("part").agg(F.min("first_id").alias("component_id")), "least")
    of_class = labelled.join(least.hint("merge"), "part").select("digest", "n_links", "component_id")
    out = own.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY 1), low AS (SELECT a, min(b) AS low FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id"""
