"""Conflict-constrained best-fit packing of documents into bins of a fixed token capacity.

Documents are dealt by a hash of their id to packing groups of about ``group_rows`` documents,
so a hot source or cluster is spread over all groups. In a group, documents go in by falling
length. Bins are kept in order of their residual room, each with a bitmap of its sources and
one of its duplicate clusters; from the first bin with enough room, successors are tried until
one shares neither bit with the document, which is the tightest compatible bin. If none is,
a new bin is opened.

Defined cases: a text of more than ``capacity`` words fills bins of its own with whole pieces,
and its last piece is packed like a document; a text without words (empty, null) takes no room
and is listed with a null bin; a null source or cluster conflicts with nothing; ties of length
are broken by doc_id, then piece. Repeated rows are packed once each.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custody.llm import words

CAPACITY = 2048
GROUP_ROWS = 4000
_FIELDS = "doc_id long, source string, cluster binary, n_tokens long"
_PACKED = "doc_id long, source string, piece int, start long, n_tokens long, bin_id long"


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cluster, n_tokens): words of each text; equal word sequences are one cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [words.split(t) for t in words.binaries(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("source"),
                    pa.array([xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in split], pa.binary()),
                    pa.array([len(w) for w in split], pa.int64()),
                ],
                ["doc_id", "source", "cluster", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(run, _FIELDS)


class Bins:
    """Open bins in order of residual room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, length: int, source: int, cluster: int) -> int:
        """Bin for a piece whose source and cluster are single bits, or 0 for none."""
        for at in range(bisect_left(self.order, (length, -1)), len(self.order)):
            room, number = self.order[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.order[at]
                break
        else:
            room, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if room > length:
            insort(self.order, (room - length, number))
        return number


def pack_group(rows: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    pieces = []
    for doc_id, source, cluster, n in rows[["doc_id", "source", "cluster", "n_tokens"]].itertuples(index=False):
        whole = max(0, -(-n // capacity) - 1)
        pieces += [(capacity, doc_id, p, source, cluster) for p in range(whole)]
        pieces.append((n - whole * capacity, doc_id, whole, source, cluster))
    pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2]))
    bits: dict = {}
    shared = {c for c, n in rows["cluster"].value_counts().items() if n > 1} | {p[4] for p in pieces if p[2]}

    def bit(kind: str, value) -> int:
        if value is None or value != value or (kind == "c" and value not in shared):
            return 0
        return 1 << bits.setdefault(kind, {}).setdefault(value, len(bits[kind]))

    bins = Bins(capacity)
    out = []
    for length, doc_id, piece, source, cluster in pieces:
        number = bins.put(length, bit("s", source), bit("c", cluster)) if length else None
        out.append((doc_id, source, piece, piece * capacity, length, None if number is None else base + number))
    frame = pd.DataFrame(out, columns=["doc_id", "source", "piece", "start", "n_tokens", "bin_id"])
    return frame.astype({"bin_id": "Int64", "doc_id": "Int64"})


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, source, piece, start, n_tokens, bin_id) of items (doc_id, source, cluster, n_tokens)."""
    groups = max(1, ceil(items.count() / group_rows))
    dealt = items.select("doc_id", "source", "cluster", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("pack_group"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pack_group(rows, capacity, int(key[0]) << 32)

    return dealt.groupBy("pack_group").applyInPandas(run, _PACKED)
