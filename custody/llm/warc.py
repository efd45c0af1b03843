"""WARC archives with a two-level capture index.

``write_archive`` writes one record per page; equal payloads of ``min_bytes`` or more are kept
once, by the smallest page id, and later ones refer to it. ``captures`` parses the archives by
their length fields. ``build_index`` sorts the captures by reversed-host key into compressed
blocks and keeps a sparse directory of them; ``lookup`` finds keys by binary search, first of
the shard, then of the block in the directory, then in the opened block; ``read_ranges`` reads
the byte ranges found. Keys that are captured very often are spread by record id, which is
part of the sort order.

Defined cases: a null page is an empty payload; a null url is an empty address; blanks and
control characters of an address are percent-encoded in the record's address line; repeated
page ids are records of their own, and each that has the smallest id of its payload is a response;
a revisit means the response of that id whose payload has the digest it names.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custody.llm.work import written
from custody.session import shared_dir

MIN_BYTES = 100
RECORDS_PER_FILE = 4000
BLOCK_LINES = 1000
SHARD_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"
HTTP = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}{EOL}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "key string, record_id string, page_id long, record_type string, refers_to long, digest string, file string, start long, length long"


def surt(url: Column) -> Column:
    """Key with the host's labels reversed: com,example,www)/path?query"""
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def address(url: Column) -> Column:
    """The address line of a record: blanks and control characters percent-encoded, null as empty."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(url, r"[\x00-\x1f\x7f]", "%0A"), " ", "%20"), F.lit(""))


def planned(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to); refers_to is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("digest"))
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    # written first, so that its size is known when the join is planned: where few payloads
    # repeat, Spark's own threshold broadcasts them and no page is shuffled
    first = written(first.select("digest", "first_id"), "repeated")
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "digest", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("refers_to")
    )


def record(id_: Column, url: Column, payload: Column, size: Column, digest: Column, refers_to: Column) -> Column:
    """Text of a record, without the two line ends after it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = refers_to.isNotNull()
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(id_)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", address(url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(refers_to)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.lit(len(HTTP)) + F.when(again, 0).otherwise(size)).cast("string")),
        F.lit(EOL + HTTP),
        F.when(again, "").otherwise(payload),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Archives under ``path``, at most RECORDS_PER_FILE records each, written by Spark's own text writer."""
    rows = planned(pages, min_bytes)
    text = record(*(F.col(c) for c in ("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")))
    rows.select(text.alias("value")).write.option("lineSep", EOL * 2).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """(header fields in lower case, start of the payload, its length) of each record."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split(EOL)
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {name.lower(): value.strip(" \t") for name, _, value in (x.partition(":") for x in lines[1:])}
        block, size = end + 4, int(fields["content-length"])
        start = block
        if fields.get("content-type", "").startswith("application/http"):
            start = content.index(b"\r\n\r\n", block, block + size) + 4
        yield fields, start, block + size - start
        at = block + size + 4


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, record_type, refers_to, digest, url, file, start, length) of every record."""
    number = re.compile(r"<urn:page:(-?\d+)>")

    def page(text: str | None) -> int | None:
        found = number.fullmatch(text or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "page_id", "record_type", "refers_to", "digest", "url", "file", "start", "length"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = [
                    (f["warc-record-id"], page(f["warc-record-id"]), f["warc-type"], page(f.get("warc-refers-to")), f.get("warc-payload-digest", "").removeprefix("sha256:"), f.get("warc-target-uri"), file.as_py(), start, size)
                    for f, start, size in parse(content.as_py())
                ]
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    found = archive_files(spark, path).mapInArrow(run, "record_id string, page_id long, record_type string, refers_to long, digest string, url string, file string, start long, length long")
    return found.select(surt(F.col("url")).alias("key"), "record_id", "page_id", "record_type", "refers_to", "digest", "file", "start", "length")


def build_index(entries: DataFrame, path: str, shards: int, block_lines: int = BLOCK_LINES) -> None:
    """Blocks (shard, block, first_key, last_key, n, data) sorted by key; all but ``data`` is the directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number, shard = 0, None

        def block(rows: list[tuple]) -> pa.RecordBatch:
            data = zlib.compress("\n".join(json.dumps(r, separators=(",", ":")) for r in rows).encode())
            values = [[shard], [number], [rows[0][0]], [rows[-1][0]], [len(rows)], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary()), strict=True)], ["shard", "block", "first_key", "last_key", "n", "data"])

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True))
            shard = rows[0][-1] if rows else shard
            held += [r[:-1] for r in rows]
            while len(held) >= block_lines:
                yield block(held[:block_lines])
                held, number = held[block_lines:], number + 1
        if held:
            yield block(held)

    order = ["key", "record_id", "file", "start"]
    ranged = entries.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id()).sortWithinPartitions(*order)
    blocks = ranged.mapInArrow(run, "shard int, block int, first_key string, last_key string, n int, data binary")
    blocks.write.parquet(path)


def lookup(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """All captures of the keys (column ``key``).

    The driver holds one pair of keys per shard. Distinct keys go to the shards whose range
    takes them in; there they meet the shard's compressed blocks.
    """
    blocks = spark.read.parquet(index)
    edges = sorted((r["first"], r["last"], r["shard"]) for r in blocks.groupBy("shard").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect())
    firsts, lasts, numbers = [e[0] for e in edges], [e[1] for e in edges], [e[2] for e in edges]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(k, numbers[s]) for k in batch.column("key").to_pylist() for s in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int32())], ["key", "shard"])

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("block")
        first, last, data = list(held["first_key"]), list(held["last_key"]), list(held["data"])
        out, opened = [], (-1, [], [])
        for key in sorted(asked["key"]):
            for b in range(bisect_left(last, key), bisect_right(first, key)):
                if opened[0] != b:
                    lines = zlib.decompress(data[b]).decode().split("\n")
                    rows = [json.loads(x) for x in lines]
                    opened = (b, rows, [r[0] for r in rows])
                _, rows, names = opened
                out += rows[bisect_left(names, key) : bisect_right(names, key)]
        frame = pd.DataFrame(out, columns=["key", "record_id", "page_id", "record_type", "refers_to", "digest", "file", "start", "length"])
        return frame.astype({c: "Int64" for c in ("page_id", "refers_to", "start", "length")})

    asked = keys.select("key").where("key is not null").distinct().mapInArrow(route, "key string, shard int")
    return asked.groupBy("shard").cogroup(blocks.select("shard", "block", "first_key", "last_key", "data").groupBy("shard")).applyInPandas(search, _CAPTURE)


def read_ranges(spark: SparkSession, archive: str, found: DataFrame) -> DataFrame:
    """The captures with ``payload`` bytes, cut from the archives.

    A file's ranges are gathered (it holds a bounded number of records) and meet the file,
    which travels compressed.
    """

    names = ["page_id", "record_type", "refers_to", "digest"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [codec.compress(c.as_py()) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(data, pa.binary())], ["path", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            for data, ranges in zip(batch.column("data"), batch.column("ranges"), strict=True):
                content, rows = codec.decompress(data.as_py()), ranges.values
                payload = [content[s : s + n] for s, n in zip(rows.field("start").to_pylist(), rows.field("length").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.field(c) for c in names] + [pa.array(payload, pa.binary())], [*names, "payload"])

    per_file = found.groupBy("file").agg(F.collect_list(F.struct(*names, "start", "length")).alias("ranges"))
    files = archive_files(spark, archive).mapInArrow(packed, "path string, data binary")
    rows = files.join(per_file, F.col("path") == F.col("file")).select("data", "ranges")
    return rows.mapInArrow(cut, "page_id long, record_type string, refers_to long, digest string, payload binary")


def roundtrip(pages: DataFrame) -> DataFrame:
    """Archive, index and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Every page's key is looked up in the index. Size and digest are taken from the bytes read;
    a revisit has those of the response it refers to.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    archive, index = f"{folder}/archive", f"{folder}/index"
    write_archive(pages, archive)
    entries = captures(spark, archive)
    build_index(entries, index, shards=max(1, -(-pages.count() // SHARD_ROWS), spark.sparkContext.defaultParallelism))
    keys = pages.select(surt(address(F.col("url"))).alias("key"))
    read = read_ranges(spark, archive, lookup(spark, index, keys)).select(
        "page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("own_bytes"), F.sha2("payload", 256).alias("own_digest")
    )
    read = written(read, "read")
    # an id may be listed with several payloads: a revisit means the one of the digest it names
    kept = read.where("record_type = 'response'").select(F.col("page_id").alias("to"), F.col("own_bytes").alias("to_bytes"), F.col("own_digest").alias("to_digest")).distinct()
    own = read.where("record_type = 'response'").select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", "refers_to")
    again = read.where("record_type <> 'response'").join(kept, (F.col("refers_to") == F.col("to")) & (F.col("digest") == F.col("to_digest")))
    return own.union(again.select("page_id", "to_bytes", "to_digest", "record_type", "refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {MIN_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""
