"""Scan-bundle documents: one JSON file each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custody.functions.text import file_tag


def bundle_documents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(asset_tag, file_name, path, raw, size) per file; the tag comes from ``TAG.json``.

    Invalid UTF-8 is kept as it is in ``raw`` so that the contract check can
    report it.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        file_tag(name).alias("asset_tag"),
        name.alias("file_name"),
        "path",
        F.col("content").cast("string").alias("raw"),
        F.col("length").alias("size"),
    )


def packed_documents(spark: SparkSession, path: str) -> DataFrame:
    """(asset_tag, file_name, path, raw, size) of documents packed into Parquet (file_name, raw).

    Millions of small files are slow to list and open; packed once, they are read by split.
    """
    rows = spark.read.schema("file_name STRING, raw STRING").parquet(path)
    return rows.select(
        file_tag("file_name").alias("asset_tag"),
        "file_name",
        F.concat_ws("#", F.col("_metadata.file_path"), "file_name").alias("path"),
        "raw",
        F.octet_length("raw").cast("bigint").alias("size"),
    )
