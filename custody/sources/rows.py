"""Spreadsheet rows: CSV files and exported sheet values."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custody.sources.ordinals import BLOCK, FILE, POS, scan_position, with_row_numbers

# How CSV sources are named in provenance, and the first data row.
CSV_SHEET_PREFIX = "csv_"
CSV_TAB = "data"
FIRST_DATA_ROW = 2

# a comma stands before every cell, so that no match is empty
_TOKEN = r'(?s),("(?:[^"]++|"")*+"|[^,]*)'


@dataclass(frozen=True)
class RowLoad:
    """Rows of (source_sheet_id, source_tab, row_number, payload) and the rejects."""

    rows: DataFrame
    rejected: DataFrame


def _tokens(line: Column) -> Column:
    """Cells of a CSV line, quotes taken off."""

    def bare(t: Column) -> Column:
        quoted = t.startswith('"') & t.endswith('"') & (F.length(t) > 1)
        inner = F.substr(t, F.lit(2), F.length(t) - 2)
        return F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(t)

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_TOKEN), F.lit(1)), bare)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, cells) of the non-blank lines, each a record; files are read by split."""
    raw = (
        spark.read.schema("line STRING")
        .options(header=False, sep="\u0001", quote="", encoding="UTF-8").csv(path)
    )
    placed = with_row_numbers(raw.select("line", *scan_position()), 1, keep_position=True)
    line = F.when(F.col("row_number") == 1, F.ltrim("line", F.lit("\ufeff"))).otherwise(F.col("line"))
    return placed.withColumn("line", line).withColumn("cells", _tokens(F.col("line")))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(line, cells) of records that may span lines; every file is read by one task."""
    options = {"header": False, "multiLine": True, "escape": '"', "encoding": "UTF-8"}
    width = len(spark.read.options(**options).csv(path).columns)
    fields = [f"c{i}" for i in range(width)]
    scan = (
        spark.read.schema(", ".join(f"{f} STRING" for f in [*fields, "__bad"]))
        .options(**options, columnNameOfCorruptRecord="__bad", mode="PERMISSIVE").csv(path)
    )
    placed = with_row_numbers(scan.select("*", *scan_position()), 1, keep_position=True)
    # The line falls back on the fields, so that Spark never prunes them: a pruned
    # read could not tell a ragged row.
    line = F.coalesce(F.col("__bad"), F.concat_ws(",", *fields))
    cells = F.when(F.col("__bad").isNotNull(), _tokens(line)).otherwise(F.array(*[F.coalesce(f, F.lit("")) for f in fields]))
    return placed.select(FILE, BLOCK, "row_number", line.alias("line"), cells.alias("cells"))


def csv_rows(spark: SparkSession, path: str, source: str, multiline: bool = False) -> RowLoad:
    """All-string rows of CSV files, numbered from 2 per file, each under its own file's header.

    Short rows keep NULL for the missing cells. Rows with more cells than the header go to
    ``rejected``. By default a record is a line; lines that leave a quote open are rejected
    with their file's path, so that those files can be read again with ``multiline``.
    """
    found = _records(spark, path) if multiline else _lines(spark, path)
    heads = found.filter("row_number = 1").select(FILE, F.col("cells").alias("names"))
    # Brought to the rows block by block, so that one huge file is no hot key.
    per_block = found.select(FILE, BLOCK).distinct().join(heads, FILE)
    rows = found.filter(f"row_number >= {FIRST_DATA_ROW}").join(per_block, [FILE, BLOCK])
    width, cells = F.size("names"), F.size("cells")
    # A repeated header name keeps its last column, as a keyed row would.
    kept = F.filter(
        F.sequence(F.lit(0), width - 1),
        lambda i: ~F.array_contains(F.slice("names", i + 2, width), F.get("names", i)),
    )
    payload = F.map_from_arrays(
        F.transform(kept, lambda i: F.get("names", i)), F.transform(kept, lambda i: F.get("cells", i))
    )
    placed = [
        F.lit(CSV_SHEET_PREFIX + source).alias("source_sheet_id"),
        F.lit(CSV_TAB).alias("source_tab"),
        "row_number",
    ]
    quotes = F.length("line") - F.length(F.translate("line", '"', ""))
    problem = F.when(F.lit(not multiline) & (quotes % 2 == 1), "open quote").when(cells > width, "more cells than headers")
    judged = rows.withColumn("error", problem)
    return RowLoad(
        rows=judged.filter("error IS NULL").select(*placed, payload.alias("payload")),
        rejected=judged.filter("error IS NOT NULL").select(
            *placed, F.col("line").alias("raw_line"), "error", F.col(FILE).alias("path")
        ),
    )


def sheet_values(exports: DataFrame) -> DataFrame:
    """Rows from exported value grids (sheet_id, tab, header_row, values).

    The first grid row holds the headers. Short rows are padded with blanks,
    longer ones cut at the header's width; row numbers are absolute sheet rows.
    """
    width = F.size("headers")
    grids = exports.filter(F.size("values") > 0).select(
        "sheet_id", "tab",
        F.coalesce("header_row", F.lit(1)).alias("header_row"),
        F.get("values", F.lit(0)).alias("headers"),
        F.slice("values", 2, F.greatest(F.size("values"), F.lit(1))).alias("rows"),
    )
    # Positions of the headers to keep: the last of each repeated name.
    kept = F.filter(
        F.sequence(F.lit(0), width - 1),
        lambda i: ~F.array_contains(
            F.slice(F.col("headers"), i + 2, width), F.get(F.col("headers"), i)
        ),
    )
    lines = (
        grids.filter(width > 0)
        .withColumn("kept", kept)
        .select("sheet_id", "tab", "header_row", "headers", "kept", F.posexplode("rows").alias("pos", "cells"))
    )
    payload = F.map_from_arrays(
        F.transform("kept", lambda i: F.get(F.col("headers"), i)),
        F.transform("kept", lambda i: F.coalesce(F.get(F.col("cells"), i), F.lit(""))),
    )
    return lines.select(
        F.col("sheet_id").alias("source_sheet_id"),
        F.col("tab").alias("source_tab"),
        (F.col("header_row") + 1 + F.col("pos")).cast("bigint").alias("row_number"),
        payload.alias("payload"),
    )


EXPORT_SCHEMA = "sheet_id STRING, tab STRING, header_row INT, `values` ARRAY<ARRAY<STRING>>"


def read_exports(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Value grids exported as JSON documents, one sheet tab each; ``broken`` holds unreadable ones.

    A document is a file or, ``packed``, a line: many small exports then are read by split.
    """
    return (
        spark.read.schema(EXPORT_SCHEMA + ", broken STRING")
        .options(multiLine=not packed, mode="PERMISSIVE", columnNameOfCorruptRecord="broken").json(path)
    )


@dataclass(frozen=True)
class FanIn:
    """Rows of all sources, entries left out with the reason, and unreadable exports
    (source_name, path, error)."""

    rows: DataFrame | None
    skipped: list[tuple[str, str]] = field(default_factory=list)
    rejected: DataFrame | None = None


def sheet_sources(spark: SparkSession, configs: list[dict]) -> FanIn:
    """Union of the configured sheet exports.

    An entry is {name, sheet_id, tab, path, header_row=1, packed=False}. Incomplete entries and
    unreadable sources are listed in ``skipped``; they do not stop the others.
    """
    loaded, skipped, rejected = [], [], []
    for config in configs:
        name = config.get("name")
        if not all(config.get(k) for k in ("name", "sheet_id", "tab", "path")):
            skipped.append((str(name), "incomplete entry"))
            continue
        try:
            exports = read_exports(spark, config["path"], bool(config.get("packed"))).withColumn("path", F.col("_metadata.file_path"))
        except AnalysisException as problem:  # a missing path is reported when the scan is planned
            skipped.append((name, type(problem).__name__))
            continue
        grid = exports.select(
            F.lit(config["sheet_id"]).alias("sheet_id"),
            F.lit(config["tab"]).alias("tab"),
            F.lit(int(config.get("header_row", 1))).alias("header_row"),
            "values",
        )
        loaded.append(sheet_values(grid).withColumn("source_name", F.lit(name)))
        # every column is asked for: a pruned JSON read could not tell a broken document
        bad = exports.filter(F.col("broken").isNotNull() | F.col("values").isNull())
        rejected.append(bad.select(F.lit(name).alias("source_name"), "path", F.when(F.col("broken").isNotNull(), "broken JSON").otherwise("no values").alias("error")))
    together = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    return FanIn(together(loaded), skipped, together(rejected))


__all__ = ["csv_rows", "sheet_values", "sheet_sources", "read_exports", "RowLoad", "FanIn", "POS"]
