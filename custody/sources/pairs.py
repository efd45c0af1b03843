"""Two-column pair lists: CSV/TSV files and pasted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custody.functions.text import strip
from custody.sources.ordinals import BLOCK, FILE, scan_position, with_row_numbers

_LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def _cells(line: Column, sep: str) -> Column:
    return F.from_csv(line, "c STRING, d STRING", {"sep": sep, "escape": '"', "mode": "PERMISSIVE"})


def _row(line: Column, delimiter: Column) -> Column:
    return F.when(delimiter == "\t", _cells(line, "\t")).otherwise(_cells(line, ","))


def _delimiters(lines: DataFrame) -> DataFrame:
    """Tab or comma per file, whichever the file holds more of; a comma on a tie."""

    def count(ch: str) -> Column:
        return F.sum(F.length("value") - F.length(F.translate("value", ch, "")))

    return lines.groupBy(FILE).agg(
        F.when(count("\t") > count(","), F.lit("\t")).otherwise(F.lit(",")).alias("delimiter")
    )


def file_pairs(spark: SparkSession, path: str, skip_header: bool = False) -> DataFrame:
    """Raw pairs of CSV/TSV files: (source, row_index, raw_line, computer_serial, drive_serial).

    Row numbers count every line including blank ones, which are then dropped.
    """
    scan = spark.read.text(path)
    lines = with_row_numbers(
        scan.select("value", *scan_position()), 1, "row_index", keep_position=True
    )
    lines = lines.withColumn(
        "value",
        F.when(F.col("row_index") == 1, F.ltrim(F.col("value"), F.lit("\ufeff"))).otherwise(F.col("value")),
    )
    # Brought to the lines block by block, so that one huge file is no hot key.
    per_block = lines.select(FILE, BLOCK).distinct().join(_delimiters(lines), FILE)
    joined = lines.filter("value <> ''").join(per_block, [FILE, BLOCK])
    if skip_header:
        joined = joined.filter("row_index > 1")
    return joined.withColumn("cells", _row(F.col("value"), F.col("delimiter"))).select(
        F.col(FILE).alias("source"),
        "row_index",
        F.col("value").alias("raw_line"),
        F.coalesce("cells.c", F.lit("")).alias("computer_serial"),
        F.coalesce("cells.d", F.lit("")).alias("drive_serial"),
    )


def pasted_pairs(texts: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Raw pairs of pasted text, one text per row; a tab wins over a comma."""
    lines = texts.select(
        F.col(source).alias("source"),
        F.posexplode(F.split(F.col(text), _LINE_ENDS)).alias("pos", "raw_line"),
    ).filter(strip("raw_line") != "")
    parts = F.when(F.instr("raw_line", "\t") > 0, F.split("raw_line", "\t")).otherwise(
        F.split("raw_line", ",")
    )
    return lines.withColumn("parts", parts).select(
        "source",
        (F.col("pos") + 1).cast("bigint").alias("row_index"),
        "raw_line",
        F.coalesce(F.get("parts", F.lit(0)), F.lit("")).alias("computer_serial"),
        F.coalesce(F.get("parts", F.lit(1)), F.lit("")).alias("drive_serial"),
    )


def all_pairs(*lists: DataFrame) -> DataFrame:
    """File pairs and pasted pairs together; repeats are kept and counted later."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out
