"""Row numbers in file order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE, BLOCK, POS = "__file", "__block", "__pos"


def scan_position() -> list:
    """Columns to select directly on a file scan, before any filter."""
    return [
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(POS),
    ]


def with_row_numbers(
    rows: DataFrame, start: int = 1, name: str = "row_number", keep_position: bool = False
) -> DataFrame:
    """Number the rows of every file from ``start`` in file order.

    A scan reads each file block in one go, so within a block the generated ids
    are consecutive. Counting rows per block and summing the counts of earlier
    blocks gives every block's offset; only those per-block counts are ordered,
    never the rows, so one huge file is still numbered by all tasks.
    """
    blocks = rows.groupBy(FILE, BLOCK).agg(F.min(POS).alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select(
        FILE, BLOCK,
        (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first") + start).alias("__shift"),
    )
    # Both sides scan the same splits. Should they ever differ (files replaced in
    # between), the job fails; no row is lost.
    shift = F.coalesce(
        F.col("__shift"), F.raise_error(F.lit("file changed while its rows were numbered")).cast("bigint")
    )
    numbered = (
        rows.join(shifts, [FILE, BLOCK], "left")
        .withColumn(name, F.col(POS) + shift)
        .drop(POS, "__shift")
    )
    return numbered if keep_position else numbered.drop(FILE, BLOCK)
