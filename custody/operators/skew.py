"""Joining a fact table to a side that is unique per key, whatever the keys' sizes.

AQE splits a skewed partition only when both join inputs come straight from a
shuffle. Here the unique side often is an aggregate on the very join key, so hot
keys are taken apart explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is hot. There are at most rows / HOT_ROWS such
# keys (a million in 10^12 rows), which bounds what is broadcast.
HOT_ROWS = 1_000_000
SALTS = 64


def hot_keys(facts: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    return (
        facts.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > hot_rows).select(key, F.lit(True).alias("__hot"))
    )


def join_unique(
    facts: DataFrame, unique: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Inner or left join of ``facts`` with ``unique`` (one row per key), each side read once.

    Rows of hot keys are salted by a hash of the row, and the few unique rows of hot keys
    are copied to every salt. Keys are counted in ``counted``: a stored table that has at
    least the facts' rows of each key, where computing the facts is costly.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    hot = F.broadcast(hot_keys(facts if counted is None else counted, key, hot_rows))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS))).otherwise(0)
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = facts.join(hot, key, "left").withColumn("__salt", salt.cast("int")).drop("__hot")
    spread = unique.join(hot, key, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return salted.join(spread, [key, "__salt"], how).drop("__salt")
