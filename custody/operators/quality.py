"""Declared constraints as checks: unique keys, accepted values, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custody import schemas


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def unaccepted(df: DataFrame, column: str, accepted: list[str]) -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).isin(accepted), F.lit(False)))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference points nowhere."""
    return child.filter(F.col(column).isNotNull()).join(
        parent.select(F.col(key).alias(column)), column, "left_anti"
    )


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) for every declared rule of the tables given."""
    found = []
    for name, df in tables.items():
        if name in schemas.UNIQUE_KEYS:
            key = schemas.UNIQUE_KEYS[name]
            found.append((f"{name}: unique {'+'.join(key)}", duplicate_keys(df, key)))
        for column, accepted in schemas.ACCEPTED_VALUES.get(name, {}).items():
            found.append((f"{name}: accepted {column}", unaccepted(df, column, accepted)))
    return check_counts(found)


def check_counts(found: list[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(check).alias("check"), "violations")
            for check, bad in found
        ],
    )


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) of every declared key, accepted code and reference, in one pass a table.

    Keys and references of all tables are one union of (check, key) rows and counted in one
    aggregate with partial combination, so a key held by very many rows costs one row a task and
    no table meets another in a join. Accepted codes are counts beside it, without a shuffle of
    rows. A key that repeats counts once, NULL members being equal to each other; a reference
    counts each row that points nowhere, NULL references none. Checks without a violation give 0.
    """
    keyed, counted, checks = [], [], []

    def rows(df: DataFrame, check: str, columns: list[str], owns: bool, points: bool) -> DataFrame:
        checks.append(check)
        key = F.array(*[F.col(c).cast("string") for c in columns]).alias("key")
        return df.select(F.lit(check).alias("check"), key, F.lit(int(owns)).alias("owns"), F.lit(int(points)).alias("points"))

    for name, df in tables.items():
        if name in schemas.UNIQUE_KEYS:
            key = schemas.UNIQUE_KEYS[name]
            keyed.append(rows(df, f"{name}: unique {'+'.join(key)}", key, True, False))
        for column, (parent, key) in schemas.REFERENCES.get(name, {}).items():
            if parent in tables:
                check = f"{name}: {column} in {parent}"
                keyed.append(rows(df.filter(F.col(column).isNotNull()), check, [column], False, True))
                keyed.append(rows(tables[parent], check, [key], True, False))
        accepted = schemas.ACCEPTED_VALUES.get(name, {})
        if accepted:
            bad = [F.count_if(~F.coalesce(F.col(c).isin(codes), F.lit(False))).alias(f"{name}: accepted {c}") for c, codes in accepted.items()]
            counted.append(df.agg(*bad).unpivot([], [f"`{name}: accepted {c}`" for c in accepted], "check", "violations"))
    if keyed:
        # one neutral row a check, so that a check over empty tables is listed too
        neutral = keyed[0].sparkSession.createDataFrame([(c, None, 0, 0) for c in sorted(set(checks))], "check string, key array<string>, owns int, points int")
        per_key = reduce(DataFrame.unionByName, [*keyed, neutral]).groupBy("check", "key").agg(F.sum("owns").alias("owns"), F.sum("points").alias("points"))
        is_key = F.col("check").contains(": unique ")
        wrong = F.when(is_key, (F.col("owns") > 1).cast("long")).otherwise(F.when(F.col("owns") == 0, F.col("points")).otherwise(0))
        found = per_key.groupBy("check").agg(F.sum(wrong).alias("violations"))
        counted.append(found)
    return reduce(DataFrame.unionByName, counted)
