"""Keyed upsert with one policy per column.

Built-in file tables have no MERGE, so the result is the complete next snapshot.
``changes`` must hold one row per key: aggregate it first. Both sides are then
unique on the join key and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.functions.text import non_blank

# A policy sees the stored value, the incoming value and two row-presence flags.
Policy = Callable[[Column, Column, Column, Column], Column]


def replace(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
    return F.when(incoming, new).otherwise(old)


def keep(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
    """Stored rows never change; new rows take the incoming value."""
    return F.when(stored, old).otherwise(new)


def fill_blank(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
    return F.coalesce(non_blank(old), new, old)


def prefer_non_blank(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
    return F.coalesce(non_blank(new), old, new)


def prefer_present(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
    return F.coalesce(new, old)


def add(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def either(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
    """A flag that is set and never cleared."""
    return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))


def initial(value: object) -> Policy:
    """Keep what is stored; new rows start from a constant."""
    return lambda old, new, stored, incoming: F.when(stored, old).otherwise(F.lit(value))


def guarded(only_from: str) -> Policy:
    """Move to the incoming value only from one state; later states never go back."""

    def policy(old: Column, new: Column, stored: Column, incoming: Column) -> Column:
        moves = incoming & (~stored | (old == only_from))
        return F.when(moves, new).otherwise(old)

    return policy


def upsert(
    target: DataFrame,
    changes: DataFrame,
    keys: list[str],
    policies: dict[str, Policy],
    small_changes: bool = False,
) -> DataFrame:
    """Next snapshot of ``target``.

    Columns missing from ``policies`` keep the stored value; a column missing
    from ``changes`` counts as NULL there. The default plan is one full outer
    join. ``small_changes`` uses a left join plus an anti join instead, which
    lets Spark, by its own size check, broadcast the increment and leave the
    target unshuffled; beyond that size both become sort-merge joins.
    """
    columns = target.columns
    values = [c for c in columns if c not in keys]
    have = [c for c in values if c in changes.columns]
    old = target.select(
        *keys, F.lit(True).alias("__stored"), *[F.col(c).alias(f"__old_{c}") for c in values]
    )
    new = changes.select(
        *keys, F.lit(True).alias("__incoming"), *[F.col(c).alias(f"__new_{c}") for c in have]
    )
    if small_changes:
        hit = target.select(*keys).join(new.select(*keys), keys, "left_semi")
        fresh = new.join(hit, keys, "left_anti")
        merged = old.join(new, keys, "left").unionByName(fresh, allowMissingColumns=True)
    else:
        merged = old.join(new, keys, "full_outer")

    stored = F.coalesce("__stored", F.lit(False))
    incoming = F.coalesce("__incoming", F.lit(False))
    types = dict(target.dtypes)

    def value(c: str) -> Column:
        before = F.col(f"__old_{c}")
        after = F.col(f"__new_{c}") if c in have else F.lit(None).cast(types[c])
        return policies.get(c, keep)(before, after, stored, incoming).cast(types[c]).alias(c)

    return merged.select(*[F.col(c) if c in keys else value(c) for c in columns])


def insert_missing(target: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Get-or-create: candidate rows whose key the target does not hold."""
    return candidates.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def changed_fields(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Map of changed column -> new value per key; unchanged rows are left out."""
    o = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in columns])
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"__old_{c}").eqNullSafe(F.col(c)),
                    F.struct(
                        F.lit(c).alias("key"),
                        F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"),
                    ),
                )
                for c in columns
            ]
        )
    )
    return (
        new.select(*keys, *columns)
        .join(o, keys, "inner")
        .select(*keys, F.map_from_entries(entries).alias("updated_fields"))
        .filter(F.size("updated_fields") > 0)
    )
