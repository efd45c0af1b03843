"""Tolerant reads from VARIANT documents: a wrong shape is NULL, never an error."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from custody.functions.text import as_col

# Drawn when the library is loaded, so that no stored text can hold it.
_END_MARK = uuid.uuid4().hex


def parse_document(raw: Column | str) -> Column:
    """VARIANT of a JSON text, NULL for anything else.

    ``try_parse_json`` stops after the first value and would accept trailing
    text. The text is parsed as the first element of a list whose second one is an
    end mark; the list must have just these two.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), as_col(raw), F.lit(f',"{_END_MARK}"]')))
    complete = (F.try_variant_get(pair, "$[1]", "string") == _END_MARK) & F.try_variant_get(pair, "$[2]", "variant").isNull()
    return F.when(complete, F.try_variant_get(pair, "$[0]", "variant"))


def member(doc: Column | str, path: str) -> Column:
    """Sub-document at a path. Present-but-null is a VARIANT null, absent is NULL."""
    return F.try_variant_get(as_col(doc), path, "variant")


def text_at(doc: Column | str, path: str) -> Column:
    return F.try_variant_get(as_col(doc), path, "string")


def long_at(doc: Column | str, path: str) -> Column:
    return F.try_variant_get(as_col(doc), path, "bigint")


def items_at(doc: Column | str, path: str) -> Column:
    """Elements of a list, empty when the path holds anything else."""
    return F.coalesce(
        F.try_variant_get(as_col(doc), path, "array<variant>"),
        F.array().cast("array<variant>"),
    )


def is_object(v: Column) -> Column:
    """A cast to a struct succeeds for objects only and does not visit their members."""
    return F.try_variant_get(v, "$", "struct<x:variant>").isNotNull()


# The checks below are meant for leaves: the schema of a large document is costly.
def is_integer(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "BIGINT", F.lit(False))


def is_boolean(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "BOOLEAN", F.lit(False))


def is_number(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.coalesce(
        kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL"), F.lit(False)
    )


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def truthy(v: Column) -> Column:
    """False for absent, null, blank, zero, false and empty containers."""
    empty = ["null", '""', "false", "0", "0.0", "{}", "[]"]
    return F.coalesce(~F.to_json(v).isin(empty), F.lit(False))
