"""Canonical JSON text and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from custody.functions.text import as_col, has_non_ascii
from custody.functions.variants import parse_document

KEY_SEPARATOR = "\u0001"


def escape_non_ascii(text: Column) -> Column:
    r"""``\uXXXX`` escapes (UTF-16 units, lower case) for every non-ASCII character."""
    units = F.transform(
        F.split(text, ""),
        lambda ch: F.when(
            has_non_ascii(ch),
            F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", "\\\\u$1"),
        ).otherwise(ch),
    )
    return F.when(has_non_ascii(text), F.array_join(units, "")).otherwise(text)


def payload_json(payload: Column | str) -> Column:
    """Key-sorted compact JSON of a flat string map, ASCII only."""
    entries = F.array_sort(F.map_entries(as_col(payload)))
    return escape_non_ascii(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}))


def payload_hash(payload: Column | str) -> Column:
    return F.sha2(payload_json(payload), 256)


def bundle_hash(raw: Column | str, mode: str = "canonical") -> Column:
    """Hash of a JSON document.

    ``canonical`` ignores key order and layout (VARIANT keeps keys sorted);
    ``text`` hashes the raw text, for feeds where 1 and 1.0 must stay apart.
    """
    if mode == "text":
        return F.sha2(as_col(raw), 256)
    if mode != "canonical":
        raise ValueError(f"unknown hash mode {mode!r}")
    return document_hash(parse_document(raw))


def document_hash(bundle: Column | str) -> Column:
    """Canonical hash of an already parsed document."""
    return F.sha2(F.to_json(as_col(bundle)), 256)


def key_hash(*cols: Column | str) -> Column:
    """Deterministic id of a natural key; NULL parts count as blank."""
    return F.sha2(
        F.concat_ws(KEY_SEPARATOR, *[F.coalesce(as_col(c).cast("string"), F.lit("")) for c in cols]),
        256,
    )


def json_text(value: Column) -> Column:
    """Spaced, ASCII-escaped JSON of a VARIANT scalar or list of scalars; NULL is 'null'."""
    items = F.try_variant_get(value, "$", "array<variant>")
    spaced = F.concat(
        F.lit("["), F.array_join(F.transform(items, lambda x: F.to_json(x)), ", "), F.lit("]")
    )
    return F.coalesce(
        escape_non_ascii(F.when(items.isNotNull(), spaced).otherwise(F.to_json(value))),
        F.lit("null"),
    )


def json_string(text: Column) -> Column:
    """A SQL string as an ASCII-escaped JSON string literal."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
    return F.coalesce(escape_non_ascii(F.nullif(quoted, F.lit(""))), F.lit("null"))
