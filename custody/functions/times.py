"""Timestamps and dates read by a list of formats, first success wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from custody.functions.text import as_col

# Accepted forms in the order they are tried. One-letter fields
# take one or two digits.
TIMESTAMP_FORMS = ["y-M-d H:m:s", "M/d/y H:m:s", "y-M-d'T'H:m:s"]
DATE_FORMS = ["y-M-d", "M/d/y", "d/M/y"]

# Shape of a four-digit-year text; Spark's 'y' alone would accept other lengths.
_DATE_SHAPE = r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4})"
_ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}([.,]\d{1,6}\d{0,6})?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?$"


def _shaped(c: Column | str, tail: str) -> Column:
    t = as_col(c)
    return F.when(t.rlike(_DATE_SHAPE + tail), t)


def parse_timestamp(c: Column | str) -> Column:
    t = _shaped(c, r"[T ]\d{1,2}:\d{1,2}:\d{1,2}$")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in TIMESTAMP_FORMS])


def parse_date(c: Column | str) -> Column:
    """Month-first is tried before day-first, so 03/04/2024 is the fourth of March."""
    t = _shaped(c, "$")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in DATE_FORMS])


def parse_iso(c: Column | str) -> Column:
    """ISO date-time, with or without an offset; anything else is NULL."""
    t = as_col(c)
    return F.when(t.rlike(_ISO_SHAPE), F.regexp_replace(t, ",", ".")).try_cast("timestamp")
