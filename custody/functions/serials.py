"""Serial numbers: the two normalisers, plausibility, display tags, synthetic serials."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from custody.functions.text import (
    CONTROL_CHARS,
    WHITESPACE,
    as_col,
    has_non_ascii,
    non_blank,
    or_blank,
    strip,
)

# Texts that hardware reports in place of a serial.
PLACEHOLDER_SERIALS = [
    "unknown", "none", "n/a", "na", "null", "0",
    "0000000", "00000000", "000000000", "not specified",
]
MIN_SERIAL_LENGTH = 6
SYNTHETIC_PREFIX = "NOSERIAL-"
TRAILING_PUNCTUATION = ".,;:"

_BLANKS = "".join(ch for ch in WHITESPACE if ch not in CONTROL_CHARS)


def ledger_serial(raw: Column | str) -> Column:
    """Ledger form: strip, upper-case, drop trailing punctuation and blanks."""
    s = F.upper(strip(raw))
    return or_blank(F.rtrim(s, F.lit(WHITESPACE + TRAILING_PUNCTUATION)))


@F.pandas_udf(StringType())
def _fold_compat(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC")


def tracker_serial(raw: Column | str, fold_unicode: bool = True) -> Column:
    """Tracker form: fold look-alikes, delete controls, strip, collapse blanks, upper.

    Spark has no NFKC function, so rows holding non-ASCII text (only those) pass
    through one Arrow UDF. ``fold_unicode=False`` keeps the whole expression in
    the JVM for columns known to be ASCII.
    """
    c = as_col(raw)
    if fold_unicode:
        foreign = has_non_ascii(c)
        c = F.when(foreign, _fold_compat(F.when(foreign, c))).otherwise(c)
    # One pass turns every kind of blank into a space and deletes the controls.
    c = F.trim(F.translate(c, _BLANKS + CONTROL_CHARS, " " * len(_BLANKS)))
    c = F.when(c.contains("  "), F.regexp_replace(c, " {2,}", " ")).otherwise(c)
    return or_blank(F.upper(c))


def plausible_serial(raw: Column | str) -> Column:
    """True when a text is long enough and not a known placeholder."""
    s = strip(raw)
    return F.coalesce(
        (F.length(s) >= MIN_SERIAL_LENGTH) & ~F.lower(s).isin(PLACEHOLDER_SERIALS),
        F.lit(False),
    )


def serial_tag(serial: Column | str) -> Column:
    """Display tag; blank gives NULL."""
    s = non_blank(serial)
    return F.when(s.startswith(SYNTHETIC_PREFIX), F.lit("(no serial)")).when(
        s.isNotNull(), F.concat(F.lit("(SN "), s, F.lit(")"))
    )


def synthetic_serial(logical_json: Column, model_json: Column, size_json: Column) -> Column:
    """Stable stand-in for a missing disk serial.

    The digest covers the spaced JSON text of the three traits, each given here
    as JSON already (see ``hashing.json_text``).
    """
    blob = F.concat(
        F.lit('{"logical": '), logical_json,
        F.lit(', "model": '), model_json,
        F.lit(', "size": '), size_json,
        F.lit("}"),
    )
    return F.concat(F.lit(SYNTHETIC_PREFIX), F.substring(F.sha1(blob), 1, 12))


def looks_like_url(raw: Column | str) -> Column:
    t = F.lower(or_blank(raw))
    # Fragments that mark a pasted link.
    return t.contains("http://") | t.contains("https://") | t.contains("www.")
