"""Blank handling, trimming, pattern picks and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points str.strip() removes in the source system.
WHITESPACE = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)
# Control characters the tracker normaliser deletes.
CONTROL_CHARS = "".join(chr(c) for c in [*range(0x20), 0x7F])

LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_non_ascii(c: Column | str) -> Column:
    """More bytes than characters: cheaper than a pattern."""
    return F.octet_length(as_col(c)) > F.char_length(as_col(c))


def non_blank(c: Column | str) -> Column:
    """NULL for an empty string, the text otherwise."""
    return F.nullif(as_col(c), F.lit(""))


def or_blank(c: Column | str) -> Column:
    """Empty string for NULL: the public edge of every text column."""
    return F.coalesce(as_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Unicode-aware trim on both ends (plain ``trim`` removes spaces only)."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def first_non_blank(*cols: Column | str, default: str | None = "") -> Column:
    picks = [non_blank(c) for c in cols]
    return F.coalesce(*picks, F.lit(default)) if default is not None else F.coalesce(*picks)


def alias_pick(payload: Column | str, names: list[str]) -> Column:
    """First non-blank value among alternative keys of a string map, else ''."""
    m = as_col(payload)
    return first_non_blank(*[F.try_element_at(m, F.lit(n)) for n in names])


def key_line(text: Column | str, key: str) -> Column:
    """Value of the first ``key: value`` line, stripped."""
    lines = F.transform(F.split(as_col(text), "\n"), strip)
    own = F.filter(lines, lambda x: x.startswith(f"{key}:") & (F.length(x) > len(key) + 1))
    return strip(F.substr(F.get(own, F.lit(0)), F.lit(len(key) + 2)))


def first_line(text: Column | str, limit: int = 140) -> Column:
    """First line of the stripped text, at most ``limit`` characters, blank -> NULL."""
    t = non_blank(strip(text))
    return F.substring(F.get(F.split(t, LINE_BREAKS), F.lit(0)), 1, limit)


def preview(text: Column | str, limit: int = 50) -> Column:
    """Shortened text with an ellipsis; '-' when there is nothing to show."""
    t = as_col(text)
    return (
        F.when(t.isNull() | (t == ""), F.lit("-"))
        .when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("...")))
        .otherwise(t)
    )


def append_note(note: Column | str, addition: str) -> Column:
    """Add a line to a note unless the note already contains it."""
    n = or_blank(strip(note))
    return (
        F.when(n == "", F.lit(addition))
        .when(n.contains(addition), or_blank(note))
        .otherwise(F.concat(n, F.lit("\n" + addition)))
    )


def text_lines(text: Column | str, drop_containing: str | None = None) -> Column:
    """Stripped, non-blank lines as an array, optionally without lines holding a phrase."""
    lines = F.transform(F.split(or_blank(text), LINE_BREAKS), strip)
    if drop_containing is None:
        return F.filter(lines, lambda l: l != "")
    return F.filter(lines, lambda l: (l != "") & ~l.contains(drop_containing))


def file_tag(file_name: Column | str) -> Column:
    """Asset tag carried by a ``TAG.json`` file name, NULL when the name has another form."""
    # Fixed value: accepted file-name form.
    return non_blank(F.regexp_extract(as_col(file_name), r"^([A-Za-z0-9_-]+)\.json$", 1))


def collector_status(rc: Column | str) -> Column:
    c = as_col(rc)
    return (
        F.when(c == 0, F.lit("OK"))
        .when(c == 127, F.lit("MISSING"))
        .otherwise(F.concat(F.lit("rc="), c.cast("string")))
    )
