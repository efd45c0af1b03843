"""Byte, memory and clock-rate texts. Rounding is half-even, as in the source system."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from custody.functions.text import as_col

DECIMAL_STEPS = ["B", "KB", "MB", "GB", "TB", "PB"]
IEC_STEPS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
MISSING = "—"


def fixed(x: Column, digits: int) -> Column:
    """Number text with a fixed count of decimals (``printf`` would round half-up)."""
    return F.call_function("format_number", x, F.lit("0" if digits == 0 else "0." + "0" * digits))


def _ladder(x: Column, units: list[str], first_is_integer: bool) -> Column:
    def step(i: int) -> Column:
        if i == 0 and first_is_integer:
            return F.concat(x.cast("bigint").cast("string"), F.lit(f" {units[0]}"))
        return F.concat(fixed(x / F.lit(float(1024**i)), 1), F.lit(f" {units[i]}"))

    rungs = range(len(units) - 1)
    start = F.when(x < F.lit(1024.0), step(0))
    chain = reduce(lambda acc, i: acc.when(x < F.lit(float(1024 ** (i + 1))), step(i)), rungs[1:], start)
    return chain.otherwise(step(len(units) - 1))


def format_bytes(n: Column | str) -> Column:
    """'256.0 GB'; nothing or zero is '0 B'."""
    x = as_col(n).cast("double")
    return F.when(x.isNull() | (x == 0), F.lit("0 B")).otherwise(_ladder(x, DECIMAL_STEPS, False))


def capacity_text(n: Column | str) -> Column:
    """As ``format_bytes`` but NULL when there is no capacity."""
    x = as_col(n).cast("double")
    return F.when(x != 0, _ladder(x, DECIMAL_STEPS, False))


def iec_bytes(n: Column | str) -> Column:
    """'1.5 GiB', whole bytes below 1 KiB, a dash when missing."""
    x = as_col(n).try_cast("double")
    return F.when(x.isNull(), F.lit(MISSING)).otherwise(_ladder(x, IEC_STEPS, True))


def memory_text(n: Column | str) -> Column:
    """Whole GB when within a hundredth of one, else one decimal; NULL for nothing."""
    x = as_col(n).cast("double")
    gb = x / F.lit(float(1024**3))
    whole = F.rint(gb)
    text = F.when(
        F.abs(gb - whole) < 0.01, F.concat(whole.cast("bigint").cast("string"), F.lit(" GB"))
    ).otherwise(F.concat(fixed(gb, 1), F.lit(" GB")))
    return F.when(x != 0, text)


def memory_text_to_bytes(text: Column | str) -> Column:
    """Read '16.0 GB' back into bytes."""
    t = as_col(text)
    value = F.get(F.split(t, " "), F.lit(0)).try_cast("double")
    unit = F.upper(F.get(F.split(t, " "), F.lit(1)))
    factor = F.lit(1.0)
    for power, name in enumerate(["KB", "MB", "GB", "TB"], start=1):
        factor = F.when(unit == name, F.lit(float(1024**power))).otherwise(factor)
    return (value * factor).cast("bigint")


def clock_text(hz: Column | str) -> Column:
    """GHz with two decimals, MHz below one GHz, NULL when not positive."""
    x = as_col(hz).cast("bigint").cast("double")
    return F.when(x >= 1e9, F.concat(fixed(x / 1e9, 2), F.lit(" GHz"))).when(
        x > 0, F.concat(fixed(x / 1e6, 0), F.lit(" MHz"))
    )


def clock_text_ghz(hz: Column | str) -> Column:
    """Always GHz, a dash when missing or zero."""
    x = as_col(hz).try_cast("double")
    return F.when(x != 0, F.concat(fixed(x / 1e9, 2), F.lit(" GHz"))).otherwise(F.lit(MISSING))
