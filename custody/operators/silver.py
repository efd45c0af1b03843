"""Staging: routing, field picks, normalisation and row validation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custody.functions.serials import ledger_serial, looks_like_url
from custody.functions.text import alias_pick, as_col, non_blank, strip
from custody.functions.times import parse_date
from custody.operators.bronze import at

# Alternative column names of every staged field, in pick order.
SHRED_ALIASES = {
    "batch_id": ["Batch ID", "batch_id"],
    "batch_date": ["Batch Date", "batch_date"],
    "client": ["Client", "client"],
    "location": ["Location", "location"],
    "tech": ["Tech", "tech", "Technician"],
    "serial": ["Serial Number", "serial_number", "Serial"],
}
REMOVAL_ALIASES = {
    "client": ["Client", "client"],
    "computer_serial": ["Computer Serial Number", "computer_serial", "Computer Serial"],
    "drive_serial": ["Drive Serial Number", "drive_serial", "Drive Serial"],
    "notes": ["Notes", "notes"],
    "tech_email": ["Tech Email", "tech_email", "Email"],
}
# The words that route a source to a staging table.
ROUTE_WORDS = {"shred": "shred", "removal": "removal"}

NO_SERIAL = "serial number is blank"
NO_DRIVE_SERIAL = "drive serial number is blank"
URL_SERIAL = "computer serial holds a link"


def routed(bronze: DataFrame, route: str, routes: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of one route: by word in the sheet id, or by an explicit list of ids."""
    if routes is not None:
        return bronze.filter(F.col("source_sheet_id").isin(routes.get(route, [])))
    return bronze.filter(F.col("source_sheet_id").ilike(f"%{ROUTE_WORDS[route]}%"))


def unstaged(bronze: DataFrame, staged: DataFrame | None) -> DataFrame:
    if staged is None:
        return bronze
    return bronze.join(staged.select("event_id"), "event_id", "left_anti")


def dedupe_key(batch_id: Column | str, serial: Column | str) -> Column:
    b, s = non_blank(batch_id), non_blank(serial)
    return F.when(b.isNotNull() & s.isNotNull(), F.concat_ws("|", b, s)).otherwise(F.lit(""))


def error_list(*checks: tuple[Column, str]) -> Column:
    """Messages of all failed checks, in order."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(msg)) for failed, msg in checks]))


def is_missing(raw: Column | str) -> Column:
    return strip(as_col(raw)) == ""


def stage_shreds(bronze: DataFrame, run_ts: datetime | Column) -> DataFrame:
    pick = {k: alias_pick("payload", names) for k, names in SHRED_ALIASES.items()}
    picked = bronze.select(
        "event_id",
        pick["batch_id"].alias("batch_id"),
        parse_date(pick["batch_date"]).alias("batch_date"),
        pick["client"].alias("client"),
        pick["location"].alias("location"),
        pick["tech"].alias("tech"),
        pick["serial"].alias("serial_raw"),
        F.col("source_timestamp").alias("event_time"),
    )
    checked = picked.withColumns(
        {
            "serial_norm": ledger_serial("serial_raw"),
            "validation_errors": error_list((is_missing("serial_raw"), NO_SERIAL)),
        }
    )
    return checked.select(
        "event_id", "batch_id", "batch_date", "client", "location", "tech",
        "serial_raw", "serial_norm",
        dedupe_key("batch_id", "serial_norm").alias("dedupe_key"),
        "event_time",
        (F.size("validation_errors") == 0).alias("is_valid"),
        "validation_errors",
        at(run_ts).alias("created_at"),
    )


def stage_removals(bronze: DataFrame, run_ts: datetime | Column) -> DataFrame:
    pick = {k: alias_pick("payload", names) for k, names in REMOVAL_ALIASES.items()}
    picked = bronze.select(
        "event_id",
        pick["client"].alias("client"),
        pick["computer_serial"].alias("computer_serial_raw"),
        pick["drive_serial"].alias("drive_serial_raw"),
        pick["notes"].alias("notes"),
        pick["tech_email"].alias("tech_email"),
        F.col("source_timestamp").alias("event_time"),
    )
    checked = picked.withColumn(
        "validation_errors",
        error_list(
            (is_missing("drive_serial_raw"), NO_DRIVE_SERIAL),
            (looks_like_url("computer_serial_raw"), URL_SERIAL),
        ),
    )
    return checked.select(
        "event_id", "client",
        "computer_serial_raw",
        ledger_serial("computer_serial_raw").alias("computer_serial_norm"),
        "drive_serial_raw",
        ledger_serial("drive_serial_raw").alias("drive_serial_norm"),
        "notes", "tech_email", "event_time",
        (F.size("validation_errors") == 0).alias("is_valid"),
        "validation_errors",
        at(run_ts).alias("created_at"),
    )


def invalid_rows(staged: DataFrame) -> DataFrame:
    return staged.filter(~F.col("is_valid"))


def error_counts(staged: DataFrame) -> DataFrame:
    """Rows per validation message."""
    return (
        invalid_rows(staged)
        .select(F.explode("validation_errors").alias("error"))
        .groupBy("error")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
