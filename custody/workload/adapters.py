"""The given tables seen as custody data. Each adapter has its SQL text beside it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_1 = datetime(2024, 6, 1, 12, 0, 0)
RUN_2 = datetime(2024, 6, 2, 12, 0, 0)
SPLIT = "2024-01-16"

# --- events as drive events -------------------------------------------------

SQL_EVENTS = """
    ev AS (SELECT event_id, lpad(event_id::VARCHAR, 12, '0') AS id, ts,
                  user_id || '-' || strftime(ts, '%Y%m%d') AS serial_norm,
                  CASE event_type WHEN 'signup' THEN 'REMOVED' WHEN 'purchase' THEN 'SHREDDED' END AS kind,
                  CASE WHEN event_type = 'purchase' THEN 'B' || (event_id % 97) END AS batch_id,
                  'C' || (event_id % 11) AS client, 'PC-' || user_id AS computer_serial, props AS notes
           FROM events)
"""


def all_events(t) -> DataFrame:
    """Every event with its drive serial; ``event_type`` NULL marks mere sightings."""
    return t.events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("drive_event_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("serial_norm"),
        F.when(F.col("event_type") == "signup", "REMOVED")
        .when(F.col("event_type") == "purchase", "SHREDDED").alias("event_type"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("source_event_id"),
        F.when(
            F.col("event_type") == "purchase",
            F.concat(F.lit("B"), (F.col("event_id") % 97).cast("string")),
        ).alias("batch_id"),
        F.concat(F.lit("C"), (F.col("event_id") % 11).cast("string")).alias("client"),
        F.concat(F.lit("PC-"), F.col("user_id").cast("string")).alias("computer_serial"),
        F.col("props").alias("notes"),
        F.lit(RUN_1).cast("timestamp").alias("created_at"),
    )


def drive_events(t) -> DataFrame:
    return all_events(t).filter(F.col("event_type").isNotNull())


def drives(t) -> DataFrame:
    return (
        all_events(t).select("serial_norm").distinct()
        .withColumns({c: F.lit(RUN_1).cast("timestamp") for c in ["first_seen_at", "last_seen_at"]})
    )


# --- events as spreadsheet rows ----------------------------------------------

SQL_ROWS = """
    src AS (SELECT event_id AS n, ts, event_type, user_id, props,
              CASE WHEN event_id % 53 = 0 THEN ' '
                   WHEN event_id % 59 = 0 THEN '...'
                   WHEN event_id % 3 = 0 THEN ' ' || lower('Drv-' || user_id || '-' || strftime(ts, '%Y%m%d')) || ' .'
                   ELSE 'DRV-' || user_id || '-' || strftime(ts, '%Y%m%d') END AS serial_raw,
              CASE WHEN event_id % 31 = 0 THEN 'https://pc.example/' || user_id ELSE 'pc-' || user_id || ';' END AS computer_raw,
              CASE WHEN event_id % 41 = 0 THEN NULL ELSE date_trunc('second', ts) END AS event_time,
              CASE WHEN event_id % 13 = 0 THEN '' ELSE 'B' || (event_id % 97) END AS batch_id,
              CASE WHEN event_id % 7 = 0 THEN '' ELSE 'C' || (event_id % 11) END AS client,
              CASE WHEN event_id % 5 = 0 THEN '' ELSE 'Hall ' || (event_id % 3) END AS location,
              CASE WHEN event_id % 17 = 0 THEN '' ELSE 'T' || (event_id % 4) END AS tech,
              CASE WHEN event_id % 19 = 0 THEN NULL ELSE ts::DATE END AS batch_date
            FROM events WHERE event_type IN ('signup', 'purchase')),
    rows AS (SELECT *,
              regexp_replace(upper(trim(serial_raw)), '[\\s.,;:]+$', '') AS serial_norm,
              upper(regexp_replace(computer_raw, '[\\s.,;:]+$', '')) AS computer_norm,
              trim(serial_raw) = '' AS no_serial,
              computer_raw LIKE 'https://%' AS is_url,
              sha256('google_sheets' || chr(1) || kind || chr(1) || 'data' || chr(1) || kind || ':data:' || n || chr(1) || payload_hash) AS event_id
            FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'removal_log' ELSE 'shred_log' END AS kind,
                    CASE event_type WHEN 'signup' THEN sha256('{"Client":"' || client || '","Drive Serial Number":"' || serial_raw
                        || '","Notes":"' || replace(props, '"', '\\"') || '","Tech Email":"t@example.org","Timestamp":"'
                        || coalesce(CASE n % 2 WHEN 0 THEN strftime(event_time, '%Y-%m-%d %H:%M:%S') ELSE strftime(event_time, '%m/%d/%Y %H:%M:%S') END, '')
                        || '","computer_serial":"' || computer_raw || '"}')
                    ELSE sha256('{"Batch ID":"' || batch_id || '","Location":"' || location || '","Serial":"' || serial_raw
                        || '","Technician":"' || tech || '","batch_date":"' || coalesce(strftime(batch_date, '%Y-%m-%d'), 'none')
                        || '","client":"' || client || '","timestamp":"' || coalesce(strftime(event_time, '%Y-%m-%dT%H:%M:%S'), '') || '"}') END AS payload_hash
                  FROM src))
"""


def sheet_rows(t) -> DataFrame:
    """Sign-ups as removal rows, purchases as shred rows, with dirty cells."""
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    day = F.date_format("ts", "yyyyMMdd")
    serial = (
        F.when(n % 53 == 0, F.lit(" "))
        .when(n % 59 == 0, F.lit("..."))
        .when(n % 3 == 0, F.concat(F.lit(" drv-"), user, F.lit("-"), day, F.lit(" .")))
        .otherwise(F.concat(F.lit("DRV-"), user, F.lit("-"), day))
    )
    computer = F.when(n % 31 == 0, F.concat(F.lit("https://pc.example/"), user)).otherwise(
        F.concat(F.lit("pc-"), user, F.lit(";"))
    )

    def stamp(pattern: str):
        return F.when(n % 41 == 0, F.lit("")).otherwise(F.date_format("ts", pattern))

    def code(prefix: str, modulus: int, blank_every: int):
        return F.when(n % blank_every == 0, F.lit("")).otherwise(
            F.concat(F.lit(prefix), (n % modulus).cast("string"))
        )

    def as_map(cells: dict):
        return F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)])

    removal = as_map(
        {
            "Timestamp": F.when(n % 2 == 0, stamp("yyyy-MM-dd HH:mm:ss")).otherwise(stamp("MM/dd/yyyy HH:mm:ss")),
            "Client": code("C", 11, 7),
            "computer_serial": computer,
            "Drive Serial Number": serial,
            "Notes": F.col("props"),
            "Tech Email": F.lit("t@example.org"),
        }
    )
    shred = as_map(
        {
            "timestamp": stamp("yyyy-MM-dd'T'HH:mm:ss"),
            "Batch ID": code("B", 97, 13),
            "batch_date": F.when(n % 19 == 0, F.lit("none")).otherwise(F.date_format("ts", "yyyy-MM-dd")),
            "client": code("C", 11, 7),
            "Location": code("Hall ", 3, 5),
            "Technician": code("T", 4, 17),
            "Serial": serial,
        }
    )
    is_removal = F.col("event_type") == "signup"
    return t.events.filter(F.col("event_type").isin("signup", "purchase")).select(
        F.when(is_removal, "removal_log").otherwise("shred_log").alias("source_sheet_id"),
        F.lit("data").alias("source_tab"),
        n.alias("row_number"),
        F.when(is_removal, removal).otherwise(shred).alias("payload"),
    )
