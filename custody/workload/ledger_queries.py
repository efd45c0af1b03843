"""Ingest, staging, promotion, matching and the four views."""

from __future__ import annotations

from pyspark.sql import functions as F

from custody import schemas
from custody.functions.text import alias_pick
from custody.operators import bronze, gold, matching, reports, silver
from custody.operators.bronze import to_bronze
from custody.plans.ledger import Ledger
from custody.session import shared_dir
from custody.workload.adapters import (
    RUN_1,
    RUN_2,
    SPLIT,
    SQL_EVENTS,
    SQL_ROWS,
    all_events,
    drive_events,
    drives,
    sheet_rows,
)
from custody.workload.registry import joined, query, sql_ts, ts_text


def empty(t, schema: str):
    return t.spark.createDataFrame([], schema)


# --- ingest -------------------------------------------------------------------

SQL_LOADS = """
    docs AS (SELECT source, sha256(text) AS h, doc_id FROM documents),
    stored AS (SELECT DISTINCT source, h FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)),
    keys AS (SELECT source, h, count(*) AS n FROM docs GROUP BY ALL)
"""


def document_loads(t):
    """All documents arrive; those with labels are stored already."""
    docs = t.documents.select("source", F.sha2("text", 256).alias("h"), "doc_id")
    stored = docs.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return docs, stored


@query(
    "idempotent_append",
    f"""
    WITH {SQL_LOADS}
    SELECT coalesce(source, 'TOTAL') AS source, sum(CASE WHEN s.h IS NULL THEN 1 ELSE 0 END)::BIGINT AS inserted,
           sum(n - CASE WHEN s.h IS NULL THEN 1 ELSE 0 END)::BIGINT AS duplicates
    FROM keys LEFT JOIN stored s USING (source, h) GROUP BY ROLLUP (source)
    """,
)
def idempotent_append(t):
    docs, stored = document_loads(t)
    return bronze.append_report(docs, stored, "source", ["source", "h"]).withColumn(
        "source", F.coalesce("source", F.lit("TOTAL"))
    )


@query(
    "append_new_rows",
    f"WITH {SQL_LOADS} SELECT source, h FROM keys ANTI JOIN stored USING (source, h)",
)
def append_new_rows(t):
    docs, stored = document_loads(t)
    return bronze.new_rows(docs.select("source", "h"), stored, ["source", "h"])


@query(
    "bronze_events",
    f"""
    WITH {SQL_ROWS}
    SELECT n, event_id, kind || ':data:' || n AS source_row_key, {sql_ts("event_time")} AS source_timestamp, payload_hash FROM rows
    """,
)
def bronze_events(t):
    return to_bronze(sheet_rows(t), RUN_1).select(
        F.element_at(F.split("source_row_key", ":"), -1).cast("bigint").alias("n"),
        "event_id", "source_row_key", ts_text("source_timestamp").alias("source_timestamp"), "payload_hash",
    )


@query(
    "latest_row_versions",
    """
    SELECT o_custkey, max_by(o_orderkey, (o_orderdate, lpad(o_orderkey::VARCHAR, 12, '0'))) AS o_orderkey
    FROM orders GROUP BY o_custkey
    """,
)
def latest_row_versions(t):
    versions = t.orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("event_id"),
        F.col("o_custkey").alias("source_row_key"),
        F.col("o_orderdate").alias("ingested_at"),
    )
    return bronze.latest_per_row_key(versions).select(
        F.col("source_row_key").alias("o_custkey"), F.col("event_id").cast("bigint").alias("o_orderkey")
    )


# --- staging -------------------------------------------------------------------

@query(
    "alias_pick",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN o_orderpriority
                WHEN o_orderkey % 4 = 2 THEN o_orderstatus ELSE '  ' END AS picked
    FROM orders
    """,
)
def alias_picks(t):
    cell = {
        "Client": F.when(F.col("o_orderkey") % 4 == 1, F.col("o_orderpriority"))
        .when(F.col("o_orderkey") % 4 == 3, F.lit("  ")).otherwise(F.lit("")),
        "client": F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")),
    }
    payload = F.create_map(*[x for k, v in cell.items() for x in (F.lit(k), v)])
    return t.orders.select("o_orderkey", alias_pick(payload, ["Client", "client", "Kunde"]).alias("picked"))


@query(
    "route_rows",
    """
    SELECT route, doc_id FROM (
      SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'SHRED' || source ELSE source END || CASE WHEN lang IN ('de', 'fr') THEN '_Removals' ELSE '' END AS sheet FROM documents),
      (VALUES ('shred'), ('removal')) r(route)
    WHERE sheet ILIKE '%' || route || '%'
    """,
)
def route_rows(t):
    sheet = F.concat(
        F.when(F.col("lang").isin("en", "de"), F.lit("SHRED")).otherwise(F.lit("")), F.col("source"),
        F.when(F.col("lang").isin("de", "fr"), F.lit("_Removals")).otherwise(F.lit("")),
    )
    rows = t.documents.select("doc_id", sheet.alias("source_sheet_id"))
    parts = [silver.routed(rows, r).select(F.lit(r).alias("route"), "doc_id") for r in silver.ROUTE_WORDS]
    return parts[0].unionByName(parts[1])


@query(
    "stage_anti",
    "SELECT o_orderkey AS event_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def stage_anti(t):
    return silver.unstaged(
        t.orders.select(F.col("o_orderkey").alias("event_id")),
        t.lineitem.select(F.col("l_orderkey").alias("event_id")),
    )


@query(
    "stage_shreds",
    f"""
    WITH {SQL_ROWS}
    SELECT event_id, batch_id, strftime(batch_date, '%Y-%m-%d') AS batch_date, client, location, tech, serial_raw, serial_norm,
           CASE WHEN batch_id <> '' AND serial_norm <> '' THEN batch_id || '|' || serial_norm ELSE '' END AS dedupe_key,
           {sql_ts("event_time")} AS event_time, NOT no_serial AS is_valid,
           CASE WHEN no_serial THEN '{silver.NO_SERIAL}' ELSE '' END AS errors
    FROM rows WHERE kind = 'shred_log'
    """,
)
def stage_shreds(t):
    staged = silver.stage_shreds(silver.routed(to_bronze(sheet_rows(t), RUN_1), "shred"), RUN_1)
    return staged.select(
        "event_id", "batch_id", F.date_format("batch_date", "yyyy-MM-dd").alias("batch_date"), "client",
        "location", "tech", "serial_raw", "serial_norm", "dedupe_key",
        ts_text("event_time").alias("event_time"), "is_valid", joined("validation_errors").alias("errors"),
    )


@query(
    "stage_removals",
    f"""
    WITH {SQL_ROWS}
    SELECT event_id, client, computer_raw AS computer_serial_raw, computer_norm AS computer_serial_norm,
           serial_raw AS drive_serial_raw, serial_norm AS drive_serial_norm, props AS notes, 't@example.org' AS tech_email,
           {sql_ts("event_time")} AS event_time, NOT (no_serial OR is_url) AS is_valid,
           concat_ws('; ', CASE WHEN no_serial THEN '{silver.NO_DRIVE_SERIAL}' END,
                           CASE WHEN is_url THEN '{silver.URL_SERIAL}' END) AS errors
    FROM rows WHERE kind = 'removal_log'
    """,
)
def stage_removals(t):
    staged = silver.stage_removals(silver.routed(to_bronze(sheet_rows(t), RUN_1), "removal"), RUN_1)
    return staged.withColumns(
        {"event_time": ts_text("event_time"), "errors": joined("validation_errors")}
    ).drop("validation_errors", "created_at")


def page_rows(t):
    """Pages as removal rows: the URL was typed into the computer serial."""
    payload = F.create_map(
        F.lit("Computer Serial"), F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url")),
        F.lit("Drive Serial"), F.when(F.col("page_id") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("p"), F.col("page_id").cast("string"))),
    )
    return t.pages.select(
        F.col("page_id").cast("string").alias("event_id"), payload.alias("payload"),
        F.lit(None).cast("timestamp").alias("source_timestamp"),
    )


SQL_PAGES = """
    p AS (SELECT page_id, page_id % 4 = 0 AS no_serial,
                 CASE WHEN page_id % 3 = 0 THEN lower(regexp_replace(url, '^https?://', '')) LIKE '%www.%'
                           OR regexp_matches(regexp_replace(url, '^https?://', ''), '(?i)https?://')
                      ELSE regexp_matches(url, '(?i)https?://|www\\.') END AS is_url FROM pages)
"""


@query(
    "validate_rows",
    f"""
    WITH {SQL_PAGES}
    SELECT page_id::VARCHAR AS event_id, NOT (no_serial OR is_url) AS is_valid,
           concat_ws('; ', CASE WHEN no_serial THEN '{silver.NO_DRIVE_SERIAL}' END, CASE WHEN is_url THEN '{silver.URL_SERIAL}' END) AS errors
    FROM p
    """,
)
def validate_rows(t):
    staged = silver.stage_removals(page_rows(t), RUN_1)
    return staged.select("event_id", "is_valid", joined("validation_errors").alias("errors"))


@query(
    "invalid_report",
    f"""
    WITH {SQL_PAGES}
    SELECT '{silver.NO_DRIVE_SERIAL}' AS error, count(*) AS rows FROM p WHERE no_serial HAVING count(*) > 0
    UNION ALL SELECT '{silver.URL_SERIAL}', count(*) FROM p WHERE is_url HAVING count(*) > 0
    """,
)
def invalid_report(t):
    return silver.error_counts(silver.stage_removals(page_rows(t), RUN_1))


@query(
    "schema_fidelity",
    f"WITH {SQL_PAGES} SELECT DISTINCT page_id::VARCHAR AS event_id FROM p WHERE NOT (no_serial OR is_url)",
)
def schema_fidelity(t):
    return silver.stage_removals(page_rows(t), RUN_1).filter("is_valid").select("event_id").distinct()


# --- promotion -------------------------------------------------------------------

SQL_PROMOTED = f"""
    {SQL_ROWS},
    good AS (SELECT * EXCLUDE (event_type), CASE kind WHEN 'shred_log' THEN 'SHREDDED' ELSE 'REMOVED' END AS event_type,
                    coalesce(event_time, TIMESTAMP '2024-06-01 12:00:00') AS at_ts
             FROM rows WHERE NOT no_serial AND NOT (kind = 'removal_log' AND is_url) AND serial_norm <> ''),
    sides AS (SELECT serial_norm, count(*) FILTER (event_type = 'REMOVED') AS r, count(*) FILTER (event_type = 'SHREDDED') AS s FROM good GROUP BY ALL)
"""


def staged(t):
    rows = to_bronze(sheet_rows(t), RUN_1)
    return (
        silver.stage_shreds(silver.routed(rows, "shred"), RUN_1),
        silver.stage_removals(silver.routed(rows, "removal"), RUN_1),
    )


def promoted(t) -> gold.Promotion:
    shreds, removals = staged(t)
    return gold.promote(
        shreds, removals, empty(t, schemas.DRIVE), empty(t, schemas.BATCH), empty(t, schemas.DRIVE_EVENT), RUN_1
    )


@query(
    "promote_events",
    f"""
    WITH {SQL_PROMOTED}
    SELECT sha256(event_id || chr(1) || event_type) AS drive_event_id, serial_norm, event_type, {sql_ts("at_ts")} AS event_time,
           event_id AS source_event_id, CASE WHEN event_type = 'SHREDDED' THEN nullif(batch_id, '') END AS batch_id, client,
           CASE WHEN event_type = 'REMOVED' THEN computer_norm ELSE '' END AS computer_serial,
           CASE WHEN event_type = 'REMOVED' THEN props ELSE '' END AS notes
    FROM good
    """,
)
def promote_events(t):
    return promoted(t).new_events.withColumn("event_time", ts_text("event_time")).drop("created_at")


@query(
    "promote_skipped",
    f"""
    WITH {SQL_ROWS}
    SELECT event_id, CASE kind WHEN 'shred_log' THEN 'SHREDDED' ELSE 'REMOVED' END AS event_type FROM rows
    WHERE serial_norm = '' AND NOT no_serial AND NOT (kind = 'removal_log' AND is_url)
    """,
)
def promote_skipped(t):
    return promoted(t).skipped_blank


@query(
    "promote_entities",
    f"""
    WITH {SQL_EVENTS}
    SELECT serial_norm,
           {sql_ts(f"CASE WHEN min(ts) < DATE '{SPLIT}' THEN TIMESTAMP '2024-06-01 12:00:00' ELSE TIMESTAMP '2024-06-02 12:00:00' END")} AS first_seen_at,
           {sql_ts(f"CASE WHEN max(ts) >= DATE '{SPLIT}' THEN TIMESTAMP '2024-06-02 12:00:00' ELSE TIMESTAMP '2024-06-01 12:00:00' END")} AS last_seen_at
    FROM ev GROUP BY ALL
    """,
)
def promote_entities(t):
    """Two loads, split at a date: every third serial would show in both if days allowed."""
    events = all_events(t)
    first = events.filter(F.col("event_time") < F.lit(SPLIT).cast("timestamp"))
    second = events.filter(F.col("event_time") >= F.lit(SPLIT).cast("timestamp"))
    after_one = gold.upsert_drives(empty(t, schemas.DRIVE), first, RUN_1)
    both = gold.upsert_drives(after_one, second, RUN_2)
    return both.select(
        "serial_norm", ts_text("first_seen_at").alias("first_seen_at"), ts_text("last_seen_at").alias("last_seen_at")
    )


@query(
    "promote_batches",
    f"""
    WITH {SQL_ROWS},
    good AS (SELECT *, (coalesce(event_time, TIMESTAMP '2024-06-02 12:00:00'), event_id) AS ord,
                    coalesce(event_time, TIMESTAMP '2024-06-02 12:00:00') >= DATE '{SPLIT}' AS late
             FROM rows WHERE kind = 'shred_log' AND NOT no_serial AND serial_norm <> '' AND batch_id <> '')
    SELECT batch_id, strftime(arg_max(batch_date, ord) FILTER (batch_date IS NOT NULL), '%Y-%m-%d') AS batch_date,
           coalesce(arg_max(client, ord) FILTER (client <> ''), '') AS client,
           coalesce(arg_max(location, ord) FILTER (location <> ''), '') AS location,
           coalesce(arg_max(tech, ord) FILTER (tech <> ''), '') AS tech,
           {sql_ts("CASE WHEN bool_and(late) THEN TIMESTAMP '2024-06-02 12:00:00' ELSE TIMESTAMP '2024-06-01 12:00:00' END")} AS first_seen_at,
           {sql_ts("CASE WHEN bool_or(late) THEN TIMESTAMP '2024-06-02 12:00:00' ELSE TIMESTAMP '2024-06-01 12:00:00' END")} AS last_seen_at
    FROM good GROUP BY ALL
    """,
)
def promote_batches(t):
    shreds = staged(t)[0].filter("is_valid").withColumn(
        "event_time", F.coalesce("event_time", F.lit(RUN_2).cast("timestamp"))
    )
    early = F.col("event_time") < F.lit(SPLIT).cast("timestamp")
    one = gold.upsert_batches(empty(t, schemas.BATCH), shreds.filter(early), RUN_1)
    two = gold.upsert_batches(one, shreds.filter(~early), RUN_2)
    return two.withColumns(
        {
            "batch_date": F.date_format("batch_date", "yyyy-MM-dd"),
            "first_seen_at": ts_text("first_seen_at"),
            "last_seen_at": ts_text("last_seen_at"),
        }
    )


# --- decisions ---------------------------------------------------------------------

SQL_VERDICT = """
    CASE WHEN r > 1 OR s > 1 THEN 'AMBIGUOUS' WHEN r = 1 AND s = 1 THEN 'MATCH' ELSE 'NO_MATCH' END
"""
SQL_REASON = """
    CASE WHEN r > 1 OR s > 1 THEN r || ' removals and ' || s || ' shreds share this serial'
         WHEN r = 1 AND s = 1 THEN 'one removal paired with one shred'
         WHEN r = 1 THEN 'removed, no shred on record' WHEN s = 1 THEN 'shredded, no removal on record'
         ELSE 'no events on record' END
"""
SQL_CONFIDENCE = """
    (CASE WHEN r > 1 OR s > 1 THEN 0.50 WHEN r = 1 AND s = 1 THEN 1.00 ELSE 0.00 END)::DECIMAL(3,2)
"""
SQL_SIDES = """
    sides AS (SELECT serial_norm, count(*) FILTER (kind = 'REMOVED') AS r, count(*) FILTER (kind = 'SHREDDED') AS s,
                     arg_min(id, (ts, id)) FILTER (kind = 'REMOVED') AS removed_event_id,
                     arg_min(id, (ts, id)) FILTER (kind = 'SHREDDED') AS shredded_event_id
              FROM ev GROUP BY ALL)
"""


def decisions(t, mode="frozen"):
    return matching.decide(drives(t), drive_events(t), RUN_1)


@query(
    "match_decisions",
    f"""
    WITH {SQL_EVENTS}, {SQL_SIDES}
    SELECT sha256(serial_norm || chr(1) || 'strict_serial_v1') AS decision_id, serial_norm, removed_event_id, shredded_event_id,
           {SQL_VERDICT} AS decision, 'strict_serial_v1' AS rule_version, {SQL_CONFIDENCE} AS confidence, {SQL_REASON} AS reason
    FROM sides
    """,
)
def match_decisions(t):
    return decisions(t).drop("decided_at")


def two_passes(t, mode: str):
    """Decide on the events before a date, then again on all of them."""
    events = drive_events(t)
    seen = all_events(t)
    cut = F.lit(SPLIT).cast("timestamp")
    early_drives = seen.filter(F.col("event_time") < cut).select("serial_norm").distinct()
    # Serials carry their day, so an early drive's later partner is made by time of day.
    early = events.filter((F.col("event_time") < cut) & (F.hour("event_time") < 12))
    past = matching.decide(early_drives, early, RUN_1)
    now = matching.decide(drives(t), events, RUN_2, past, mode)
    return past.unionByName(now) if mode == "frozen" else now


SQL_TWO_PASSES = f"""
    {SQL_EVENTS}, {SQL_SIDES},
    first_pass AS (SELECT serial_norm, count(*) FILTER (kind = 'REMOVED' AND hour(ts) < 12) AS r,
                     count(*) FILTER (kind = 'SHREDDED' AND hour(ts) < 12) AS s,
                     arg_min(id, (ts, id)) FILTER (kind = 'REMOVED' AND hour(ts) < 12) AS removed_event_id,
                     arg_min(id, (ts, id)) FILTER (kind = 'SHREDDED' AND hour(ts) < 12) AS shredded_event_id
              FROM ev WHERE ts < DATE '{SPLIT}' GROUP BY ALL)
"""


@query(
    "match_frozen",
    f"""
    WITH {SQL_TWO_PASSES},
    both_passes AS (SELECT *, 1 AS pass FROM first_pass UNION ALL SELECT *, 2 FROM sides ANTI JOIN first_pass USING (serial_norm))
    SELECT serial_norm, removed_event_id, shredded_event_id, {SQL_VERDICT} AS decision, {SQL_REASON} AS reason,
           '2024-06-0' || pass || ' 12:00:00.000000' AS decided_at FROM both_passes
    """,
)
def match_frozen(t):
    return two_passes(t, "frozen").select(
        "serial_norm", "removed_event_id", "shredded_event_id", "decision", "reason",
        ts_text("decided_at").alias("decided_at"),
    )


@query(
    "match_recompute",
    f"""
    WITH {SQL_TWO_PASSES}
    SELECT serial_norm, n.removed_event_id, n.shredded_event_id, n.decision, n.reason,
           '2024-06-0' || CASE WHEN p.reason = n.reason AND p.removed_event_id IS NOT DISTINCT FROM n.removed_event_id
                AND p.shredded_event_id IS NOT DISTINCT FROM n.shredded_event_id THEN 1 ELSE 2 END || ' 12:00:00.000000' AS decided_at
    FROM (SELECT *, {SQL_VERDICT} AS decision, {SQL_REASON} AS reason FROM sides) n
    LEFT JOIN (SELECT *, {SQL_REASON} AS reason FROM first_pass) p USING (serial_norm)
    """,
)
def match_recompute(t):
    return two_passes(t, "recompute").select(
        "serial_norm", "removed_event_id", "shredded_event_id", "decision", "reason",
        ts_text("decided_at").alias("decided_at"),
    )


# --- views ---------------------------------------------------------------------------

SQL_LIFECYCLE = f"""
    SELECT serial_norm, {sql_ts("min(ts) FILTER (kind = 'REMOVED')")} AS removal_time,
           {sql_ts("min(ts) FILTER (kind = 'SHREDDED')")} AS shred_time,
           max(batch_id) FILTER (kind = 'SHREDDED') AS batch_id, max(client) FILTER (kind IS NOT NULL) AS client
    FROM ev GROUP BY ALL
"""


@query("v_drive_lifecycle", f"WITH {SQL_EVENTS} {SQL_LIFECYCLE}")
def v_drive_lifecycle(t):
    return reports.ordered(reports.drive_lifecycle(drives(t), drive_events(t)), "v_drive_lifecycle").withColumns(
        {c: ts_text(c) for c in ["removal_time", "shred_time"]}
    )


@query(
    "v_unmatched_removals",
    f"""
    WITH {SQL_EVENTS}, {SQL_SIDES}
    SELECT id AS event_id, ev.serial_norm, {sql_ts("ts")} AS removal_time, computer_serial, client, notes
    FROM ev JOIN sides ON sides.removed_event_id = ev.id WHERE kind = 'REMOVED' AND {SQL_VERDICT} = 'NO_MATCH'
    """,
)
def v_unmatched_removals(t):
    view = reports.unmatched_removals(drive_events(t), decisions(t))
    return reports.ordered(view, "v_unmatched_removals").withColumn("removal_time", ts_text("removal_time"))


@query(
    "v_unmatched_shreds",
    f"""
    WITH {SQL_EVENTS}, {SQL_SIDES}
    SELECT id AS event_id, ev.serial_norm, {sql_ts("ts")} AS shred_time, batch_id, client
    FROM ev JOIN sides ON sides.shredded_event_id = ev.id WHERE kind = 'SHREDDED' AND {SQL_VERDICT} = 'NO_MATCH'
    """,
)
def v_unmatched_shreds(t):
    view = reports.unmatched_shreds(drive_events(t), decisions(t))
    return reports.ordered(view, "v_unmatched_shreds").withColumn("shred_time", ts_text("shred_time"))


@query(
    "v_ambiguous_matches",
    f"""
    WITH {SQL_EVENTS}, {SQL_SIDES}
    SELECT sha256(serial_norm || chr(1) || 'strict_serial_v1') AS decision_id, serial_norm, {SQL_CONFIDENCE} AS confidence,
           {SQL_REASON} AS reason, '2024-06-01 12:00:00.000000' AS decided_at
    FROM sides WHERE r > 1 OR s > 1
    """,
)
def v_ambiguous_matches(t):
    view = reports.ambiguous_matches(decisions(t))
    return reports.ordered(view, "v_ambiguous_matches").withColumn("decided_at", ts_text("decided_at"))


@query(
    "drive_report",
    f"""
    WITH {SQL_EVENTS}, {SQL_SIDES}
    SELECT l.*, {SQL_VERDICT} AS decision, {SQL_CONFIDENCE} AS confidence, {SQL_REASON} AS reason
    FROM ({SQL_LIFECYCLE}) l JOIN sides USING (serial_norm)
    """,
)
def drive_report(t):
    """Lifecycle of every drive beside its decision."""
    life = reports.drive_lifecycle(drives(t), drive_events(t)).withColumns(
        {c: ts_text(c) for c in ["removal_time", "shred_time"]}
    )
    verdicts = decisions(t).select("serial_norm", "decision", "confidence", "reason")
    return life.join(verdicts, "serial_norm")


@query(
    "pipeline_counts",
    f"""
    WITH {SQL_PROMOTED}
    SELECT 'bronze' AS name, count(*) AS rows FROM rows
    UNION ALL SELECT 'stg_shred', count(*) FROM rows WHERE kind = 'shred_log'
    UNION ALL SELECT 'stg_removal', count(*) FROM rows WHERE kind = 'removal_log'
    UNION ALL SELECT 'drives', count(*) FROM sides
    UNION ALL SELECT 'batches', count(DISTINCT batch_id) FROM good WHERE event_type = 'SHREDDED' AND batch_id <> ''
    UNION ALL SELECT 'events', count(*) FROM good
    UNION ALL SELECT 'decisions', count(*) FROM sides
    UNION ALL SELECT 'matched', count(*) FROM sides WHERE r = 1 AND s = 1
    """,
)
def pipeline_counts(t):
    """The stored pipeline from raw rows to decisions; every table is written once."""
    ledger = Ledger(t.spark, shared_dir(t.spark, "ledger"))
    ledger.ingest(sheet_rows(t), RUN_1)
    ledger.run(RUN_1)
    tables = ledger.tables()
    matched = tables["decisions"].filter("decision = 'MATCH'")
    return reports.row_counts({**tables, "matched": matched})


@query(
    "ledger_decisions",
    f"""
    WITH {SQL_PROMOTED}
    SELECT serial_norm, {SQL_VERDICT} AS decision, {SQL_CONFIDENCE} AS confidence, {SQL_REASON} AS reason FROM sides
    """,
)
def ledger_decisions(t):
    """Raw spreadsheet rows all the way to decisions."""
    p = promoted(t)
    return matching.decide(p.drives, p.new_events, RUN_1).select("serial_norm", "decision", "confidence", "reason")
