"""Pair imports, link resolution, drive and asset upserts, bundle loads, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custody import schemas
from custody.operators import audit, bundles, links, reports
from custody.plans.read_model import AssetReadModel
from custody.plans.tracker import Tracker
from custody.session import shared_dir, spread
from custody.sources.documents import packed_documents
from custody.sources.pairs import all_pairs, file_pairs, pasted_pairs
from custody.sources.rows import csv_rows, sheet_sources, sheet_values
from custody.workload.adapters import RUN_1, RUN_2
from custody.workload.machines import BUNDLE, SQL_MACHINE, SQL_STORAGE, TREE, documents, machines
from custody.workload.registry import query, sql_ts, ts_text

CUT = "1998-01-01"


def empty(t, schema: str):
    return t.spark.createDataFrame([], schema)


# --- sources ---------------------------------------------------------------------

@query(
    "sheet_values_rows",
    """
    SELECT 'sheet' || o_orderkey AS source_sheet_id, 'T' AS source_tab, 3 + n AS row_number,
           CASE n WHEN 0 THEN o_orderpriority WHEN 1 THEN 'only' ELSE '' END AS a,
           CASE n WHEN 0 THEN o_orderstatus ELSE '' END AS b
    FROM orders, (VALUES (0), (1), (2)) v(n)
    """,
)
def sheet_values_rows(t):
    """One value grid per order: a full, a short and an empty row; the full one is too long."""
    grids = t.orders.select(
        F.concat(F.lit("sheet"), F.col("o_orderkey").cast("string")).alias("sheet_id"),
        F.lit("T").alias("tab"), F.lit(2).alias("header_row"),
        F.array(
            F.array(F.lit("A"), F.lit("B"), F.lit("A")),
            F.array(F.lit("lost"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("cut")),
            F.array(F.lit("lost"), F.lit(""), F.lit("only")).cast("array<string>"),
            F.array().cast("array<string>"),
        ).alias("values"),
    )
    rows = sheet_values(grids)
    return rows.select(
        "source_sheet_id", "source_tab", "row_number",
        F.col("payload")["A"].alias("a"), F.col("payload")["B"].alias("b"),
    )


@query(
    "sheet_fan_in",
    """
    WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'removals' ELSE 'shreds' END AS name FROM orders)
    SELECT name AS entry, CASE name WHEN 'removals' THEN 'S1' ELSE 'S2' END AS sheet, (CASE name WHEN 'removals' THEN 3 ELSE 2 END + n)::BIGINT AS row_number,
           CASE n WHEN 0 THEN o_orderpriority ELSE 'only' END AS a, CASE n WHEN 0 THEN o_orderkey::VARCHAR ELSE '' END AS b
    FROM o, (VALUES (0), (1)) v(n) WHERE o_orderkey % 10 <> 0
    UNION ALL SELECT name, 'rejected', NULL, CASE o_orderkey % 20 WHEN 0 THEN 'broken JSON' ELSE 'no values' END, NULL FROM o WHERE o_orderkey % 10 = 0
    UNION ALL VALUES ('half', 'skipped', NULL, 'incomplete entry', NULL), ('nowhere', 'skipped', NULL, 'AnalysisException', NULL)
    """,
)
def sheet_fan_in(t):
    """Two sources of packed exports, one per order and some of them unreadable, beside two that can't be read at all."""
    root = shared_dir(t.spark, "sheets")
    k = F.col("o_orderkey")
    grid = F.array(
        F.array(F.lit("A"), F.lit("B")), F.array(F.col("o_orderpriority"), k.cast("string")), F.array(F.lit("only")),
    )
    line = F.when(k % 20 == 0, '{"values": [["A"').when(k % 10 == 0, '{"values": null}').otherwise(F.to_json(F.struct(grid.alias("values"))))
    name = F.when(F.col("o_orderstatus") == "F", "removals").otherwise("shreds")
    t.orders.select(line.alias("value"), name.alias("name")).write.partitionBy("name").text(root)
    loaded = sheet_sources(t.spark, [
        {"name": "removals", "sheet_id": "S1", "tab": "T", "path": f"{root}/name=removals", "header_row": 2, "packed": True},
        {"name": "half", "sheet_id": "S3", "path": root},
        {"name": "shreds", "sheet_id": "S2", "tab": "T", "path": f"{root}/name=shreds", "packed": True},
        {"name": "nowhere", "sheet_id": "S4", "tab": "T", "path": f"{root}/missing"},
    ])
    layout = "entry STRING, sheet STRING, row_number BIGINT, a STRING, b STRING"
    none = F.lit(None).cast("string")
    rows = loaded.rows.select(
        F.col("source_name").alias("entry"), F.col("source_sheet_id").alias("sheet"), "row_number",
        F.col("payload")["A"].alias("a"), F.col("payload")["B"].alias("b"),
    )
    rejected = loaded.rejected.select("source_name", F.lit("rejected"), F.lit(None).cast("bigint"), "error", none)
    skipped = t.spark.createDataFrame([(n, "skipped", None, why, None) for n, why in loaded.skipped], layout)
    return rows.union(rejected).union(skipped)


@query(
    "csv_source",
    """
    SELECT 'csv_customers' AS source_sheet_id, 'data' AS source_tab, c_custkey::VARCHAR AS k, c_name AS name,
           CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'says "hi", ' || c_mktsegment END AS remark FROM customer
    """,
)
def csv_source(t):
    """Customers written as CSV into the shared folder and read back as sheet rows."""
    path = shared_dir(t.spark, "csv")
    remark = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit('says "hi", '), F.col("c_mktsegment"))).otherwise("")
    cells = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), remark.alias("remark"))
    # two exports with their columns in different order
    for folder, order, part in [("even", ["k", "name", "remark"], "k % 2 = 0"), ("odd", ["remark", "k", "name"], "k % 2 = 1")]:
        cells.filter(part).select(*order).write.csv(f"{path}/{folder}", header=True, escape='"', emptyValue="")
    rows = csv_rows(t.spark, f"{path}/*", "customers").rows
    return rows.select(
        "source_sheet_id", "source_tab", *[F.col("payload")[c].alias(c) for c in ["k", "name", "remark"]]
    )


SQL_PASTED = """
    pasted AS (
      SELECT o_orderkey AS source, n AS row_index,
             CASE n WHEN 1 THEN 'PC' || (o_custkey % 100) WHEN 3 THEN 'PC X' || o_custkey ELSE '' END AS computer_serial,
             CASE n WHEN 1 THEN 'D' || (o_orderkey % 1000) WHEN 3 THEN 'S,1' WHEN 4 THEN 'LOST' || o_orderkey ELSE '' END AS drive_serial
      FROM orders, (VALUES (1), (3), (4)) v(n))
"""


def pasted(t):
    """A pasted text per order: comma line, blank line, tab line with extras, half a pair."""
    text = F.expr(
        "concat(' pc', o_custkey % 100, ', d', o_orderkey % 1000, '\\n  \\n', 'pc  x', o_custkey, '\\ts,1\\tmore\\n,lost', o_orderkey)"
    )
    return pasted_pairs(t.orders.select(F.col("o_orderkey").alias("source"), text.alias("text")))


@query(
    "pair_import",
    f"WITH {SQL_PASTED} SELECT *, computer_serial = '' OR drive_serial = '' AS is_error FROM pasted",
)
def pair_import(t):
    return links.normalise_pairs(pasted(t), fold_unicode=False).drop("raw_line")


@query(
    "pair_errors",
    f"WITH {SQL_PASTED} SELECT source, row_index, ',lost' || source AS raw_line FROM pasted WHERE row_index = 4 ORDER BY source, row_index LIMIT 10",
)
def pair_errors(t):
    return links.first_pair_errors(links.normalise_pairs(pasted(t), fold_unicode=False))


@query(
    "pair_files",
    """
    SELECT 'PC-' || l_suppkey AS computer_serial, CASE WHEN l_partkey % 40 = 0 THEN '' ELSE 'D, ' || l_partkey END AS drive_serial, count(*) AS n
    FROM lineitem GROUP BY ALL
    """,
)
def pair_files(t):
    """Line items written as two-column files, read back with the delimiter found per file."""
    path = shared_dir(t.spark, "pairs")
    line = F.expr(
        "concat('pc-', l_suppkey, ',\"', CASE WHEN l_partkey % 40 = 0 THEN '' ELSE concat('d, ', l_partkey) END, '\",extra')"
    )
    t.lineitem.select(line.alias("value")).write.text(path)
    pairs = links.normalise_pairs(file_pairs(t.spark, path), fold_unicode=False)
    return pairs.groupBy("computer_serial", "drive_serial").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pair_union",
    f"WITH {SQL_PASTED} SELECT computer_serial, drive_serial, 2 * count(*) AS seen FROM pasted WHERE computer_serial <> '' AND drive_serial <> '' GROUP BY ALL",
)
def pair_union(t):
    """Two lists with the same pairs: repeats are kept and counted."""
    both = all_pairs(pasted(t), pasted(t))
    return links.pair_counts(links.normalise_pairs(both, fold_unicode=False))


# --- links -----------------------------------------------------------------------

SQL_IMPORTS = f"""
    pairs AS (SELECT 'PC' || l_suppkey AS computer_serial, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE 'D' || l_partkey END AS drive_serial,
                     l_shipdate >= DATE '{CUT}' AS late FROM lineitem),
    links AS (SELECT computer_serial, drive_serial, count(*) AS seen_count, bool_or(late) AS late, bool_and(late) AS only_late
              FROM pairs WHERE drive_serial <> '' GROUP BY ALL)
"""


def item_pairs(t):
    raw = t.lineitem.select(
        F.lit("list").alias("source"), F.col("l_linenumber").cast("bigint").alias("row_index"), F.lit("").alias("raw_line"),
        F.concat(F.lit(" pc"), F.col("l_suppkey").cast("string")).alias("computer_serial"),
        F.when(F.col("l_partkey") % 50 == 0, "").otherwise(F.concat(F.lit("d"), F.col("l_partkey").cast("string"))).alias("drive_serial"),
        (F.col("l_shipdate") >= F.lit(CUT).cast("timestamp_ntz")).alias("late"),
    )
    return links.normalise_pairs(raw, fold_unicode=False)


def stored_links(t, both: bool = True):
    pairs = item_pairs(t)
    one = links.upsert_links(empty(t, schemas.LINK), links.pair_counts(pairs.filter("NOT late")), "one", RUN_1)
    if not both:
        return one
    return links.upsert_links(one, links.pair_counts(pairs.filter("late")), "two", RUN_2)


@query(
    "link_upsert",
    f"""
    WITH {SQL_IMPORTS}
    SELECT computer_serial, drive_serial, seen_count, CASE WHEN late THEN 'two' ELSE 'one' END AS last_batch,
           '2024-06-0' || CASE WHEN only_late THEN 2 ELSE 1 END || ' 12:00:00.000000' AS first_seen_at,
           '2024-06-0' || CASE WHEN late THEN 2 ELSE 1 END || ' 12:00:00.000000' AS last_seen_at
    FROM links
    """,
)
def link_upsert(t):
    return stored_links(t).select(
        "computer_serial", "drive_serial", "seen_count", "last_batch",
        ts_text("first_seen_at").alias("first_seen_at"), ts_text("last_seen_at").alias("last_seen_at"),
    )


@query(
    "import_statistics",
    f"""
    WITH {SQL_IMPORTS}, now AS (SELECT * FROM pairs WHERE late)
    SELECT 'two' AS batch_id, (SELECT count(*) FROM now) AS total_rows, (SELECT count(*) FROM links WHERE only_late) AS imported_rows,
           (SELECT count(*) FROM now WHERE drive_serial <> '') - (SELECT count(*) FROM links WHERE only_late) AS duplicate_rows,
           (SELECT count(*) FROM now WHERE drive_serial = '') AS error_rows
    """,
)
def import_statistics(t):
    now = item_pairs(t).filter("late")
    stats = links.import_statistics(now, links.pair_counts(now), stored_links(t, both=False))
    return links.import_record(stats, "two", RUN_2, "ida").select(
        "batch_id", "total_rows", "imported_rows", "duplicate_rows", "error_rows"
    )


SQL_RESOLVE = f"""
    {SQL_IMPORTS},
    assets AS (SELECT 'A' || s_suppkey AS asset_tag, 'PC' || s_suppkey AS cs, 1 AS age FROM supplier WHERE s_suppkey % 3 <> 0
               UNION ALL SELECT 'N' || s_suppkey, 'PC' || s_suppkey, 2 FROM supplier WHERE s_suppkey % 5 = 0),
    newest AS (SELECT cs, arg_max(asset_tag, (age, asset_tag)) AS asset_tag FROM assets GROUP BY cs),
    drives AS (SELECT DISTINCT 'A' || l_suppkey AS asset_tag, 'D' || l_partkey AS serial, CASE l_partkey % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'wiped' ELSE 'removed' END AS status
               FROM lineitem WHERE l_partkey % 2 = 0),
    resolved AS (SELECT asset_tag, computer_serial, drive_serial FROM links JOIN newest ON cs = computer_serial),
    after AS (SELECT asset_tag, coalesce(d.serial, r.drive_serial) AS serial,
                     CASE WHEN r.drive_serial IS NULL THEN d.status WHEN d.serial IS NULL OR d.status = 'present' THEN 'removed_before_scan' ELSE d.status END AS status,
                     CASE WHEN d.serial IS NULL THEN 'spreadsheet' ELSE 'lshw' END AS source,
                     r.drive_serial IS NOT NULL AND (d.serial IS NULL OR d.status = 'present') AS moved
              FROM drives d FULL JOIN resolved r USING (asset_tag) WHERE false)
"""


def tracker_state(t):
    tag, serial = F.col("s_suppkey").cast("string"), F.col("s_suppkey")
    old = t.supplier.filter(serial % 3 != 0).select(
        F.concat(F.lit("A"), tag).alias("asset_tag"), F.lit(RUN_1).cast("timestamp").alias("created_at"),
        F.concat(F.lit(" pc"), tag).alias("computer_serial"),
    )
    new = t.supplier.filter(serial % 5 == 0).select(
        F.concat(F.lit("N"), tag).alias("asset_tag"), F.lit(RUN_2).cast("timestamp").alias("created_at"),
        F.concat(F.lit("PC"), tag, F.lit("  ")).alias("computer_serial"),
    )
    part = F.col("l_partkey")
    drives = (
        t.lineitem.filter(part % 2 == 0)
        .select(
            F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("asset_tag"),
            F.concat(F.lit("D"), part.cast("string")).alias("serial"),
            F.when(part % 3 == 0, "present").when(part % 3 == 1, "wiped").otherwise("removed").alias("status"),
        )
        .distinct()
        .select(
            "asset_tag", "serial", F.lit("").alias("logicalname"), F.lit(None).cast("bigint").alias("capacity_bytes"),
            F.lit("").alias("model"), F.lit("lshw").alias("source"), "status", F.lit("").alias("status_note"),
            F.lit(None).cast("string").alias("status_by"), F.lit(RUN_1).cast("timestamp").alias("status_at"),
        )
    )
    return old.unionByName(new), drives


def resolution(t):
    assets, drives = tracker_state(t)
    stored = stored_links(t)
    resolved = links.resolvable(stored, links.newest_asset_per_serial(assets))
    return stored, resolved, links.resolve_drives(drives, resolved, RUN_2)


SQL_AFTER = """
    after_drives AS (
      SELECT d.asset_tag, d.serial, CASE WHEN r.drive_serial IS NOT NULL AND d.status = 'present' THEN 'removed_before_scan' ELSE d.status END AS status,
             'lshw' AS source, r.drive_serial IS NOT NULL AND d.status = 'present' AS moved
      FROM drives d LEFT JOIN resolved r ON r.asset_tag = d.asset_tag AND r.drive_serial = d.serial
      UNION ALL
      SELECT asset_tag, drive_serial, 'removed_before_scan', 'spreadsheet', true FROM resolved r
      WHERE NOT EXISTS (SELECT 1 FROM drives d WHERE d.asset_tag = r.asset_tag AND d.serial = r.drive_serial)),
    suspects AS (SELECT serial FROM after_drives GROUP BY serial HAVING count(DISTINCT asset_tag) > 1)
"""
SQL_RESOLVE = SQL_RESOLVE[: SQL_RESOLVE.index(",\n    after AS")]


@query(
    "resolve_drives",
    f"""
    WITH {SQL_RESOLVE}, {SQL_AFTER}
    SELECT asset_tag, serial, status, source, '2024-06-0' || CASE WHEN moved THEN 2 ELSE 1 END || ' 12:00:00.000000' AS status_at FROM after_drives
    """,
)
def resolve_drives(t):
    return resolution(t)[2].select("asset_tag", "serial", "status", "source", ts_text("status_at").alias("status_at"))


@query(
    "resolve_links",
    f"""
    WITH {SQL_RESOLVE}, {SQL_AFTER}
    SELECT l.computer_serial, l.drive_serial, r.asset_tag AS resolved_asset, r.asset_tag || '|' || r.drive_serial AS resolved_drive,
           r.asset_tag IS NOT NULL AND s.serial IS NOT NULL AS flagged_suspect,
           CASE WHEN r.asset_tag IS NOT NULL AND s.serial IS NOT NULL THEN '{links.SUSPECT_NOTE}' ELSE '' END AS flag_note,
           CASE WHEN r.asset_tag IS NOT NULL THEN '2024-06-02 12:00:00.000000' END AS resolved_at
    FROM links l LEFT JOIN resolved r USING (computer_serial, drive_serial) LEFT JOIN suspects s ON s.serial = l.drive_serial
    """,
)
def resolve_links(t):
    stored, resolved, after = resolution(t)
    done = links.resolve_links(stored, resolved, after, RUN_2)
    return done.select(
        "computer_serial", "drive_serial", "resolved_asset", "resolved_drive", "flagged_suspect", "flag_note",
        ts_text("resolved_at").alias("resolved_at"),
    )


@query(
    "resolution_counts",
    f"WITH {SQL_RESOLVE} SELECT count(DISTINCT asset_tag) AS resolved_assets, count(*) AS resolved_drives FROM resolved",
)
def resolution_counts(t):
    return links.resolution_counts(resolution(t)[1])


@query(
    "import_serials",
    f"WITH {SQL_IMPORTS} SELECT DISTINCT computer_serial FROM links ORDER BY 1",
)
def import_serials(t):
    return links.pair_counts(item_pairs(t)).select("computer_serial").distinct().orderBy("computer_serial")


@query(
    "suspect_serials",
    "SELECT 'D' || l_partkey AS serial FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
)
def suspect_serials(t):
    return links.suspect_serials(
        t.lineitem.select(
            F.col("l_suppkey").alias("asset_tag"), F.concat(F.lit("D"), F.col("l_partkey").cast("string")).alias("serial")
        )
    )


@query(
    "case_twins",
    """
    SELECT l_suppkey AS asset_tag, 'D' || l_partkey AS serial_norm, count(*) AS rows FROM (
      SELECT DISTINCT l_suppkey, l_partkey, l_linenumber % 2 AS c FROM lineitem) GROUP BY ALL HAVING count(*) > 1
    """,
)
def case_twins(t):
    letter = F.when(F.col("l_linenumber") % 2 == 0, "D").otherwise("d")
    drives = t.lineitem.select(
        F.col("l_suppkey").alias("asset_tag"), F.concat(letter, F.col("l_partkey").cast("string")).alias("serial")
    ).distinct()
    return links.case_twins(drives)


# --- drives and assets -----------------------------------------------------------

@query(
    "drive_upsert",
    f"""
    WITH x AS (SELECT 'A' || l_suppkey AS asset_tag, 'D' || l_partkey AS serial, l_shipdate >= DATE '{CUT}' AS late,
                      (l_shipdate, l_orderkey, l_linenumber, l_quantity) AS ord, l_quantity::BIGINT AS capacity_bytes FROM lineitem)
    SELECT asset_tag, serial, arg_max(capacity_bytes, ord) AS capacity_bytes,
           CASE WHEN bool_and(late) THEN 'present' ELSE 'wiped' END AS status FROM x GROUP BY ALL
    """,
)
def drive_upsert(t):
    """Two scans of the same drives; the first ones are wiped in between and stay wiped."""

    def scanned(late: bool):
        cut = F.lit(CUT).cast("timestamp_ntz")
        rows = t.lineitem.filter((F.col("l_shipdate") >= cut) == late)
        capacity = F.max_by(
            F.col("l_quantity").cast("bigint"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
        )
        return rows.groupBy(
            F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("asset_tag"),
            F.concat(F.lit("D"), F.col("l_partkey").cast("string")).alias("serial"),
        ).agg(capacity.alias("capacity_bytes")).withColumns(
            {"logicalname": F.lit(""), "model": F.lit(""), "source": F.lit("lshw"), "status": F.lit("present")}
        )

    first = bundles.upsert_drives(empty(t, schemas.ASSET_DRIVE), scanned(False), RUN_1)
    wiped = first.withColumn("status", F.lit("wiped"))
    return bundles.upsert_drives(wiped, scanned(True), RUN_2).select("asset_tag", "serial", "capacity_bytes", "status")


def status_events(t):
    return t.events.select(
        F.concat(F.lit("A"), (F.col("user_id") % 50).cast("string")).alias("asset_tag"),
        F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("serial"),
        F.when(F.col("event_type") == "error", "shredded").otherwise("wiped").alias("status"),
        F.col("props").alias("status_note"), F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string")).alias("user"),
        F.col("ts").cast("timestamp").alias("changed_at"), F.col("event_id").alias("change_id"),
    )


def present_drives(t):
    users = t.events.select("user_id").distinct()
    return users.select(
        F.concat(F.lit("A"), (F.col("user_id") % 50).cast("string")).alias("asset_tag"),
        F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("serial"),
        F.lit("present").alias("status"), F.lit("").alias("status_note"), F.lit(None).cast("string").alias("status_by"),
        F.lit(RUN_1).cast("timestamp").alias("status_at"),
    )


@query(
    "status_changes",
    f"""
    SELECT 'A' || (user_id % 50) AS asset_tag, 'D' || user_id AS serial,
           CASE WHEN count(*) FILTER (event_type IN ('error', 'view')) = 0 THEN 'present'
                WHEN arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('error', 'view')) = 'error' THEN 'shredded' ELSE 'wiped' END AS status,
           coalesce(arg_max(props, (ts, event_id)) FILTER (event_type IN ('error', 'view')), '') AS status_note,
           'u' || (arg_max(event_id, (ts, event_id)) FILTER (event_type IN ('error', 'view')) % 7) AS status_by
    FROM events GROUP BY user_id
    """,
)
def status_changes(t):
    kinds = t.events.filter(F.col("event_type").isin("error", "view")).select("event_id")
    changes = status_events(t).join(kinds.withColumnRenamed("event_id", "change_id"), "change_id", "left_semi")
    return audit.apply_status(present_drives(t), changes).drop("status_at")


@query(
    "audit_log",
    f"""
    SELECT 'A' || (user_id % 50) AS asset_tag, 'drive_status' AS touch_type, 'u' || (event_id % 7) AS touched_by, {sql_ts("ts")} AS touched_at,
           json_object('serial', 'D' || user_id, 'status', CASE event_type WHEN 'error' THEN 'shredded' ELSE 'wiped' END, 'status_note', props)::VARCHAR AS details
    FROM events
    """,
)
def audit_log(t):
    return audit.status_touches(status_events(t)).withColumn("touched_at", ts_text("touched_at"))


@query(
    "intake_diff",
    """
    SELECT o_orderkey AS asset_tag,
           concat_ws('; ', CASE WHEN o_orderstatus <> 'F' THEN 'status=F' END, CASE WHEN o_orderkey % 4 = 0 THEN 'location=' END,
                     CASE WHEN o_orderkey % 6 = 0 THEN 'device_type=laptop' END) AS changes
    FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 4 = 0 OR o_orderkey % 6 = 0
    """,
)
def intake_diff(t):
    k = F.col("o_orderkey")
    old = t.orders.select(
        k.alias("asset_tag"), F.col("o_orderstatus").alias("status"),
        F.when(k % 4 == 0, F.lit("hall")).alias("location"), F.lit("").alias("device_type"),
    )
    new = t.orders.select(
        k.alias("asset_tag"), F.lit("F").alias("status"), F.lit(None).cast("string").alias("location"),
        F.when(k % 6 == 0, F.lit("laptop")).otherwise("").alias("device_type"),
    )
    diff = audit.intake_diff(old, new, ["status", "location", "device_type"])
    pairs = F.transform(F.map_entries("updated_fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return diff.select("asset_tag", F.array_join(pairs, "; ").alias("changes"))


@query(
    "intake_updates",
    """
    SELECT o_orderkey AS asset_tag, 'status=' || 'S' || (o_orderkey % 3) AS changes FROM orders WHERE o_orderstatus <> 'S' || (o_orderkey % 3)
    """,
)
def intake_updates(t):
    """Two updates of each asset: the later one counts, once."""
    k = F.col("o_orderkey")
    old = t.orders.select(k.alias("asset_tag"), F.col("o_orderstatus").alias("status"))
    first = t.orders.select(k.alias("asset_tag"), F.lit("Z").alias("status"), F.lit(1).alias("changed_at"))
    last = t.orders.select(k.alias("asset_tag"), F.concat(F.lit("S"), k % 3).alias("status"), F.lit(2).alias("changed_at"))
    diff = audit.intake_diff(old, last.unionByName(first), ["status"])
    return diff.select("asset_tag", F.concat(F.lit("status="), F.col("updated_fields")["status"]).alias("changes"))


@query(
    "pair_import_flow",
    f"""
    WITH {SQL_RESOLVE}
    SELECT (SELECT count(*) FROM pairs) AS total_rows, (SELECT count(*) FROM links) AS imported_rows,
           (SELECT sum(seen_count) - count(*) FROM links)::BIGINT AS duplicate_rows,
           (SELECT count(*) FROM pairs WHERE drive_serial = '') AS error_rows,
           (SELECT count(DISTINCT asset_tag) FROM resolved) AS resolved_assets, (SELECT count(*) FROM resolved) AS resolved_drives,
           (SELECT count(*) FROM links) AS links, (SELECT sum(seen_count) FROM links)::BIGINT AS seen, 1 AS imports
    """,
)
def pair_import_flow(t):
    """A file and a pasted list imported against stored assets, twice under one batch id.

    Half of the serials are written in full-width letters, which normalise to plain ones.
    """
    tracker = Tracker(t.spark, shared_dir(t.spark, "import"))
    assets, drives = tracker_state(t)
    tracker.store.replace("assets", empty(t, schemas.ASSET).unionByName(assets, allowMissingColumns=True))
    tracker.store.replace("asset_drives", drives)
    raw = t.lineitem.select(
        F.when(F.col("l_linenumber") % 2 == 0, "file").otherwise("paste").alias("source"),
        F.col("l_linenumber").cast("bigint").alias("row_index"), F.lit("").alias("raw_line"),
        F.concat(F.when(F.col("l_orderkey") % 2 == 0, " \uff30\uff43").otherwise(" pc"), F.col("l_suppkey").cast("string")).alias("computer_serial"),
        F.when(F.col("l_partkey") % 50 == 0, "").otherwise(F.concat(F.lit("d"), F.col("l_partkey").cast("string"))).alias("drive_serial"),
    )
    both = all_pairs(raw.filter("source = 'file'"), raw.filter("source = 'paste'"))
    first = tracker.import_pairs(both, "one", RUN_1, "ida")
    tracker.import_pairs(both, "one", RUN_1, "ida")
    stored = tracker.links().agg(F.count(F.lit(1)).alias("links"), F.sum("seen_count").alias("seen"))
    imports = tracker.store.log("imports").agg(F.count(F.lit(1)).cast("int").alias("imports"))
    return links.side_by_side(first, stored, imports)


# --- bundle loads -----------------------------------------------------------------

SQL_BUNDLES = """
    docs AS (SELECT doc_id, source AS asset_tag, lpad(doc_id::VARCHAR, 10, '0') || '.json' AS file_name, sha256(text) AS h,
                    CASE doc_id % 10 WHEN 0 THEN 'asset_mismatch' WHEN 1 THEN 'blank' WHEN 2 THEN 'bad_json' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'bad_file_name' END AS fault
             FROM documents),
    stored AS (SELECT DISTINCT asset_tag, h FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)),
"""


def document_bundles(t):
    """Documents as bundles; the source is the asset, faults go by the document id."""
    fault = F.col("doc_id") % 10
    tag = F.when(fault == 0, "other").when(fault == 1, "").otherwise(F.col("source"))
    body = F.to_json(
        F.struct(F.struct(tag.alias("asset_id")).alias("intake"), F.col("text").alias("body"))
    )
    return spread(t.documents).select(
        "doc_id",
        F.when(fault != 4, F.col("source")).alias("asset_tag"),
        F.concat(F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit(".json")).alias("file_name"),
        F.when(fault == 2, F.concat(body, F.lit("}"))).when(fault == 3, F.lit("[1]")).otherwise(body).alias("raw"),
    )


def stored_scans(t):
    """Hashes of the documents with labels, as they look without a fault."""
    both = [F.col("source").alias("asset_tag")]
    clean = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    frames = []
    for tag in [F.col("source"), F.lit("")]:
        raw = F.to_json(F.struct(F.struct(tag.alias("asset_id")).alias("intake"), F.col("text").alias("body")))
        frames.append(clean.select(*both, bundles.bundle_hash(raw).alias("bundle_hash")))
    return frames[0].unionByName(frames[1])


def _outcomes_sql(blank_error: str) -> str:
    return f"""
    marked AS (SELECT *, CASE WHEN fault = 'blank' THEN {blank_error} ELSE fault END AS error,
                      h || CASE WHEN fault = 'blank' THEN 'b' ELSE '' END AS hb FROM docs),
    good AS (SELECT *, row_number() OVER (PARTITION BY asset_tag, hb ORDER BY file_name) AS rn,
                    (asset_tag, h) IN (SELECT (asset_tag, h) FROM stored) AS known FROM marked WHERE error IS NULL),
    outcomes AS (
      SELECT file_name, CASE WHEN error <> 'bad_file_name' THEN asset_tag END AS asset_tag, 'failed' AS outcome, error FROM marked WHERE error IS NOT NULL
      UNION ALL SELECT file_name, asset_tag, CASE WHEN rn = 1 AND NOT known THEN 'created' ELSE 'duplicate' END, NULL FROM good)
    """


@query(
    "bundle_ingest",
    f"WITH {SQL_BUNDLES} {_outcomes_sql('NULL')} SELECT * FROM outcomes",
)
def bundle_ingest(t):
    """Single uploads: a blank asset id passes."""
    done = bundles.classify(document_bundles(t), stored_scans(t))
    return done.select("file_name", "asset_tag", "outcome", "error")


@query(
    "bulk_ingest",
    f"""
    WITH {SQL_BUNDLES} {_outcomes_sql("'asset_mismatch'")},
    tags AS (SELECT asset_tag, count(*) AS n FROM outcomes WHERE outcome <> 'failed' GROUP BY 1)
    SELECT (SELECT count(*) FROM outcomes) AS total,
           (SELECT count(*) FROM tags WHERE asset_tag NOT IN (SELECT DISTINCT source FROM documents WHERE lang = 'xx')) AS created_assets,
           (SELECT sum(n)::BIGINT - count(*) FROM tags) AS updated_assets,
           (SELECT count(*) FROM outcomes WHERE outcome = 'created') AS created_scans,
           (SELECT count(*) FROM outcomes WHERE outcome = 'duplicate') AS duplicates,
           (SELECT count(*) FROM outcomes WHERE outcome = 'failed') AS failed
    """,
)
def bulk_ingest(t):
    """Bulk upload totals on an empty asset table: a blank asset id fails."""
    done = bundles.classify(document_bundles(t), stored_scans(t), bulk=True)
    return bundles.bulk_summary(done, empty(t, schemas.ASSET))


@query(
    "bundle_load",
    f"""
    WITH {SQL_BUNDLES.replace("WHERE doc_id IN (SELECT doc_id FROM labels)", "WHERE false")} {_outcomes_sql("'asset_mismatch'")}
    SELECT 'assets' AS name, count(DISTINCT asset_tag) AS n FROM outcomes WHERE outcome <> 'failed'
    UNION ALL SELECT unnest(['scans', 'touches']), (SELECT count(*) FROM outcomes WHERE outcome = 'created')
    UNION ALL SELECT 'accepted again', count(*) FROM outcomes WHERE outcome <> 'failed'
    """,
)
def bundle_load(t):
    """Stored rows after a bulk load that is made twice, the second time with all documents listed twice."""
    tracker = Tracker(t.spark, shared_dir(t.spark, "load"))
    found = document_bundles(t)
    tracker.load_bundles(found, RUN_1, "ida", note="Bulk upload")
    again = tracker.load_bundles(found.union(found), RUN_2, "ida", note="Bulk upload")
    tables = {"assets": tracker.assets(), "scans": tracker.scans(), "touches": tracker.store.log("touches")}
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    twice = again.filter("outcome = 'duplicate'").select("file_name").distinct()
    counts.append(twice.agg(F.lit("accepted again").alias("name"), F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, counts)


SQL_LOADED = f"""
    {SQL_MACHINE},
    s AS (SELECT k, kk, n4, 'A' || o_custkey AS tag, o_orderdate + to_microseconds(k % 1000000) AS made, k % 2 AS odd, {SQL_STORAGE} AS storage, mem,
                 CASE WHEN k % 5 <> 0 THEN 'SYS' || kk WHEN k % 10 <> 0 THEN 'UUID-' || kk WHEN k % 20 <> 0 THEN 'BUS' || kk ELSE 'BRG' || kk END AS cs FROM m),
    a AS (SELECT tag, coalesce(arg_min(k, made) FILTER (odd = 0), arg_min(k, made) FILTER (odd = 1)) AS k FROM s GROUP BY tag),
    asset AS (SELECT a.tag, a.k, cs, odd AS second FROM a JOIN s USING (k)),
    pair AS (SELECT k, cs, CASE WHEN k % 6 = 0 THEN 'D' || kk || '-1' ELSE 'X' || k END AS ds FROM s WHERE k % 3 = 0),
    held AS (SELECT pair.*, asset.tag FROM pair LEFT JOIN asset USING (k)),
    scanned AS (SELECT tag, serial, min(logicalname) AS logicalname, min(size_bytes) AS size_bytes, min(model) AS model FROM disk JOIN s USING (k) GROUP BY 1, 2)
"""


@query(
    "bundle_rows",
    f"""
    WITH {SQL_LOADED}
    SELECT 'asset' AS kind, tag AS a, cs AS b, 'ida' AS c, '2024-06-0' || (1 + second) AS d FROM asset
    UNION ALL SELECT 'scan', tag, cs, coalesce(storage, '-'), '2024-06-0' || (1 + odd) || ' ' || {sql_ts("made")} FROM s
    UNION ALL SELECT 'drive', tag, coalesce(scanned.serial, ds), CASE WHEN ds IS NULL THEN 'present' ELSE 'removed_before_scan' END,
           CASE WHEN scanned.serial IS NULL THEN 'spreadsheet//-/' ELSE 'lshw/' || logicalname || '/' || coalesce(size_bytes::VARCHAR, '-') || '/' || model END
      FROM scanned FULL JOIN (SELECT tag, ds AS serial, ds FROM held WHERE tag IS NOT NULL) r USING (tag, serial)
    UNION ALL SELECT 'link', cs, ds, coalesce(tag, '-'), '1' FROM held
    UNION ALL SELECT 'touch', s.tag, 'ida', s.cs, s.n4 || '/' || CASE WHEN asset.k % 3 = 0 AND (odd = 1 OR second = 0) THEN 1 ELSE 0 END FROM s JOIN asset USING (tag)
    UNION ALL SELECT 'outcome', CASE odd WHEN 1 THEN 'created' ELSE 'duplicate' END, count(*)::VARCHAR, '', '' FROM s GROUP BY 2
    """,
)
def bundle_rows(t):
    """Packed scan documents with their trees, loaded twice over pairs known before: every stored row.

    The first load holds the documents of even orders, the second one all of them.
    """
    root = shared_dir(t.spark, "rows")
    k = F.col("scan_id")
    made = F.concat(F.lit("."), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit('Z","scanner"'))
    docs = documents(t).select(
        F.concat("asset_tag", F.lit(".json")).alias("file_name"), F.replace("raw", F.lit('Z","scanner"'), made).alias("raw"), (k % 2).alias("odd"),
    )
    docs.write.partitionBy("odd").parquet(f"{root}/packed")
    tracker = Tracker(t.spark, f"{root}/tracker")
    found = machines(t).select(F.col("o_orderkey").alias("k"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("kk")).where("k % 3 = 0")
    raw = found.select(
        F.lit("paste").alias("source"), F.col("k").cast("bigint").alias("row_index"), F.lit("").alias("raw_line"),
        F.expr("CASE WHEN k % 5 <> 0 THEN 'sys' WHEN k % 10 <> 0 THEN 'uuid-' WHEN k % 20 <> 0 THEN 'bus' ELSE 'brg' END || kk").alias("computer_serial"),
        F.expr("CASE WHEN k % 6 = 0 THEN 'd' || kk || '-1' ELSE 'x' || k END").alias("drive_serial"),
    )
    tracker.import_pairs(raw, "before", RUN_1, "ida")
    tracker.load_bundles(packed_documents(t.spark, f"{root}/packed/odd=0"), RUN_1, "ida")
    second = tracker.load_bundles(packed_documents(t.spark, f"{root}/packed/*"), RUN_2, "ida")

    def rows(kind, df, *cols):
        text = [F.coalesce(c.cast("string"), F.lit("-")) for c in cols]
        return df.select(F.lit(kind).alias("kind"), *[c.alias(n) for c, n in zip(text, "abcd")])

    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    c, told = F.col, lambda name: F.get_json_object("details", f"$.{name}")
    traits = F.concat_ws("/", "source", "logicalname", F.coalesce(c("capacity_bytes").cast("string"), F.lit("-")), "model")
    parts = [
        rows("asset", tracker.assets(), c("asset_tag"), c("computer_serial"), c("created_by"), day("created_at")),
        rows("scan", tracker.scans(), c("asset_tag"), c("device_serial"), c("summary.storage"), F.concat_ws(" ", day("scanned_at"), ts_text("generated_at"))),
        rows("drive", tracker.drives(), c("asset_tag"), c("serial"), c("status"), traits),
        rows("link", tracker.links(), c("computer_serial"), c("drive_serial"), c("resolved_asset"), c("seen_count")),
        rows("touch", tracker.store.log("touches"), c("asset_tag"), c("touched_by"), told("device_serial"),
             F.concat_ws("/", told("drive_count"), told("resolved_removed_before_scan"))),
        rows("outcome", reports.count_by(second, "outcome"), c("outcome"), c("rows"), F.lit(""), F.lit("")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "bulk_errors",
    f"WITH {SQL_BUNDLES} {_outcomes_sql(chr(39) + 'asset_mismatch' + chr(39))} SELECT file_name, asset_tag, error FROM outcomes WHERE outcome = 'failed' ORDER BY file_name LIMIT 5",
)
def bulk_errors(t):
    done = bundles.classify(document_bundles(t), stored_scans(t), bulk=True)
    return bundles.first_errors(done)


@query(
    "scan_drives",
    f"""
    WITH {SQL_MACHINE}
    SELECT 'A' || o_custkey AS asset_tag, serial, arg_max(logicalname, (o_orderdate, disk.k)) AS logicalname,
           arg_max(coalesce(size_bytes, -1), (o_orderdate, disk.k)) AS capacity_bytes, arg_max(model, (o_orderdate, disk.k)) AS model
    FROM disk JOIN m USING (k) GROUP BY ALL
    """,
)
def scan_drives(t):
    """Latest description of every drive found in the machines' scans."""
    docs = bundles.parsed(documents(t))
    facts = bundles.with_facts(docs.withColumns({"generated_at": bundles.envelope()["generated_at"]}))
    drives = bundles.scan_drives(facts, ["generated_at", "scan_id"])
    return drives.select(
        "asset_tag", "serial", "logicalname", F.coalesce("capacity_bytes", F.lit(-1)).alias("capacity_bytes"), "model"
    )


# --- the asset read model ------------------------------------------------------------

# Every seventh order is an older scan: the tree itself, without an envelope.
OLDER = 7

SQL_DETAILS = f"""
    {SQL_MACHINE},
    facts AS (SELECT k, CASE WHEN k % 5 <> 0 THEN 'SYS' || kk WHEN k % 10 <> 0 THEN 'UUID-' || kk WHEN k % 20 <> 0 THEN 'BUS' || kk ELSE 'BRG' || kk END AS device_serial,
                     CASE WHEN k % 2 = 0 THEN 'CPU B' || (k % 17) ELSE 'CV CPU A' || (k % 17) END AS cpu_info, mem AS memory_total_bytes,
                     CASE WHEN k % 2 = 1 THEN 'Wireless AC ' || (k % 5) ELSE '—' END AS wifi
              FROM m),
    newest AS (SELECT o_custkey, arg_max(k, (o_orderdate, kk)) AS k FROM m GROUP BY 1),
    found AS (SELECT o_custkey, count(DISTINCT serial) AS n FROM disk JOIN m USING (k) GROUP BY 1),
    audit AS (SELECT user_id % 50 AS o_custkey, -epoch_us(ts) AS age,
                     json_object('serial', 'D' || user_id, 'status', CASE event_type WHEN 'error' THEN 'shredded' ELSE 'wiped' END, 'status_note', props)::VARCHAR AS details
              FROM events),
    last_audit AS (SELECT o_custkey, least(count(*), 50) AS n, arg_min(details, (age, details)) AS details FROM audit GROUP BY 1)
"""


def machine_scans(t):
    """Orders as stored scans; the older ones hold the tree alone."""
    k = F.col("o_orderkey")
    older = k % OLDER == 0
    return machines(t).select(
        F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("asset_tag"),
        F.lpad(k.cast("string"), 12, "0").alias("bundle_hash"),
        F.col("o_orderdate").cast("timestamp").alias("scanned_at"),
        F.col("o_orderdate").cast("timestamp").alias("generated_at"),
        F.when(older, F.expr(TREE)).otherwise(F.expr(BUNDLE)).alias("raw"),
        k.alias("k"),
    )


@query(
    "asset_details",
    f"""
    WITH {SQL_DETAILS}
    SELECT 'A' || c.c_custkey AS asset_tag, 'PC-' || c.c_custkey AS computer_serial, device_serial, cpu_info, memory_total_bytes, wifi,
           coalesce(found.n, 0) AS display_drives, coalesce(found.n, 0) > 0 AS hard_drive_present,
           coalesce(last_audit.n, 0) AS touches, last_audit.details AS newest_touch
    FROM customer c LEFT JOIN newest ON newest.o_custkey = c.c_custkey LEFT JOIN facts USING (k)
    LEFT JOIN found ON found.o_custkey = c.c_custkey LEFT JOIN last_audit ON last_audit.o_custkey = c.c_custkey
    """,
)
def asset_details(t):
    """Customers as assets, refreshed in two parts of which the second is repeated."""
    model = AssetReadModel(t.spark, shared_dir(t.spark, "details"), buckets=8)
    scans = machine_scans(t)
    found = bundles.scan_drives(
        bundles.with_facts(bundles.parsed(documents(t)).withColumns({"generated_at": bundles.envelope()["generated_at"]})),
        ["generated_at", "scan_id"],
    )
    drives = model.store.stage("drives", found)
    tag = F.concat(F.lit("A"), F.col("c_custkey").cast("string"))
    assets = t.customer.select(
        tag.alias("asset_tag"), F.lit(RUN_1).cast("timestamp").alias("created_at"), F.lit("ida").alias("created_by"),
        F.concat(F.lit("PC-"), F.col("c_custkey").cast("string")).alias("computer_serial"),
        *[F.lit("").alias(c) for c in audit.INTAKE_FIELDS],
    )
    touches = audit.status_touches(status_events(t)).join(assets.select("asset_tag"), "asset_tag", "left_semi")
    early = F.col("touched_at") < "2024-01-16"
    model.refresh(assets=assets, scans=scans.where(F.col("k") % 2 == 0), touches=touches.where(early))
    for _ in range(2):
        model.refresh(scans=scans.where(F.col("k") % 2 == 1), drives=(assets, drives), touches=touches.where(~early))
    return model.read().select(
        "asset_tag", "computer_serial", "device_serial", "cpu_info", "memory_total_bytes", F.col("card.wifi_model").alias("wifi"),
        "display_drives", "hard_drive_present", F.coalesce(F.size("touches"), F.lit(0)).cast("bigint").alias("touches"),
        F.col("touches")[0]["details"].alias("newest_touch"),
    )
