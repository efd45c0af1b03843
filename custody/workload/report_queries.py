"""Counts, latest rows, top-k lists, search and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from custody.operators import inventory, merge, quality, reports
from custody.plans.search_index import SearchIndex
from custody.session import shared_dir
from custody.workload.adapters import SQL_EVENTS, drive_events, drives
from custody.workload.registry import query, sql_ts, ts_text


@query(
    "duplicate_hashes",
    "SELECT sha256(text) AS bundle_hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_hashes(t):
    return reports.duplicate_hashes(t.documents.select(F.sha2("text", 256).alias("bundle_hash")))


@query("status_counts", "SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY 1")
def status_counts(t):
    return reports.count_by(t.orders, "o_orderstatus")


@query(
    "scans_per_asset",
    "SELECT c_custkey, count(o_orderkey) AS scans FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def scans_per_asset(t):
    scans = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return reports.children_per_parent(t.customer.select("c_custkey"), scans, "c_custkey", "scans")


@query(
    "latest_scan_per_asset",
    f"""
    SELECT o_custkey, o_orderkey, o_orderstatus, {sql_ts("o_orderdate")} AS scanned_at FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    WHERE rn = 1
    """,
)
def latest_scan_per_asset(t):
    newest = reports.latest_per(
        t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"),
        "o_custkey", ["o_orderdate", "o_orderkey"],
    )
    return newest.withColumn("scanned_at", ts_text("o_orderdate")).drop("o_orderdate")


@query(
    "recent_assets",
    """
    SELECT c_custkey, c_name, count(o_orderkey) AS scans FROM
      (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20) LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY ALL
    """,
)
def recent_assets(t):
    """Twenty newest assets with their scan counts; scans are counted for those twenty only."""
    top = reports.newest(
        t.customer.select("c_custkey", "c_name", "c_acctbal"), 20, [F.desc("c_acctbal"), F.desc("c_custkey")]
    ).select("c_custkey", "c_name")
    scans = t.orders.select(F.col("o_custkey").alias("c_custkey")).join(top.select("c_custkey"), "c_custkey", "left_semi")
    return reports.children_per_parent(top, scans, "c_custkey", "scans")


@query(
    "recent_touches",
    f"SELECT event_id, {sql_ts('ts')} AS touched_at, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 50",
)
def recent_touches(t):
    mine = t.events.filter(F.col("user_id") == 7)
    top = reports.newest(mine, 50, [F.desc("ts"), F.desc("event_id")])
    return top.select("event_id", ts_text("ts").alias("touched_at"), "event_type")


@query(
    "recent_scans",
    f"""
    SELECT o_orderkey, c_name, {sql_ts('o_orderdate')} AS scanned_at FROM orders JOIN customer ON c_custkey = o_custkey
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10
    """,
)
def recent_scans(t):
    """Ten newest scans with their asset. Every scan has an asset, so the ten are picked first."""
    top = reports.newest(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), 10, [F.desc("o_orderdate"), F.desc("o_orderkey")]
    )
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return reports.with_lookup(top, names, "o_custkey").select(
        "o_orderkey", "c_name", ts_text("o_orderdate").alias("scanned_at")
    )


@query(
    "asset_list",
    """
    SELECT json_object('tag', c_custkey, 'status', c_mktsegment, 'nation', n_name)::VARCHAR AS record
    FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 100) JOIN nation ON n_nationkey = c_nationkey
    """,
)
def asset_list(t):
    top = reports.newest(t.customer, 100, [F.desc("c_acctbal"), F.desc("c_custkey")])
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = reports.with_lookup(top, nations, "c_nationkey").select(
        F.col("c_custkey").alias("tag"), F.col("c_mktsegment").alias("status"), F.col("n_name").alias("nation")
    )
    return reports.json_records(rows)


@query(
    "point_lookup",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def point_lookup(t):
    found = reports.find_by(t.orders, "o_orderpriority", " 1-URGENT ", [F.desc("o_orderkey")])
    return found.select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "facet_search",
    """
    SELECT doc_id, lang, source FROM documents
    WHERE lang IN ('en', 'de') AND (text ILIKE '%the%' OR source ILIKE '%the%') AND (text ILIKE '%src1%' OR source ILIKE '%src1%')
    """,
)
def facet_search(t):
    hits = reports.search(t.documents, {"lang": ["en", "de"]}, "the SRC1", ["text", "source"])
    return hits.select("doc_id", "lang", "source")


SQL_FOUND = """
    found AS (SELECT doc_id, lang, source FROM documents
      WHERE lang IN ('en', 'de') AND (text ILIKE '%hing%' OR source ILIKE '%hing%')
        AND (text ILIKE '%src1%' OR source ILIKE '%src1%') AND (text ILIKE '%th%' OR source ILIKE '%th%'))"""


def indexed(t):
    """Documents indexed in two batches, one of which is added again, then searched."""
    index = SearchIndex(t.spark, shared_dir(t.spark, "search"), "doc_id", ["text", "source"], buckets=8)
    docs = t.documents.select("doc_id", "lang", "source", "text")
    index.add(docs.where("doc_id % 2 = 0"), "even")
    for _ in range(2):
        index.add(docs.where("doc_id % 2 <> 0"), "odd")
    return index.search(docs, "hing SRC1 th", {"lang": ["en", "de"]}).select("doc_id", "lang", "source")


@query("indexed_search", f"WITH {SQL_FOUND} SELECT * FROM found")
def indexed_search(t):
    return indexed(t)


@query(
    "facet_counts",
    f"""
    WITH {SQL_FOUND}
    SELECT 'lang' AS facet, lang AS value, count(*) AS rows FROM found GROUP BY lang
    UNION ALL SELECT 'source', source, count(*) FROM found GROUP BY source
    UNION ALL SELECT 'labelled', CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'yes' END, count(*) FROM found GROUP BY 2
    """,
)
def facet_counts(t):
    """Counts beside the search of three facets at once; unlabelled documents are a null value."""
    labels = t.labels.select("doc_id").distinct().withColumn("labelled", F.lit("yes"))
    found = indexed(t).join(labels, "doc_id", "left")
    return reports.facet_counts(found, ["lang", "source", "labelled"])


@query(
    "date_drilldown",
    f"SELECT {sql_ts('o_month')} AS period, count(*) AS rows FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_month FROM orders) GROUP BY 1",
)
def date_drilldown(t):
    return reports.date_drilldown(t.orders, "o_orderdate").withColumn("period", ts_text("period"))


@query(
    "json_records",
    "SELECT json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_mktsegment', c_mktsegment)::VARCHAR AS record FROM customer",
)
def json_records(t):
    return reports.json_records(t.customer.select("c_custkey", "c_name", "c_mktsegment"))


@query(
    "table_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS rows FROM {n}"
        for n in ["customer", "orders", "lineitem", "events", "documents", "pages"]
    ),
)
def table_counts(t):
    names = ["customer", "orders", "lineitem", "events", "documents", "pages"]
    return reports.row_counts({n: getattr(t, n) for n in names})


@query(
    "quality_checks",
    f"""
    WITH {SQL_EVENTS}
    SELECT 'orders: unique o_orderkey' AS "check", count(*) AS violations FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
    UNION ALL SELECT 'lineitem: unique l_orderkey+l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'orders: accepted o_orderstatus', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT 'lineitem: order exists', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'documents: unique text', count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)
    """,
)
def quality_checks(t):
    hashes = t.documents.select(F.sha2("text", 256).alias("h"))
    return quality.check_counts(
        [
            ("orders: unique o_orderkey", quality.duplicate_keys(t.orders, ["o_orderkey"])),
            ("lineitem: unique l_orderkey+l_linenumber", quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])),
            ("orders: accepted o_orderstatus", quality.unaccepted(t.orders, "o_orderstatus", ["O", "F"])),
            ("lineitem: order exists", quality.orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey")),
            ("documents: unique text", quality.duplicate_keys(hashes, ["h"])),
        ]
    )


@query(
    "declared_rules",
    f"""
    WITH {SQL_EVENTS}
    SELECT 'drives: unique serial_norm' AS "check", 0 AS violations
    UNION ALL SELECT 'events: unique source_event_id+event_type', count(*) FROM (SELECT 1 FROM ev WHERE kind IS NOT NULL GROUP BY id, kind HAVING count(*) > 1)
    UNION ALL SELECT 'events: accepted event_type', count(*) FROM ev WHERE kind NOT IN ('REMOVED', 'SHREDDED')
    """,
)
def declared_rules(t):
    return quality.violations({"drives": drives(t), "events": drive_events(t)})


SQL_AUDITED = """
    a AS (SELECT CAST(o_custkey AS VARCHAR) AS tag, CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'F' THEN '' ELSE o_orderstatus END AS status,
      CASE WHEN o_orderpriority LIKE '1%' THEN 'server' ELSE '' END AS device, translate(left(o_orderpriority, 1), '12345', 'ABCDE') AS grade FROM orders),
    d AS (SELECT CAST(l_orderkey AS VARCHAR) AS tag, CAST(l_linenumber % 3 AS VARCHAR) AS serial,
      CASE l_returnflag WHEN 'R' THEN 'removed' WHEN 'A' THEN 'present' END AS status, CASE l_linestatus WHEN 'O' THEN 'lshw' ELSE 'manual' END AS source FROM lineitem),
    l AS (SELECT l_partkey, l_suppkey FROM lineitem),
    t AS (SELECT CAST(user_id AS VARCHAR) AS tag, event_type AS kind FROM events)"""


@query(
    "constraint_audit",
    f"""
    WITH {SQL_AUDITED}
    SELECT 'assets: unique asset_tag' AS "check", count(*) AS violations FROM (SELECT 1 FROM a GROUP BY tag HAVING count(*) > 1)
    UNION ALL SELECT 'assets: accepted status', count(*) FROM a WHERE status NOT IN ('', 'intake', 'testing', 'ready', 'sold', 'recycled', 'returned')
    UNION ALL SELECT 'assets: accepted device_type', count(*) FROM a WHERE device NOT IN ('', 'server')
    UNION ALL SELECT 'assets: accepted cosmetic_grade', count(*) FROM a WHERE grade NOT IN ('', 'A', 'B', 'C', 'D')
    UNION ALL SELECT 'asset_drives: unique asset_tag+serial', count(*) FROM (SELECT 1 FROM d GROUP BY tag, serial HAVING count(*) > 1)
    UNION ALL SELECT 'asset_drives: accepted status', count(*) FROM d WHERE status IS NULL
    UNION ALL SELECT 'asset_drives: accepted source', 0
    UNION ALL SELECT 'asset_drives: asset_tag in assets', count(*) FROM d WHERE tag NOT IN (SELECT tag FROM a)
    UNION ALL SELECT 'links: unique computer_serial+drive_serial', count(*) FROM (SELECT 1 FROM l GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)
    UNION ALL SELECT 'touches: accepted touch_type', count(*) FROM t WHERE kind IS NULL OR kind NOT IN ('view', 'scan_upload', 'intake_update', 'drive_status', 'note')
    UNION ALL SELECT 'touches: asset_tag in assets', count(*) FROM t WHERE tag IS NOT NULL AND tag NOT IN (SELECT tag FROM a)
    """,
)
def constraint_audit(t):
    state = F.col("o_orderstatus")
    assets = t.orders.select(
        F.col("o_custkey").cast("string").alias("asset_tag"),
        F.when(state == "O", "ready").when(state == "F", "").otherwise(state).alias("status"),
        F.when(F.col("o_orderpriority").startswith("1"), "server").otherwise("").alias("device_type"),
        F.translate(F.substring("o_orderpriority", 1, 1), "12345", "ABCDE").alias("cosmetic_grade"),
    )
    asset_drives = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("asset_tag"),
        (F.col("l_linenumber") % 3).cast("string").alias("serial"),
        F.when(F.col("l_returnflag") == "R", "removed").when(F.col("l_returnflag") == "A", "present").alias("status"),
        F.when(F.col("l_linestatus") == "O", "lshw").otherwise("manual").alias("source"),
    )
    links = t.lineitem.select(F.col("l_partkey").alias("computer_serial"), F.col("l_suppkey").alias("drive_serial"))
    touches = t.events.select(F.col("user_id").cast("string").alias("asset_tag"), F.col("event_type").alias("touch_type"))
    return quality.audit({"assets": assets, "asset_drives": asset_drives, "links": links, "touches": touches})


@query(
    "hard_drive_flags",
    """
    SELECT o_orderkey AS asset_tag, coalesce(bool_or(l_linenumber NOT IN (1, 2, 3)), false) AS hard_drive_present
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def hard_drive_flags(t):
    logical = F.expr(
        "CASE l_linenumber WHEN 1 THEN '/dev/MMCblk0' WHEN 2 THEN 'loop7' WHEN 3 THEN '/dev/sr0' ELSE '/dev/sda' END"
    )
    parts = t.lineitem.select(F.col("l_orderkey").alias("asset_tag"), logical.alias("logicalname"))
    return inventory.hard_drive_present(t.orders.select(F.col("o_orderkey").alias("asset_tag")), parts)


@query(
    "fill_if_blank",
    """
    SELECT c_custkey AS asset_tag, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE coalesce(s, '') END AS computer_serial
    FROM customer LEFT JOIN (SELECT o_custkey, min('SN' || o_orderkey) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey
    """,
)
def fill_if_blank(t):
    assets = t.customer.select(
        F.col("c_custkey").alias("asset_tag"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("").alias("computer_serial"),
    )
    found = t.orders.groupBy(F.col("o_custkey").alias("asset_tag")).agg(
        F.min(F.concat(F.lit("SN"), F.col("o_orderkey").cast("string"))).alias("computer_serial")
    )
    known = found.join(assets.select("asset_tag"), "asset_tag", "left_semi")
    return merge.upsert(assets, known, ["asset_tag"], {"computer_serial": merge.fill_blank})


@query(
    "asset_get_or_create",
    "SELECT DISTINCT o_custkey AS asset_tag FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')",
)
def asset_get_or_create(t):
    stored = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("asset_tag"))
    return merge.insert_missing(stored, t.orders.select(F.col("o_custkey").alias("asset_tag")), ["asset_tag"])
