"""Scalar functions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from custody.functions import labels, units
from custody.functions.hashing import bundle_hash, json_string, key_hash, payload_hash
from custody.functions.serials import (
    ledger_serial,
    plausible_serial,
    serial_tag,
    synthetic_serial,
    tracker_serial,
)
from custody.functions.text import (
    append_note,
    collector_status,
    file_tag,
    first_line,
    or_blank,
    preview,
    text_lines,
)
from custody.functions.times import parse_date, parse_iso, parse_timestamp
from custody.functions.variants import is_object, member, text_at
from custody.operators import tools
from custody.operators.bronze import row_key
from custody.operators.inventory import network_kind
from custody.operators.silver import dedupe_key
from custody.session import spread
from custody.sources.ordinals import scan_position, with_row_numbers
from custody.workload.registry import query, sql_ts, ts_text


@query(
    "bronze_row_keys",
    """
    SELECT c_custkey, 'csv_customer:data:' || (row_number() OVER (ORDER BY c_custkey) + 1) AS source_row_key
    FROM customer
    """,
)
def bronze_row_keys(t):
    rows = with_row_numbers(t.customer.select("c_custkey", *scan_position()), start=2)
    return rows.select(
        "c_custkey", row_key(F.lit("csv_customer"), F.lit("data"), "row_number").alias("source_row_key")
    )


@query(
    "payload_hash",
    """
    SELECT c_custkey, sha256('{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name
        || '","c_nationkey":"' || c_nationkey || '","note":'
        || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"q\\"' || c_custkey || '"' END || '}') AS payload_hash
    FROM customer
    """,
)
def payload_hashes(t):
    payload = F.create_map(
        F.lit("note"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit('q"'), F.col("c_custkey").cast("string"))),
        F.lit("c_name"), F.col("c_name"),
        F.lit("c_nationkey"), F.col("c_nationkey").cast("string"),
        F.lit("c_mktsegment"), F.col("c_mktsegment"),
    )
    return t.customer.select("c_custkey", payload_hash(payload).alias("payload_hash"))


@query(
    "event_ids",
    """
    SELECT o_orderkey, sha256('orders' || chr(1) || o_orderpriority || chr(1) || o_orderkey) AS event_id
    FROM orders
    """,
)
def event_ids(t):
    return t.orders.select(
        "o_orderkey", key_hash(F.lit("orders"), "o_orderpriority", "o_orderkey").alias("event_id")
    )


@query(
    "bundle_hash_canonical",
    """
    SELECT event_id,
           sha256('{"a":' || replace(props, ' ', '') || ',"z":' || event_id || '}') AS bundle_hash,
           sha256('{"z": ' || event_id || ',  "a": ' || props || '}') AS text_hash
    FROM events
    """,
)
def bundle_hashes(t):
    raw = F.concat(
        F.lit('{"z": '), F.col("event_id").cast("string"), F.lit(',  "a": '), F.col("props"), F.lit("}")
    )
    return t.events.select(
        "event_id", bundle_hash(raw).alias("bundle_hash"), bundle_hash(raw, "text").alias("text_hash")
    )


NOISY_NAME = """
    CASE c_custkey % 6
      WHEN 0 THEN '  ' || lower(c_name) || ' . '
      WHEN 1 THEN c_name || ';,'
      WHEN 2 THEN chr(9) || c_name || chr(10)
      WHEN 3 THEN lower(c_name) || '  x' || chr(9) || 'y  z'
      WHEN 4 THEN '...'
      ELSE c_name END
"""


@query(
    "normalize_serial",
    f"""
    SELECT c_custkey,
           regexp_replace(upper(regexp_replace({NOISY_NAME}, '^\\s+|\\s+$', '', 'g')), '[\\s.,;:]+$', '') AS serial_norm
    FROM customer
    """,
)
def normalize_serial(t):
    return t.customer.select("c_custkey", ledger_serial(F.expr(NOISY_NAME)).alias("serial_norm"))


@query(
    "norm_serial",
    f"""
    SELECT c_custkey,
           upper(regexp_replace(trim(regexp_replace({NOISY_NAME}, '[\\x00-\\x1F\\x7F]', '', 'g')), '\\s+', ' ', 'g')) AS serial_norm
    FROM customer
    """,
)
def norm_serial(t):
    return t.customer.select(
        "c_custkey", tracker_serial(F.expr(NOISY_NAME), fold_unicode=False).alias("serial_norm")
    )


@query(
    "norm_serial_text",
    # Both sides fold the whole text; it holds no character whose compatibility
    # form differs from its canonical one. DuckDB's upper() leaves the sharp s.
    """
    SELECT doc_id, sha256(upper(replace(regexp_replace(trim(regexp_replace(
               nfc_normalize(text), '[\\x00-\\x1F\\x7F]', '', 'g')), '\\s+', ' ', 'g'), 'ß', 'SS'))) AS norm_hash
    FROM documents
    """,
)
def norm_serial_text(t):
    return t.documents.select("doc_id", F.sha2(tracker_serial("text"), 256).alias("norm_hash"))


@query(
    "dedupe_key",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN l_suppkey % 5 = 0 OR l_partkey % 7 = 0 THEN ''
                ELSE 'B' || l_suppkey || '|P' || l_partkey END AS dedupe_key
    FROM lineitem
    """,
)
def dedupe_keys(t):
    batch = F.expr("CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'B' || l_suppkey END")
    serial = F.expr("CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'P' || l_partkey END")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dedupe_key(batch, serial).alias("dedupe_key")
    )


@query(
    "parse_timestamps",
    f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN {sql_ts("o_orderdate + to_seconds(o_orderkey % 86400)")} END AS parsed
    FROM orders
    """,
)
def parse_timestamps(t):
    at = F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format(at, "M/d/yyyy HH:mm:ss"))
        .when(F.col("o_orderkey") % 5 == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(F.col("o_orderkey") % 5 == 3, F.date_format(at, "yyyy-MM-dd"))
        .otherwise(F.lit("soon"))
    )
    return t.orders.select("o_orderkey", ts_text(parse_timestamp(text)).alias("parsed"))


@query(
    "parse_dates",
    """
    SELECT o_orderkey, strftime(CASE o_orderkey % 4
        WHEN 0 THEN o_orderdate
        WHEN 1 THEN o_orderdate
        WHEN 2 THEN CASE WHEN day(o_orderdate) <= 12
                         THEN make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0)
                         ELSE o_orderdate END
        END, '%Y-%m-%d') AS parsed
    FROM orders
    """,
)
def parse_dates(t):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(d, "MM/dd/yyyy"))
        .when(k == 2, F.date_format(d, "dd/MM/yyyy"))
        .otherwise(F.date_format(d, "dd.MM.yyyy"))
    )
    return t.orders.select("o_orderkey", F.date_format(parse_date(text), "yyyy-MM-dd").alias("parsed"))


@query(
    "parse_iso",
    f"""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN {sql_ts("ts")} WHEN 1 THEN {sql_ts("ts")}
        WHEN 2 THEN {sql_ts("ts - INTERVAL 2 HOUR")} END AS parsed
    FROM events
    """,
)
def parse_isos(t):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.col("event_id") % 4
    raw = (
        F.when(k == 0, text)
        .when(k == 1, F.concat(text, F.lit("Z")))
        .when(k == 2, F.concat(text, F.lit("+02:00")))
        .otherwise(F.concat(F.lit("on "), text))
    )
    return t.events.select("event_id", ts_text(parse_iso(raw)).alias("parsed"))


def _sql_ladder(x: str, units_: list[str], first: str) -> str:
    steps = [f"WHEN {x} < 1024 THEN {first}"]
    steps += [
        f"WHEN {x} < {1024 ** (i + 1)} THEN printf('%.1f {u}', {x} / {1024**i})"
        for i, u in enumerate(units_[1:-1], start=1)
    ]
    return f"CASE {' '.join(steps)} ELSE printf('%.1f {units_[-1]}', {x} / {1024**5}) END"


@query(
    "format_bytes_all",
    f"""
    WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey,
                      CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE l_quantity * pow(1024, l_orderkey % 6) / 64 END AS n
               FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN n = 0 THEN '0 B' ELSE {_sql_ladder('n', units.DECIMAL_STEPS, "printf('%.1f B', n)")} END AS bytes_text,
           CASE WHEN n <> 0 THEN {_sql_ladder('n', units.DECIMAL_STEPS, "printf('%.1f B', n)")} END AS capacity_human,
           {_sql_ladder('n', units.IEC_STEPS, "trunc(n)::BIGINT || ' B'")} AS iec_text,
           CASE WHEN n <> 0 THEN CASE WHEN abs(n / 1073741824 - round_even(n / 1073741824, 0)) < 0.01
                THEN round_even(n / 1073741824, 0)::BIGINT || ' GB'
                ELSE printf('%.1f GB', n / 1073741824) END END AS memory_human
    FROM b
    """,
)
def format_bytes_all(t):
    n = F.expr("CASE WHEN l_partkey % 50 = 0 THEN 0D ELSE l_quantity * pow(1024, l_orderkey % 6) / 64 END")
    return t.lineitem.withColumn("n", n).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        units.format_bytes("n").alias("bytes_text"),
        units.capacity_text("n").alias("capacity_human"),
        units.iec_bytes("n").alias("iec_text"),
        units.memory_text("n").alias("memory_human"),
    )


@query(
    "format_hz",
    """
    WITH p AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0
                      ELSE (p_retailprice * 100)::BIGINT * CASE WHEN p_size % 2 = 0 THEN 12345 ELSE 321 END END AS hz FROM part)
    SELECT p_partkey,
           CASE WHEN hz >= 1000000000 THEN printf('%.2f GHz', hz / 1e9) WHEN hz > 0 THEN printf('%.0f MHz', hz / 1e6) END AS clock,
           CASE WHEN hz <> 0 THEN printf('%.2f GHz', hz / 1e9) ELSE '—' END AS clock_ghz
    FROM p
    """,
)
def format_hz(t):
    hz = F.expr(
        "CASE WHEN p_size % 10 = 0 THEN 0 ELSE cast(round(p_retailprice * 100) AS BIGINT)"
        " * CASE WHEN p_size % 2 = 0 THEN 12345 ELSE 321 END END"
    )
    return t.part.withColumn("hz", hz).select(
        "p_partkey", units.clock_text("hz").alias("clock"), units.clock_text_ghz("hz").alias("clock_ghz")
    )


PART_SERIAL = """
    CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'unknown' WHEN 2 THEN ' Not Specified '
      WHEN 3 THEN 'AB' || (p_partkey % 10) WHEN 4 THEN '0000000'
      WHEN 5 THEN 'NOSERIAL-' || p_partkey ELSE p_brand || '-' || p_partkey END
"""


@query(
    "serial_tags",
    f"""
    WITH p AS (SELECT p_partkey, {PART_SERIAL} AS s FROM part)
    SELECT p_partkey,
           CASE WHEN s = '' THEN NULL WHEN s LIKE 'NOSERIAL-%' THEN '(no serial)' ELSE '(SN ' || s || ')' END AS tag,
           length(trim(s)) >= 6 AND lower(trim(s)) NOT IN ('unknown','none','n/a','na','null','0','0000000',
                '00000000','000000000','not specified') AS plausible
    FROM p
    """,
)
def serial_tags(t):
    return t.part.withColumn("s", F.expr(PART_SERIAL)).select(
        "p_partkey", serial_tag("s").alias("tag"), plausible_serial("s").alias("plausible")
    )


@query(
    "synthetic_serial",
    """
    SELECT p_partkey, 'NOSERIAL-' || substr(sha1('{"logical": "/dev/sd' || (p_partkey % 9) || '", "model": "'
        || p_name || '", "size": ' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE (p_size * 1000000)::VARCHAR END || '}'), 1, 12) AS serial
    FROM part
    """,
)
def synthetic_serials(t):
    quoted = F.concat(F.lit('"/dev/sd'), (F.col("p_partkey") % 9).cast("string"), F.lit('"'))
    size = F.when(F.col("p_size") % 5 != 0, (F.col("p_size") * 1000000).cast("string"))
    return t.part.select(
        "p_partkey",
        synthetic_serial(quoted, json_string(F.col("p_name")), F.coalesce(size, F.lit("null"))).alias("serial"),
    )


@query(
    "value_labels",
    """
    SELECT o_orderkey,
           CASE o_orderstatus WHEN 'P' THEN 'Present' WHEN 'F' THEN 'Removed Before Scan' ELSE 'gone' END AS status_label,
           CASE o_orderkey % 5 WHEN 0 THEN 'Grade A - Excellent' WHEN 1 THEN 'Grade B - Good'
                WHEN 2 THEN 'Grade C - Fair' WHEN 3 THEN 'Grade D - Poor' ELSE 'E' END AS grade_label
    FROM orders
    """,
)
def value_labels(t):
    status = F.expr("CASE o_orderstatus WHEN 'P' THEN 'present' WHEN 'F' THEN 'removed_before_scan' ELSE 'gone' END")
    grade = F.expr("substr('ABCDE', cast(o_orderkey % 5 AS INT) + 1, 1)")
    return t.orders.select(
        "o_orderkey",
        labels.label(status, labels.DRIVE_STATUS).alias("status_label"),
        labels.label(grade, labels.COSMETIC_GRADE).alias("grade_label"),
    )


@query(
    "preview_text",
    """
    SELECT conv_id, turn,
           CASE WHEN text IS NULL OR text = '' THEN '-' WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview,
           nullif(substr(regexp_extract(trim(text, E' \\t\\n\\r'), '^[^\\n]*'), 1, 140), '') AS first_line
    FROM conversations
    """,
)
def preview_text(t):
    return t.conversations.select(
        "conv_id", "turn", preview("text").alias("preview"), first_line("text").alias("first_line")
    )


@query(
    "note_append",
    """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'check it' WHEN c_custkey % 3 = 1 THEN c_name || chr(10) || 'check it'
        ELSE c_name || ' check it' END AS note
    FROM customer
    """,
)
def note_append(t):
    note = F.expr(
        "CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_name ELSE c_name || ' check it' END"
    )
    return t.customer.select("c_custkey", append_note(note, "check it").alias("note"))


@query(
    "collector_status",
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'MISSING' ELSE 'rc=' || (event_id % 4) END AS status
    FROM events
    """,
)
def collector_states(t):
    rc = F.expr("CASE event_id % 4 WHEN 1 THEN 127 ELSE event_id % 4 END")
    return t.events.select("event_id", collector_status(rc).alias("status"))


@query(
    "file_tags",
    """
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'A-' || o_orderkey WHEN 1 THEN 'b_' || o_orderkey END AS asset_tag
    FROM orders
    """,
)
def file_tags(t):
    name = F.expr(
        "CASE o_orderkey % 4 WHEN 0 THEN 'A-' || o_orderkey || '.json' WHEN 1 THEN 'b_' || o_orderkey || '.json'"
        " WHEN 2 THEN 'a b' || o_orderkey || '.json' ELSE 'A' || o_orderkey || '.JSON' END"
    )
    return t.orders.select("o_orderkey", file_tag(name).alias("asset_tag"))


@query(
    "nested_get",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k, '' AS missing, 'none' AS below_text, false AS k_is_object
    FROM events
    """,
)
def nested_get(t):
    doc = F.try_parse_json("props")
    return t.events.select(
        "event_id",
        text_at(doc, "$.k").alias("k"),
        or_blank(text_at(doc, "$.no.such.step")).alias("missing"),
        F.coalesce(text_at(doc, "$.k.deeper"), F.lit("none")).alias("below_text"),
        is_object(member(doc, "$.k")).alias("k_is_object"),
    )


@query(
    "network_kinds",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderpriority = '1-URGENT' OR o_orderkey % 5 = 3 THEN 'wireless'
        WHEN o_orderkey % 5 = 1 THEN 'ethernet' ELSE 'unknown' END AS kind
    FROM orders
    """,
)
def network_kinds(t):
    config = F.expr(
        "CASE o_orderkey % 5 WHEN 0 THEN '{\"wireless\":\"IEEE 802.11\",\"ip\":\"10.0.0.1\"}' WHEN 1 THEN '{\"ip\":\"10.0.0.2\"}'"
        " WHEN 2 THEN '{\"driver\":\"e1000\"}' WHEN 3 THEN '{\"driver\":\"iwlan7\"}' END"
    )
    said = F.expr("CASE WHEN o_orderpriority = '1-URGENT' THEN 'WiFi card' ELSE 'Ethernet interface' END")
    return t.orders.select("o_orderkey", network_kind(F.try_parse_json(config), said).alias("kind"))


UPOWER = """
    'Device: /org/line_power_AC' || chr(10) || '  vendor: none' || chr(10)
    || 'Device: /org/battery_BAT0' || chr(10)
    || '  vendor:              ' || s_name || chr(10) || '  model:  Cell ' || s_suppkey || chr(10)
    || '  present:             yes' || chr(10) || '    state:               charging' || chr(10)
    || '    energy-full:         ' || (s_suppkey % 50) || '.5 Wh' || chr(10)
    || '    energy-full-design:  60 Wh' || chr(10)
    || '    percentage:          ' || (s_suppkey % 100) || '%' || chr(10)
    || '    capacity:            9' || (s_suppkey % 10) || '.25%' || chr(10)
    || '    charge-cycles:       ' || (CASE WHEN s_suppkey % 4 = 0 THEN 'N/A' ELSE '' || s_suppkey END) || chr(10)
    || 'Device: /org/battery_BAT1' || chr(10) || '  vendor: other' || chr(10)
"""
SMART = """
    'Device Model:     ' || s_name || chr(10) || 'Serial Number:    SN' || s_suppkey || chr(10)
    || 'User Capacity:    1,' || lpad('' || s_suppkey % 1000, 3, '0') || ',000 bytes [1 MB]' || chr(10)
    || 'SMART overall-health self-assessment test result: '
    || (CASE WHEN s_suppkey % 3 = 0 THEN 'FAILED!' ELSE 'PASSED' END) || chr(10)
    || '  9 Power_On_Hours          0x0032   099   099   000    Old_age   Always       -       ' || (s_suppkey * 3) || chr(10)
    || ' 12 Power_Cycle_Count       0x0032   099   099   000    Old_age   Always       -       ' || (s_suppkey + 5) || chr(10)
    || '194 Temperature_Celsius     0x0022   060   050   000    Old_age   Always       -       ' || (20 + s_suppkey % 30) || ' (Min/Max 18/55)' || chr(10)
"""
EDID = """
    'Manufacturer: MK' || (s_suppkey % 9) || chr(10)
    || 'Alphanumeric Data String: ''PANEL-' || s_suppkey || '''' || chr(10)
    || (CASE WHEN s_suppkey % 2 = 0 THEN 'Alphanumeric Data String: ''SECOND''' || chr(10) ELSE '' END)
    || 'DTD 1:  1920x1080   59.9' || (s_suppkey % 10) || ' Hz  16:9' || chr(10)
"""


def scanned(t):
    """Suppliers as scanned machines: few narrow rows, each with costly tool texts to read."""
    return spread(t.supplier)


@query(
    "battery_fields",
    """
    SELECT s_suppkey, true AS present, 'charging' AS state, (s_suppkey % 100) || '%' AS percentage,
           (90 + s_suppkey % 10) + 0.25::DOUBLE AS capacity_pct,
           CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey END AS charge_cycles,
           (s_suppkey % 50) + 0.5::DOUBLE AS energy_full_wh, 60::DOUBLE AS energy_full_design_wh,
           s_name AS vendor, 'Cell ' || s_suppkey AS model, NULL::VARCHAR AS serial,
           'none Cell ' || s_suppkey AS card_model,
           (s_suppkey % 50) || '.5 Wh / 60 Wh (9' || (s_suppkey % 10) || '.25%)' AS card_health
    FROM supplier
    """,
)
def battery_fields(t):
    return (
        scanned(t).withColumn("text", F.expr(UPOWER))
        .withColumns({"f": tools.power_fields("text"), "c": tools.battery_card("text")})
        .select("s_suppkey", "f.*", F.col("c.model").alias("card_model"), F.col("c.health").alias("card_health"))
    )


@query(
    "smart_fields",
    """
    SELECT s_suppkey, s_name AS model, 'SN' || s_suppkey AS serial,
           1000000 + (s_suppkey % 1000) * 1000 AS capacity_bytes,
           CASE WHEN s_suppkey % 3 = 0 THEN 'FAILED!' ELSE 'PASSED' END AS overall_health,
           s_suppkey * 3 AS power_on_hours, s_suppkey + 5 AS power_cycle_count,
           20 + s_suppkey % 30 AS temperature_c, 'OK' AS hint
    FROM supplier
    """,
)
def smart_reports(t):
    return scanned(t).withColumn("text", F.expr(SMART)).withColumn("f", tools.smart_fields("text")).select(
        "s_suppkey", "f.*", tools.smart_hint("text").alias("hint")
    )


@query(
    "panel_fields",
    """
    SELECT s_suppkey, 'MK' || (s_suppkey % 9) AS manufacturer, 'PANEL-' || s_suppkey AS panel,
           'MK' || (s_suppkey % 9) || ' PANEL-' || s_suppkey AS panel_text,
           '1920×1080 @ 59.9' || (s_suppkey % 10) || ' Hz' AS native_mode,
           'PANEL-' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' / SECOND' ELSE '' END AS summary
    FROM supplier
    """,
)
def panels(t):
    return scanned(t).withColumn("f", tools.panel_fields(F.expr(EDID))).select("s_suppkey", "f.*")


@query(
    "text_lines",
    """
    SELECT doc_id, line, count(*) AS times FROM (
      SELECT doc_id, trim(unnest(string_split(text, chr(10))), E' \\t\\r') AS line FROM documents)
    WHERE line <> '' AND line NOT LIKE '%the%'
    GROUP BY ALL
    """,
)
def document_lines(t):
    lines = t.documents.select("doc_id", F.explode(text_lines("text", drop_containing="the")).alias("line"))
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("times"))
