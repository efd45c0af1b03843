"""Tree flattening and extractors on hand-made trees, both walk orders."""

import json

from pyspark.sql import functions as F

from custody.functions import variants as V
from custody.operators import bundles, inventory, tools, tree

GB = 1024**3


def flat(spark, *docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "i INT, raw STRING").select("i", F.parse_json("raw").alias("t"))
    return tree.flatten(df, "t")


def facts(spark, doc):
    return inventory.summarise(flat(spark, doc)).first()


def walk_ids(spark, doc, column):
    row = flat(spark, doc).select(F.transform(column, lambda n: n["id"]).alias("ids")).first()
    return row.ids


NESTED = {
    "id": "r", "children": [
        {"id": "a", "children": [{"id": "a0"}, {"id": "a1"}]},
        7,
        {"id": "b", "children": [{"id": "b0", "children": [{"id": "b00"}]}]},
        {"id": "c", "children": {"id": "not-a-list"}},
    ],
}


def test_both_orders(spark):
    assert walk_ids(spark, NESTED, "nodes") == ["r", "a", "a0", "a1", "b", "b0", "b00", "c"]
    assert walk_ids(spark, NESTED, "stack_nodes") == ["r", "c", "b", "b0", "b00", "a", "a1", "a0"]


def test_top_level_list_is_walked_in_document_order_only(spark):
    assert walk_ids(spark, [{"id": "x"}, {"id": "y"}], "nodes") == ["x", "y"]
    assert walk_ids(spark, [{"id": "x"}], "stack_nodes") == []
    assert walk_ids(spark, "5", "nodes") == []


def chain(n):
    doc = {"id": "end"}
    for i in range(n):
        doc = {"id": f"n{i}", "children": [doc]}
    return doc


def test_every_tree_is_unfolded_to_its_own_depth(spark):
    depths = [0, 1, 6, 65, 90]
    rows = spark.createDataFrame([(d, json.dumps(chain(d))) for d in depths] + [(-1, "[]"), (-2, None)], "d INT, raw STRING")
    got = tree.flatten(rows.withColumn("t", F.parse_json("raw")), "t").select("d", F.size("nodes").alias("n")).collect()
    assert {r.d: max(r.n, 0) for r in got} == {**{d: d + 1 for d in depths}, -1: 0, -2: 0}


def walked(doc, reverse):
    """(id, path) of every object, parents first, as plain Python finds them."""
    out, open_ = [], [([], doc)]
    while open_:
        path, node = open_.pop(0)
        if isinstance(node, dict):
            out.append((node.get("id"), path))
            kids = node.get("children")
            kids = [([*path, i], c) for i, c in enumerate(kids if isinstance(kids, list) else [])]
            open_ = (kids[::-1] if reverse else kids) + open_
    return out


def test_orders_equal_a_plain_walk_at_and_beyond_the_usual_depth(spark):
    wide = {"id": "w", "children": [{"id": str(i), "children": [3, {"id": f"{i}x"}, None, [{"id": "no"}], {"children": []}]} for i in range(12)]}
    docs = [NESTED, wide, *[chain(tree.USUAL_DEPTH + n) for n in (-1, 0, 1, 2)], {"id": "r", "children": [chain(tree.USUAL_DEPTH + 3), 5, {"id": "z"}]}]
    both = [F.transform(c, lambda n: F.struct(n["id"].alias("id"), n["path"].alias("path"))).alias(c) for c in ("nodes", "stack_nodes")]
    for r in flat(spark, *docs).select("i", *both).collect():
        assert [(n.id, n.path) for n in r.nodes] == walked(docs[r.i], False)
        assert [(n.id, n.path) for n in r.stack_nodes] == walked(docs[r.i], True)


def test_usual_trees_are_not_unfolded_level_by_level(spark, monkeypatch):
    """One cast reads them; a list of children is copied out of its parent only in deeper trees."""
    monkeypatch.setattr(V, "items_at", lambda doc, path: F.raise_error(F.lit("unfolded")).cast("array<variant>"))
    got = flat(spark, NESTED, [{"id": "x"}], chain(tree.USUAL_DEPTH)).select(F.size("nodes").alias("n")).collect()
    assert [r.n for r in got] == [8, 1, tree.USUAL_DEPTH + 1]


def test_explode_nodes(spark):
    got = tree.explode_nodes(flat(spark, NESTED), "i").select("path_text", "id", "depth").collect()
    assert ("2/0/0", "b00", 3) in [tuple(r) for r in got] and len(got) == 8


def test_device_serial_order(spark):
    def serial(doc):
        return facts(spark, doc).device_serial

    assert serial({"class": "system", "serial": "ROOT-1234", "uuid": "UUID-1234"}) == "ROOT-1234"
    assert serial({"class": "system", "serial": "none", "uuid": "UUID-1234"}) == "UUID-1234"
    assert serial({"class": "system", "serial": 12345678}) is None
    siblings = {"class": "x", "children": [{"class": "bus", "serial": "FIRST-123"}, {"class": "bridge", "serial": "LAST-1234"}]}
    assert serial(siblings) == "LAST-1234"
    assert serial({"class": "x", "children": [{"class": "disk", "serial": "DISK-1234"}]}) is None
    assert serial({}) is None


def test_memory(spark):
    one = facts(spark, {"children": [{"class": "memory", "description": "System Memory", "size": 8 * GB}]})
    assert (one.memory_total_bytes, one.hw_summary.ram, one.hw_summary.storage) == (8 * GB, "8.0 GB", None)
    slots = facts(
        spark,
        {"children": [
            {"class": "memory", "id": "cache", "description": "L1 Cache", "size": 100},
            {"class": "memory", "id": "bank:0", "slot": "A", "size": 4 * GB, "serial-number": "M0"},
            {"class": "memory", "id": "bank:1", "description": "DIMM", "size": 2 * GB},
            {"class": "BANK", "description": "empty"},
        ]},
    )
    assert [(s.slot, s.size_bytes, s.size_human, s.serial) for s in slots.memory_slots] == [
        ("empty", None, None, ""), ("bank:1", 2 * GB, "2.0 GB", ""), ("A", 4 * GB, "4.0 GB", "M0"),
    ]
    assert slots.memory_total_bytes == 6 * GB
    text = facts(spark, {"children": [{"class": "memory", "description": "RAM", "size": str(3 * GB)}]})
    assert text.memory_total_bytes == 3 * GB
    nothing = facts(spark, {"class": "system"})
    assert nothing.memory_total_bytes is None and nothing.hw_summary is None and nothing.memory_slots == []


def test_disks(spark):
    row = facts(
        spark,
        {"children": [
            {"class": "disk", "serial": " DISK-0001 ", "logicalname": "/dev/sda", "size": 256 * GB, "product": "P"},
            {"class": "disk", "serial": "n/a", "logicalname": ["/dev/a", "/dev/b"], "description": "D é", "size": 1.5},
            {"class": "volume", "serial": "VOL-00001"},
        ]},
    )
    second, first = row.disks
    assert (first.serial, first.logicalname, first.size_bytes, first.model) == ("DISK-0001", "/dev/sda", 256 * GB, "P")
    import hashlib

    blob = json.dumps({"logical": ["/dev/a", "/dev/b"], "size": 1.5, "model": "D é"}, sort_keys=True)
    assert second.serial == "NOSERIAL-" + hashlib.sha1(blob.encode()).hexdigest()[:12]
    assert (second.logicalname, second.size_bytes) == ("", 1)
    assert row.hw_summary.storage == "1.0 B D é (no serial) + 256.0 GB P (SN DISK-0001)"


def test_first_processor_in_each_order(spark):
    doc = {"children": [
        {"class": "processor", "product": "ONE", "vendor": "V", "size": 2_000_000_000, "configuration": {"cores": "4", "threads": 8}},
        {"class": "processor", "product": " "},
    ]}
    row = flat(spark, doc).select(
        inventory.cpu_text().alias("text"), inventory.processor().alias("stack"), inventory.hardware_card().alias("card")
    ).first()
    assert row.text == "V ONE" and row.stack.model is None and row.card.cpu_model == "ONE"
    assert row.card.cpu_max == "2.00 GHz" and row.card.ethernet_model == "—"


def test_network_and_multimedia(spark):
    row = facts(spark, {"children": [
        {"class": "network", "product": "N1", "configuration": {"ip": "1.2.3.4"}},
        {"class": "network", "description": "Wireless thing", "configuration": {"ip": "1.2.3.5"}},
        {"class": "network", "configuration": {"driver": "xwlanx"}},
        {"class": "multimedia", "product": "HD Webcam"}, {"class": "multimedia", "description": "Sound Audio"},
    ]})
    assert [n.type for n in row.network] == ["wireless", "wireless", "ethernet"]
    m = row.multimedia
    assert (m.webcam, m.webcam_model, m.audio, m.audio_model) == (True, "HD Webcam", True, "Sound Audio")


def test_battery(spark):
    row = facts(spark, {"children": [{"id": "battery", "product": "", "description": "Pack", "size": "500"}]})
    assert (row.battery.present, row.battery.product, row.battery.capacity_bytes) == (True, "Pack", 500)
    assert facts(spark, {"id": "x"}).battery.present is False


def test_thunderbolt_prefers_host_interface(spark):
    doc = {"children": [{"product": "Thunderbolt A"}, {"product": "Thunderbolt NHI B", "configuration": {"driver": "d"}}]}
    card = flat(spark, doc).select(inventory.hardware_card().alias("c")).first().c
    assert (card.thunderbolt_model, card.thunderbolt_driver) == ("Thunderbolt NHI B", "d")


def text_row(spark, text, fn):
    return spark.createDataFrame([(text,)], "t STRING").select(fn("t").alias("f")).first().f


def test_power_report(spark):
    text = (
        "Device: /a/line_power\n  vendor:  X\nDevice: /a/battery_BAT0\r\n  vendor:   Y \n  model:  M\n  model:  M2\n"
        "  present:   yes\n  percentage:  40%\n  capacity:  87.5%\n  charge-cycles: 12\n  energy-full:  30.1 Wh\n"
        "Device: /a/battery_BAT1\n  state: z\n"
    )
    f = text_row(spark, text, tools.power_fields)
    assert (f.vendor, f.model, f.present, f.percentage, f.capacity_pct, f.charge_cycles, f.energy_full_wh, f.state) == (
        "Y", "M2", True, "40%", 87.5, 12, 30.1, None,
    )
    assert text_row(spark, None, tools.power_fields).present is False


def test_smart_per_device(spark):
    text = (
        "===== /dev/sda =====\nDevice Model:     A\nSerial Number:    S-A\n\n"
        "===== /dev/sdb =====\nDevice Model:     B\nSMART overall-health self-assessment test result: PASSED\n"
    )
    whole = text_row(spark, text, tools.smart_fields)
    assert (whole.model, whole.serial, whole.overall_health) == ("A", "S-A", "PASSED")
    parts = text_row(spark, text, tools.smart_by_device)
    assert [(p.path, p.smart.model, p.smart.overall_health) for p in parts] == [
        ("/dev/sda", "A", None), ("/dev/sdb", "B", "PASSED"),
    ]
    lsblk = '{"blockdevices":[{"type":"disk","name":"sdb","tran":"sata"},{"type":"disk","name":"sda","tran":"sata"}]}'
    df = spark.createDataFrame([(lsblk, text)], "l STRING, t STRING").select(F.parse_json("l").alias("l"), "t")
    df = df.withColumns({"s": tools.smart_fields("t"), "p": tools.smart_by_device("t")})
    both = df.select(
        tools.enriched_disks(F.col("l"), F.col("s")).alias("shared"),
        tools.enriched_disks(F.col("l"), F.col("s"), F.col("p")).alias("own"),
    ).first()
    assert [d.model for d in both.shared] == ["A", "A"] and [d.model for d in both.own] == ["B", "A"]


def test_smart_as_object_gives_nothing(spark):
    doc = '{"sources":{"lshw":{},"smart":{"sda":"Device Model: X"}}}'
    docs = bundles.parsed(spark.createDataFrame([(doc,)], "raw STRING"))
    row = bundles.rich_summary(bundles.with_facts(docs)).first()
    assert row.drives == [] and row.spec_line == ""


def test_old_scans_hold_the_tree_itself(spark):
    docs = bundles.parsed(spark.createDataFrame([('{"id":"r","class":"system"}',), ('{"sources":{"lshw":{"id":"in"}}}',)], "raw STRING"))
    got = tree.flatten(docs, bundles.hardware_tree()).select(F.col("nodes")[0]["id"].alias("id")).collect()
    assert [r.id for r in got] == ["r", "in"]


def test_truthiness(spark):
    docs = ['{"v":0}', '{"v":""}', '{"v":"0"}', '{"v":"false"}', '{"v":false}', '{"v":[]}', '{"v":null}', "{}", '{"v":{"a":1}}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i INT, d STRING")
    got = [r.o for r in df.select("i", V.truthy(V.member(F.parse_json("d"), "$.v")).alias("o")).orderBy("i").collect()]
    assert got == [False, False, True, True, False, False, False, False, True]


def test_a_collector_value_is_computed_once(spark):
    df = spark.createDataFrame([("Device Model: x", "{}")], "t STRING, j STRING").withColumn("l", F.try_parse_json("j"))

    def named(column, word):
        return df.select(column.alias("x"))._jdf.queryExecution().analyzed().toString().count(word)

    smart = tools.smart_fields("t")
    assert named(smart, "split(") == 2  # lines, columns
    own = F.struct(F.lit(1).cast("bigint").alias("capacity_bytes"), *[F.lit("").alias(c) for c in ["model", "serial", "overall_health", "power_on_hours", "power_cycle_count", "temperature_c"]])
    assert named(tools.enriched_disks(F.col("l"), own), "try_variant_get(") < 10
