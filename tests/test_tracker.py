"""Bundle loads, pair imports, resolution, status changes over stored tables."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from custody.operators import bundles, links, quality
from custody.plans.tracker import Tracker
from custody.sources.documents import bundle_documents
from custody.sources.pairs import file_pairs, pasted_pairs
from tests.conftest import RUN_1, RUN_2

SCHEMA_ID = "intake.scan_bundle.v1"


def bundle(tag, serial="MACHINE-1", disks=("DISK-0001",), **over):
    doc = {
        "schema": SCHEMA_ID, "generated_at": "2024-05-01T10:00:00Z",
        "scanner": {"hostname": "h", "user": "u"},
        "intake": {"asset_id": tag, "tech_name": "Ida"},
        "sources": {"lshw": {"class": "system", "serial": serial, "children": [
            {"class": "disk", "serial": s, "logicalname": f"/dev/sd{i}", "size": 1000 + i, "product": "P"}
            for i, s in enumerate(disks)
        ]}},
        "meta": {"status": {}},
    }
    doc.update(over)
    return doc


def write(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, body in files.items():
        data = body if isinstance(body, bytes) else (body if isinstance(body, str) else json.dumps(body)).encode()
        (folder / name).write_bytes(data)
    return str(folder)


def outcomes(df):
    return {r.file_name: (r.outcome, r.error) for r in df.collect()}


@pytest.fixture()
def tracker(spark, tmp_path):
    return Tracker(spark, str(tmp_path / "tracker"), schema_id=SCHEMA_ID)


def pairs_of(spark, text):
    return pasted_pairs(spark.createDataFrame([("paste", text)], "source STRING, text STRING"))


def test_bulk_load(spark, tracker, tmp_path):
    path = write(tmp_path / "one", {
        "A1.json": bundle("A1", disks=("DISK-0001", "DISK-0002", "none")),
        "A2.json": bundle("A2", serial="unknown"),
        "A3.json": bundle("OTHER"),
        "A4.json": bundle(""),
        "A5.json": "{not json",
        "A6.json": "[1]",
        "bad name.json": bundle("A7"),
    })
    got = outcomes(tracker.load_bundles(bundle_documents(spark, path), RUN_1, "ida"))
    assert got == {
        "A1.json": ("created", None), "A2.json": ("created", None),
        "A3.json": ("failed", "asset_mismatch"), "A4.json": ("failed", "asset_mismatch"),
        "A5.json": ("failed", "bad_json"), "A6.json": ("failed", "not_an_object"),
        "bad name.json": ("failed", "bad_file_name"),
    }
    assets = {r.asset_tag: r for r in tracker.assets().collect()}
    assert set(assets) == {"A1", "A2"}
    assert (assets["A1"].computer_serial, assets["A2"].computer_serial) == ("MACHINE-1", None)
    drives = {(r.asset_tag, r.serial): r for r in tracker.drives().collect()}
    assert len(drives) == 4 and drives["A1", "DISK-0002"].status == "present"
    scan = tracker.scans().filter("asset_tag = 'A1'").first()
    assert (scan.tech_name, scan.device_serial, str(scan.generated_at)) == ("Ida", "MACHINE-1", "2024-05-01 10:00:00")

    reordered = json.dumps(dict(reversed(list(bundle("A1", disks=("DISK-0001", "DISK-0002", "none")).items()))), indent=2)
    again = write(tmp_path / "two", {"A1.json": reordered, "A2.json": bundle("A2", disks=("DISK-0009",))})
    got = outcomes(tracker.load_bundles(bundle_documents(spark, again), RUN_2, "per"))
    assert got == {"A1.json": ("duplicate", None), "A2.json": ("created", None)}
    a2 = tracker.assets().filter("asset_tag = 'A2'").first()
    assert (a2.computer_serial, a2.created_at, a2.created_by) == ("MACHINE-1", RUN_1, "ida")
    details = [json.loads(r.details) for r in tracker.store.log("touches").collect()]
    assert len(details) == 3 and {d["drive_count"] for d in details} == {3, 1}


def test_bulk_summary_counts_like_a_file_by_file_load(spark):
    rows = [("A", "created"), ("A", "duplicate"), ("A", "failed"), ("B", "created"), ("C", "failed"), (None, "failed")]
    df = spark.createDataFrame(rows, "asset_tag STRING, outcome STRING")
    before = spark.createDataFrame([("B",)], "asset_tag STRING")
    row = bundles.bulk_summary(df, before).first()
    assert tuple(row) == (6, 1, 2, 2, 1, 3)


def test_single_upload_checks_the_contract(spark, tracker, tmp_path):
    no_status = bundle("A1")
    del no_status["meta"]
    path = write(tmp_path / "s", {
        "A1.json": no_status, "A2.json": bundle("A2", schema="other"), "A3.json": b'{"a":"\xff"}',
        "A4.json": bundle("A4", sources={"lshw": None}),
    })
    got = outcomes(tracker.load_bundles(bundle_documents(spark, path), RUN_1, "ida", bulk=False))
    assert got == {
        "A1.json": ("failed", "no_status"), "A2.json": ("failed", "bad_schema"),
        "A3.json": ("failed", "not_utf8"), "A4.json": ("created", None),
    }


def test_deep_trees_are_flattened_whole(spark, tmp_path):
    tracker = Tracker(spark, str(tmp_path / "deep"))
    node = {"class": "disk", "serial": "DEEP-0001"}
    for _ in range(12):
        node = {"children": [node]}
    doc = bundle("A1", sources={"lshw": node})
    tracker.load_bundles(bundle_documents(spark, write(tmp_path / "d", {"A1.json": doc})), RUN_1, "ida")
    assert [r.serial for r in tracker.drives().collect()] == ["DEEP-0001"]
    shown = tracker.asset_details().select("display_drives", F.size("disks").alias("n"), F.size("touches").alias("t")).first()
    assert (shown.display_drives, shown.n, shown.t) == (1, 1, 1)


def test_equal_documents_in_two_folders_store_one_scan(spark, tracker, tmp_path):
    for folder in ("x", "y"):
        write(tmp_path / "twice" / folder, {"A1.json": bundle("A1")})
    found = bundle_documents(spark, str(tmp_path / "twice" / "*"))
    out = tracker.load_bundles(found, RUN_1, "ida").select("outcome").collect()
    assert sorted(r.outcome for r in out) == ["created", "duplicate"]
    assert tracker.scans().count() == 1 and tracker.store.log("touches").count() == 1
    again = tracker.load_bundles(found.union(found), RUN_1, "ida")
    assert {r.outcome for r in again.collect()} == {"duplicate"}
    assert sorted(r.outcome for r in out) == ["created", "duplicate"]


def test_stopped_loads_and_imports_can_be_repeated(spark, tracker, tmp_path, monkeypatch):
    path = write(tmp_path / "r", {"A1.json": bundle("A1")})
    real = tracker.store.append

    def stopped(name, rows):
        if name == "scans":
            raise RuntimeError("lost")
        real(name, rows)

    monkeypatch.setattr(tracker.store, "append", stopped)
    with pytest.raises(RuntimeError):
        tracker.load_bundles(bundle_documents(spark, path), RUN_1, "ida")
    monkeypatch.setattr(tracker.store, "append", real)
    tracker.load_bundles(bundle_documents(spark, path), RUN_1, "ida")
    assert (tracker.scans().count(), tracker.store.log("touches").count(), tracker.drives().count()) == (1, 1, len(tracker.drives().collect()))
    for _ in range(2):
        tracker.import_pairs(pairs_of(spark, "machine-9,disk-0009"), "b9", RUN_1, "ida")
    assert [(r.seen_count, r.last_batch) for r in tracker.links().filter("drive_serial = 'DISK-0009'").collect()] == [(1, "b9")]
    assert tracker.store.log("imports").filter("batch_id = 'b9'").count() == 1


def test_an_import_stopped_before_its_record_reports_what_it_found(spark, tracker, monkeypatch):
    """Stopped after its links, another import in between, then repeated: same counts, nothing counted twice."""
    text = "m1,d1\nm1,d2\nm1,d2\nm2,"
    real = tracker.store.append

    def stopped(name, rows):
        if name == "imports_applied" and rows.filter("batch_id = 'one'").count():
            raise RuntimeError("lost")
        real(name, rows)

    monkeypatch.setattr(tracker.store, "append", stopped)
    with pytest.raises(RuntimeError):
        tracker.import_pairs(pairs_of(spark, text), "one", RUN_1, "ida")
    monkeypatch.setattr(tracker.store, "append", real)
    tracker.import_pairs(pairs_of(spark, "m1,d1\nm1,d2"), "two", RUN_1, "ida")
    for _ in range(2):
        stats = tracker.import_pairs(pairs_of(spark, text), "one", RUN_2, "ida").first()
        assert (stats.total_rows, stats.imported_rows, stats.duplicate_rows, stats.error_rows) == (4, 2, 1, 1)
    assert {r.drive_serial: r.seen_count for r in tracker.links().collect()} == {"D1": 2, "D2": 3}
    records = {r.batch_id: (r.imported_rows, r.duplicate_rows) for r in tracker.store.log("imports").collect()}
    assert records == {"one": (2, 1), "two": (0, 2)}


def test_audit_rows_are_told_apart_by_all_columns(spark, tracker):
    touch = "asset_tag STRING, touch_type STRING, touched_by STRING, touched_at TIMESTAMP, details STRING"
    rows = spark.createDataFrame([("A", "view", "", RUN_1, "{}"), ("A", "view", None, RUN_1, "{}"), ("A", "view", "", RUN_2, "{}")], touch)
    for _ in range(2):
        tracker._log(rows)
    assert tracker.store.log("touches").count() == 3


def test_two_intake_updates_of_one_asset_give_one_row(spark, tracker, tmp_path):
    tracker.load_bundles(bundle_documents(spark, write(tmp_path / "i", {"A1.json": bundle("A1")})), RUN_1, "ida")
    updates = spark.createDataFrame([("A1", "sold", "2024-01-02"), ("A1", "kept", "2024-01-01")], "asset_tag STRING, status STRING, changed_at STRING")
    tracker.change_intake(updates, RUN_1, "ida")
    assert [r.status for r in tracker.assets().collect()] == ["sold"]


def test_single_uploads_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        Tracker(spark, str(tmp_path / "n")).load_bundles(None, RUN_1, "ida", bulk=False)


def test_pairs_resolve_before_and_after_the_scan(spark, tracker, tmp_path):
    text = "machine-1,disk-0001\nMACHINE-1\tDISK-0007\textra\n\nmachine-1,disk-0007\nlonely,\ncomputer_serial,drive_serial"
    stats = tracker.import_pairs(pairs_of(spark, text), "b1", RUN_1, "ida").first()
    assert (stats.total_rows, stats.imported_rows, stats.duplicate_rows, stats.error_rows) == (5, 3, 1, 1)
    assert (stats.resolved_assets, stats.resolved_drives) == (0, 0)

    path = write(tmp_path / "scan", {"A1.json": bundle("A1"), "A2.json": bundle("A2", serial="MACHINE-2", disks=("DISK-0007",))})
    tracker.load_bundles(bundle_documents(spark, path), RUN_1, "ida")
    drives = {(r.asset_tag, r.serial): (r.status, r.source) for r in tracker.drives().collect()}
    assert drives == {
        ("A1", "DISK-0001"): ("removed_before_scan", "lshw"),
        ("A1", "DISK-0007"): ("removed_before_scan", "spreadsheet"),
        ("A2", "DISK-0007"): ("present", "lshw"),
    }
    found = {r.drive_serial: r for r in tracker.links().collect()}
    assert found["DISK-0007"].flagged_suspect and found["DISK-0007"].flag_note == links.SUSPECT_NOTE
    assert found["DISK-0007"].seen_count == 2 and found["DISK-0007"].resolved_asset == "A1"
    assert not found["DISK-0001"].flagged_suspect and found["DRIVE_SERIAL"].resolved_asset is None

    later = RUN_2 + timedelta(days=1)
    change = [("A1", "DISK-0001", "wiped", "done", "per", RUN_2, 1), ("A1", "DISK-0001", "shredded", "gone", "ida", RUN_2, 2),
              ("ZZ", "NOPE", "wiped", "", "per", RUN_2, 3)]
    tracker.change_status(spark.createDataFrame(
        change, "asset_tag STRING, serial STRING, status STRING, status_note STRING, user STRING, changed_at TIMESTAMP, change_id INT"))
    stats = tracker.import_pairs(pairs_of(spark, "machine-1,disk-0001"), "b2", later, "ida").first()
    assert (stats.imported_rows, stats.duplicate_rows, stats.resolved_assets, stats.resolved_drives) == (0, 1, 1, 3 - 1)
    d = tracker.drives().filter("asset_tag = 'A1' AND serial = 'DISK-0001'").first()
    assert (d.status, d.status_note, d.status_by, d.status_at) == ("shredded", "gone", "ida", RUN_2)
    again = {r.drive_serial: r for r in tracker.links().collect()}
    assert (again["DISK-0001"].last_batch, again["DISK-0001"].seen_count) == ("b2", 2)
    assert again["DISK-0007"].flag_note == links.SUSPECT_NOTE
    kinds = [r.touch_type for r in tracker.store.log("touches").collect()]
    assert sorted(kinds) == ["drive_status", "drive_status", "scan_upload", "scan_upload"]

    tracker.change_intake(
        spark.createDataFrame([("A1", "ready", ""), ("A2", "", "")], "asset_tag STRING, status STRING, location STRING")
        .withColumns({c: F.lit("") for c in ["device_type", "cosmetic_grade", "cosmetic_notes"]}), later, "ida",
    )
    last = tracker.store.log("touches").filter("touch_type = 'intake_update'").collect()
    assert [(r.asset_tag, json.loads(r.details)) for r in last] == [("A1", {"updated_fields": {"status": "ready"}})]

    tables = {"assets": tracker.assets(), "asset_drives": tracker.drives(), "links": tracker.links(),
              "scans": tracker.scans(), "touches": tracker.store.log("touches")}
    assert {r.violations for r in quality.violations(tables).collect()} == {0}
    audited = {r.check: r.violations for r in quality.audit(tables).collect()}
    assert set(audited.values()) == {0} and audited.keys() > {r.check for r in quality.violations(tables).collect()}

    row = {r.asset_tag: r for r in tracker.asset_details().collect()}
    assert row["A1"].hard_drive_present and row["A1"].display_drives == 2
    assert row["A1"].spec_line == "" and row["A1"].hw.cpu_model == "—"
    assert [d.serial for d in row["A2"].disks] == ["DISK-0007"]


def test_newest_asset_takes_the_links(spark):
    assets = spark.createDataFrame(
        [("OLD", RUN_1, " pc-1"), ("NEW", RUN_2, "PC-1 "), ("NONE", RUN_2, None)],
        "asset_tag STRING, created_at TIMESTAMP, computer_serial STRING",
    )
    assert [tuple(r) for r in links.newest_asset_per_serial(assets).collect()] == [("PC-1", "NEW")]


def test_pair_files(spark, tmp_path):
    write(tmp_path / "p", {
        "a.csv": b"\xef\xbb\xbfpc-1,\"d,1\",x\n\npc-2\n",
        "b.tsv": "pc-3\td 3, left\npc-4\t\n",
        "c.txt": "one\n",
    })
    got = sorted(
        (r.source.rsplit("/", 1)[1], r.row_index, r.computer_serial, r.drive_serial)
        for r in file_pairs(spark, str(tmp_path / "p")).collect()
    )
    assert got == [
        ("a.csv", 1, "pc-1", "d,1"), ("a.csv", 3, "pc-2", ""), ("b.tsv", 1, "pc-3", "d 3, left"),
        ("b.tsv", 2, "pc-4", ""), ("c.txt", 1, "one", ""),
    ]
    skipped = file_pairs(spark, str(tmp_path / "p"), skip_header=True)
    assert skipped.count() == 2


def test_hot_pair_counts_once_per_key(spark):
    raw = spark.range(30000).select(
        F.lit("s").alias("source"), F.col("id").alias("row_index"), F.lit("").alias("raw_line"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("pc"), F.col("id") % 100)).alias("computer_serial"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("drive_serial"),
    )
    counted = links.pair_counts(links.normalise_pairs(raw))
    assert counted.filter("computer_serial = 'HOT'").first().seen == 10000 and counted.count() == 20001


def test_audit_counts_keys_codes_and_references(spark):
    assets = spark.createDataFrame([("A", "ready"), ("A", "bad"), ("A", None), (None, ""), (None, "")], "asset_tag STRING, status STRING").withColumns({c: F.lit("") for c in ["device_type", "cosmetic_grade"]})
    touches = spark.createDataFrame([("A", "view"), ("B", "view"), ("B", "odd"), (None, "note")], "asset_tag STRING, touch_type STRING")
    want = {
        "assets: unique asset_tag": 2, "assets: accepted status": 2, "assets: accepted device_type": 0, "assets: accepted cosmetic_grade": 0,
        "touches: accepted touch_type": 1, "touches: asset_tag in assets": 2,
    }
    assert {r.check: r.violations for r in quality.audit({"assets": assets, "touches": touches}).collect()} == want
    empty = {"assets": assets.limit(0), "touches": touches.limit(0)}
    assert {r.check: r.violations for r in quality.audit(empty).collect()} == dict.fromkeys(want, 0)
