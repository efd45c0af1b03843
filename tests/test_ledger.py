"""The ledger pipeline end to end on small files with invented rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from custody.operators import bronze, silver
from custody.operators.matching import STRICT_V1
from custody.plans.ledger import Ledger
from custody.sources.rows import csv_rows, sheet_sources, sheet_values
from tests.conftest import RUN_1, RUN_2

SHREDS = """Timestamp,Batch ID,Batch Date,Client,Location,Tech,Serial Number
2024-03-01 09:00:00,LOT-1,2024-03-01,Acme,Hall A,Ida,zx-100
3/1/2024 9:05:00,LOT-1,03/01/2024,,Hall B,Ida,zx-101. ;
2024-03-01T09:10:00,LOT-2,13/02/2024,Bolt,,Per,only-shred
2024-03-02 10:00:00,LOT-2,bad date,Bolt,,Per,url-comp
2024-03-02 10:00:00,LOT-2,,,,Per,twice
2024-03-02 11:00:00,,,Bolt,,Per,twice
2024-03-02 11:30:00,LOT-3,,,,Per,...
2024-03-02 11:40:00,LOT-3,,,,Per,   
,LOT-1,,,,Per,no-time
2024-03-05 11:40:00,LOT-9
2024-03-05 11:40:00,LOT-9,,,,Per,toolong,extra,cells
"""
REMOVALS = """Timestamp,Client,Computer Serial Number,Drive Serial Number,Notes,Tech Email
2024-02-01 09:00:00,Acme,pc-1,ZX-100,"said ""ok"", fine",a@example.org
2024-02-01 09:00:00,Acme,pc-1,zx-101,,a@example.org
2024-02-02 09:00:00,Acme,pc-2,only-removed,,a@example.org
2024-02-03 09:00:00,Acme,https://pc.example/3,url-comp,,a@example.org
2024-02-04 09:00:00,Acme,pc-4,twice,,a@example.org
,Acme,pc-5,no-time,,a@example.org
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    (d / "shred.csv").write_text(SHREDS)
    (d / "removal.csv").write_text(REMOVALS)
    return d


def load(spark, ledger, files, run_ts):
    out = {}
    for name, file in [("shred_log", "shred.csv"), ("removal_log", "removal.csv")]:
        out[name] = ledger.ingest(csv_rows(spark, str(files / file), name).rows, run_ts)
    return out


@pytest.fixture(scope="module")
def done(spark, files, tmp_path_factory):
    ledger = Ledger(spark, str(tmp_path_factory.mktemp("ledger")))
    first = load(spark, ledger, files, RUN_1)
    counts = ledger.run(RUN_1)
    return ledger, first, counts


def test_ingest_is_idempotent(spark, files, done):
    ledger, first, _ = done
    assert first == {
        "shred_log": {"inserted": 10, "duplicates": 0},
        "removal_log": {"inserted": 6, "duplicates": 0},
    }
    again = load(spark, ledger, files, RUN_2)
    assert again == {
        "shred_log": {"inserted": 0, "duplicates": 10},
        "removal_log": {"inserted": 0, "duplicates": 6},
    }


def test_ragged_rows(spark, files):
    loaded = csv_rows(spark, str(files / "shred.csv"), "shred_log")
    bad = loaded.rejected.collect()
    assert [(r.row_number, r.source_sheet_id) for r in bad] == [(12, "csv_shred_log")]
    short = loaded.rows.filter("row_number = 11").first().payload
    assert short["Batch ID"] == "LOT-9" and short["Client"] is None and "Serial Number" in short
    blank = loaded.rows.filter("row_number = 3").first().payload
    assert blank["Client"] == ""


def test_quoted_cells(spark, files):
    rows = csv_rows(spark, str(files / "removal.csv"), "removal_log").rows
    assert rows.filter("row_number = 2").first().payload["Notes"] == 'said "ok", fine'


def test_row_numbers_across_splits(spark, tmp_path):
    lines = "n,text\n" + "".join(f"{i},{'x' * (i % 37)}\n" for i in range(5000))
    (tmp_path / "big.csv").write_text(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = csv_rows(spark, str(tmp_path / "big.csv"), "big").rows
        assert rows.rdd.getNumPartitions() > 1
        off = rows.filter(F.col("payload")["n"].cast("bigint") + 2 != F.col("row_number"))
        assert off.count() == 0 and rows.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_break_inside_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"one\ntwo",x\nthree,y\n')
    rows = csv_rows(spark, str(tmp_path / "q.csv"), "q", multiline=True).rows.orderBy("row_number").collect()
    assert [(r.row_number, r.payload["a"]) for r in rows] == [(2, "one\ntwo"), (3, "three")]
    by_line = csv_rows(spark, str(tmp_path / "q.csv"), "q")
    bad = by_line.rejected.orderBy("row_number").collect()
    assert [(r.row_number, r.error) for r in bad] == [(2, "open quote"), (3, "open quote")] and bad[0].path.endswith("q.csv")
    assert [r.payload["a"] for r in by_line.rows.collect()] == ["three"]


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Serial,Client\nS1,C1\n\nS2,"C, 2"\n')
    (tmp_path / "b.csv").write_text("\ufeffClient,Extra,Serial\r\nC3,e,S3\r\nC4,2.5\"\r\nC5,x,S5,more\r\n")
    for multiline in (False, True):
        load = csv_rows(spark, str(tmp_path), "x", multiline=multiline)
        got = sorted((r.payload["Serial"] or "", r.payload["Client"], r.row_number) for r in load.rows.collect())
        assert ("S1", "C1", 2) in got and ("S2", "C, 2", 3) in got and ("S3", "C3", 2) in got
        assert any("more" in r.raw_line for r in load.rejected.collect())


def test_counters(done):
    _, _, counts = done
    assert counts == {"stg_shred": 10, "stg_removal": 6, "events": 12, "decisions": 7}


def test_staging(done):
    ledger, _, _ = done
    shred = {r.serial_raw: r for r in ledger.store.log("stg_shred").collect()}
    assert shred["zx-101. ;"].serial_norm == "ZX-101"
    assert shred["zx-101. ;"].dedupe_key == "LOT-1|ZX-101"
    assert str(shred["zx-101. ;"].batch_date) == "2024-03-01"
    assert str(shred["only-shred"].batch_date) == "2024-02-13"
    assert shred["url-comp"].batch_date is None
    assert shred["..."].is_valid and shred["..."].serial_norm == ""
    assert shred["   "].validation_errors == [silver.NO_SERIAL]
    assert shred["no-time"].event_time is None
    bad = ledger.store.log("stg_removal").filter("NOT is_valid").collect()
    assert [(r.drive_serial_norm, r.validation_errors) for r in bad] == [("URL-COMP", [silver.URL_SERIAL])]


def test_decisions(done):
    ledger, _, _ = done
    got = {r.serial_norm: (r.decision, str(r.confidence)) for r in ledger.tables()["decisions"].collect()}
    assert got == {
        "ZX-100": ("MATCH", "1.00"),
        "ZX-101": ("MATCH", "1.00"),
        "NO-TIME": ("MATCH", "1.00"),
        "ONLY-SHRED": ("NO_MATCH", "0.00"),
        "ONLY-REMOVED": ("NO_MATCH", "0.00"),
        "URL-COMP": ("NO_MATCH", "0.00"),
        "TWICE": ("AMBIGUOUS", "0.50"),
    }


def test_batches_keep_last_non_blank(done):
    ledger, _, _ = done
    b = {r.batch_id: r for r in ledger.tables()["batches"].collect()}
    # LOT-1: the row without a time counts as the run itself, i.e. the latest one
    assert (b["LOT-1"].client, b["LOT-1"].location, b["LOT-1"].tech) == ("Acme", "Hall B", "Per")
    assert (b["LOT-2"].client, str(b["LOT-2"].batch_date)) == ("Bolt", "2024-02-13")
    assert "LOT-3" not in b and "LOT-9" not in b


def test_views(done):
    ledger, _, _ = done
    v = ledger.views()
    assert v["v_drive_lifecycle"].count() == 7
    assert [r.serial_norm for r in v["v_unmatched_removals"].collect()] == ["ONLY-REMOVED"]
    assert sorted(r.serial_norm for r in v["v_unmatched_shreds"].collect()) == ["ONLY-SHRED", "URL-COMP"]
    amb = v["v_ambiguous_matches"].collect()
    assert [(r.serial_norm, r.reason) for r in amb] == [("TWICE", "1 removals and 2 shreds share this serial")]
    life = {r.serial_norm: r for r in v["v_drive_lifecycle"].collect()}
    assert life["NO-TIME"].removal_time == RUN_1


def test_second_run_changes_nothing(spark, files, done):
    ledger, _, _ = done
    before = {n: df.count() for n, df in ledger.tables().items()}
    load(spark, ledger, files, RUN_2)
    counts = ledger.run(RUN_2)
    assert counts == {"stg_shred": 0, "stg_removal": 0, "events": 0, "decisions": 0}
    assert {n: df.count() for n, df in ledger.tables().items()} == before


def late_partner(spark, root, mode):
    ledger = Ledger(spark, root)

    def rows(kind, number, payload):
        return spark.createDataFrame(
            [(f"{kind}_sheet", "t", number, payload)],
            "source_sheet_id STRING, source_tab STRING, row_number BIGINT, payload MAP<STRING,STRING>",
        )

    ledger.ingest(rows("removal", 2, {"drive_serial": "late-1", "timestamp": "2024-01-01 00:00:00"}), RUN_1)
    ledger.run(RUN_1, mode)
    ledger.ingest(rows("shred", 2, {"Serial": "LATE-1", "timestamp": "2024-01-05 00:00:00"}), RUN_2)
    ledger.run(RUN_2, mode)
    return ledger.tables()["decisions"].collect()


def test_frozen_and_recompute(spark, tmp_path):
    frozen = late_partner(spark, str(tmp_path / "f"), "frozen")
    again = late_partner(spark, str(tmp_path / "r"), "recompute")
    assert [(r.decision, r.decided_at, r.rule_version) for r in frozen] == [("NO_MATCH", RUN_1, STRICT_V1)]
    assert [(r.decision, r.decided_at) for r in again] == [("MATCH", RUN_2)]


def test_edited_row_becomes_second_event(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    schema = "source_sheet_id STRING, source_tab STRING, row_number BIGINT, payload MAP<STRING,STRING>"
    for client in ["old", "new"]:
        ledger.ingest(
            spark.createDataFrame([("shred_x", "t", 2, {"Serial": "E1", "Client": client})], schema), RUN_1
        )
    ledger.run(RUN_2)
    assert ledger.tables()["decisions"].first().decision == "AMBIGUOUS"
    assert bronze.latest_per_row_key(ledger.bronze()).count() == 1


def test_event_on_both_routes_is_a_shred(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    schema = "source_sheet_id STRING, source_tab STRING, row_number BIGINT, payload MAP<STRING,STRING>"
    ledger.ingest(
        spark.createDataFrame(
            [("shred_and_removal", "t", 2, {"Serial": "B1", "Drive Serial": "B2"})], schema
        ),
        RUN_1,
    )
    counts = ledger.run(RUN_1)
    assert counts["stg_shred"] == counts["stg_removal"] == 1
    assert [(r.serial_norm, r.event_type) for r in ledger.tables()["events"].collect()] == [("B1", "SHREDDED")]


def test_sheet_values(spark, tmp_path):
    (tmp_path / "grid.json").write_text(
        '{"sheet_id":"s1","tab":"T","header_row":3,'
        '"values":[["A","B","A"],["1"],["2","3","4","5"],[]]}'
    )
    (tmp_path / "none.json").write_text('{"sheet_id":"s2","tab":"T","header_row":1,"values":[]}')
    (tmp_path / "bad.json").write_text('{"sheet_id":"s5","values":[["A"')
    loaded = sheet_sources(
        spark,
        [
            {"name": "one", "sheet_id": "s1", "tab": "T", "header_row": 3, "path": str(tmp_path / "grid.json")},
            {"name": "gone", "sheet_id": "s3", "tab": "T", "path": str(tmp_path / "missing.json")},
            {"name": "half", "sheet_id": "s4"},
            {"name": "none", "sheet_id": "s2", "tab": "T", "path": str(tmp_path / "none.json")},
            {"name": "bad", "sheet_id": "s5", "tab": "T", "path": str(tmp_path / "bad.json")},
        ],
    )
    got = [(r.source_sheet_id, r.row_number, r.payload) for r in loaded.rows.orderBy("row_number").collect()]
    assert got == [
        ("s1", 4, {"A": "", "B": ""}),
        ("s1", 5, {"A": "4", "B": "3"}),
        ("s1", 6, {"A": "", "B": ""}),
    ]
    assert [n for n, _ in loaded.skipped] == ["gone", "half"]
    assert [(r.source_name, r.path.rsplit("/", 1)[1], r.error) for r in loaded.rejected.collect()] == [("bad", "bad.json", "broken JSON")]


def test_latest_time_wins(spark):
    assert datetime(2024, 6, 1) < RUN_1 < RUN_2
