"""The poll loop: results equal batch runs, a replay adds nothing."""

import json
from datetime import datetime, timedelta

from custody.plans.incremental import IncrementalLedger
from custody.plans.ledger import Ledger
from custody.sources.rows import EXPORT_SCHEMA, sheet_values
from custody.streaming import drive_state, polling
from tests.conftest import RUN_1, RUN_2


def export(folder, name, sheet, rows):
    folder.mkdir(exist_ok=True)
    doc = {"sheet_id": sheet, "tab": "T", "header_row": 1, "values": [["Serial", "Drive Serial", "timestamp"], *rows]}
    (folder / name).write_text(json.dumps(doc))


def drain(spark, folder, ledger, checkpoint, at, mode="frozen"):
    grids = spark.readStream.schema(EXPORT_SCHEMA).json(str(folder))
    polling.poll(sheet_values(grids), ledger, checkpoint, clock=lambda: at, mode=mode, once=True).awaitTermination()


def decisions(ledger):
    return {r.serial_norm: (r.decision, r.decided_at) for r in ledger.tables()["decisions"].collect()}


def test_late_partner_and_replay(spark, tmp_path):
    folder = tmp_path / "in"
    ledger = Ledger(spark, str(tmp_path / "tables"))
    export(folder, "1.json", "removal_a", [["", "D1", "2024-01-01 00:00:00"], ["", "D2", "2024-01-01 00:00:00"]])
    export(folder, "2.json", "shred_a", [["D2", "", "2024-01-02 00:00:00"]])
    drain(spark, folder, ledger, str(tmp_path / "cp"), RUN_1)
    assert decisions(ledger) == {"D1": ("NO_MATCH", RUN_1), "D2": ("MATCH", RUN_1)}

    export(folder, "3.json", "shred_b", [["D1", "", "2024-01-03 00:00:00"]])
    drain(spark, folder, ledger, str(tmp_path / "cp"), RUN_2)
    assert decisions(ledger)["D1"] == ("NO_MATCH", RUN_1)

    before = {n: df.count() for n, df in ledger.tables().items()}
    drain(spark, folder, ledger, str(tmp_path / "cp-lost"), RUN_2)  # a lost checkpoint reads it all again
    assert {n: df.count() for n, df in ledger.tables().items()} == before
    ledger.decide(RUN_2, mode="recompute")
    assert decisions(ledger) == {"D1": ("MATCH", RUN_2), "D2": ("MATCH", RUN_1)}


def test_late_partners_over_micro_batches_and_a_lost_checkpoint(spark, tmp_path):
    folder, ledger = tmp_path / "in", IncrementalLedger(spark, str(tmp_path / "tables"), buckets=2)
    export(folder, "1.json", "removal_a", [["", "D1", "2024-01-01 00:00:00"], ["", "D2", "2024-01-01 00:00:00"]])
    export(folder, "2.json", "shred_a", [["D2", "", "2024-01-02 00:00:00"]])
    export(folder, "3.json", "shred_b", [["D1", "", "2024-01-03 00:00:00"]])

    def drain(checkpoint):
        grids = spark.readStream.schema(EXPORT_SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
        polling.poll_changes(sheet_values(grids), ledger, checkpoint, clock=lambda: RUN_1, mode="recompute", once=True).awaitTermination()

    drain(str(tmp_path / "cp"))
    assert ledger.store.read("loads").count() == 3
    assert {r.serial_norm: r.decision for r in ledger.tables()["decisions"].collect()} == {"D1": "MATCH", "D2": "MATCH"}
    before = {n: df.count() for n, df in ledger.tables().items() if n not in ("loads", "steps")}
    drain(str(tmp_path / "cp-lost"))
    assert {n: df.count() for n, df in ledger.tables().items() if n not in ("loads", "steps")} == before


def test_drive_state_counts_over_a_restart_and_forgets_idle_drives(spark, tmp_path):
    schema = "serial_norm STRING, event_type STRING, event_time TIMESTAMP"
    day = datetime(2024, 1, 1)

    def drain(name, rows):
        spark.createDataFrame([(s, t, day + timedelta(days=d)) for s, t, d in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        updates = drive_state.running_sides(spark.readStream.schema(schema).parquet(str(tmp_path / "events")), timedelta(days=5))
        seen = []
        writer = updates.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        writer.foreachBatch(lambda df, n: seen.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
        return {(r.serial_norm, r.removed_count, r.shredded_count, r.left) for r in seen}

    assert drain("one", [("D1", "REMOVED", 0), ("D1", "REMOVED", 1), ("D2", "SHREDDED", 1)]) == {("D1", 2, 0, False), ("D2", 0, 1, False)}
    assert drain("two", [("D1", "SHREDDED", 3)]) == {("D1", 2, 1, False)}  # goes on from the checkpoint
    assert drain("three", [("D3", "REMOVED", 9)]) == {("D3", 1, 0, False), ("D2", 0, 1, True), ("D1", 2, 1, True)}
    assert drain("four", [("D1", "SHREDDED", 10)]) == {("D1", 0, 1, False)}  # its state had left


def test_drive_state_holds_a_row_a_group(spark, tmp_path):
    schema = "serial_norm STRING, event_type STRING, event_time TIMESTAMP"
    day = datetime(2024, 1, 1)

    def drain(rows):
        spark.createDataFrame([(s, t, day + timedelta(days=d)) for s, t, d in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        updates = drive_state.running_sides(spark.readStream.schema(schema).parquet(str(tmp_path / "events")), timedelta(days=5), groups=2)
        seen = []
        writer = updates.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        query = writer.foreachBatch(lambda df, n: seen.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        return {(r.serial_norm, r.removed_count, r.shredded_count, r.left) for r in seen}, query.lastProgress["stateOperators"][0]["numRowsTotal"]

    first, held = drain([(f"D{i}", "REMOVED", i % 4) for i in range(40)] + [(None, "SHREDDED", 0), (None, "REMOVED", 2)])
    assert first == {(f"D{i}", 1, 0, False) for i in range(40)} | {(None, 1, 1, False)}
    assert held == 2
    # day 0 and 1 leave, one of day 1 has come back and counts on
    second, _ = drain([("D1", "SHREDDED", 6), ("D2", "REMOVED", 6), ("E", "SHREDDED", 6)])
    gone = {(f"D{i}", 1, 0, True) for i in range(40) if i % 4 == 0}
    assert second == {("D1", 1, 1, False), ("D2", 2, 0, False), ("E", 0, 1, False)} | gone
    third, held = drain([("E", "SHREDDED", 40)])
    kept = {(f"D{i}", 1, 0, True) for i in range(3, 40) if i % 4} - {("D1", 1, 0, True), ("D2", 1, 0, True)}
    assert third == kept | {("D1", 1, 1, True), ("D2", 2, 0, True), (None, 1, 1, True), ("E", 0, 2, False)} and held == 1
