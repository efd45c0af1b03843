"""The incremental ledger: equal to the whole-history one, repeatable after any stop, its reads follow the load."""

import pytest
from pyspark.sql import functions as F

from custody.plans.incremental import IncrementalLedger, combined, step_totals
from custody.plans.ledger import Ledger
from custody.sinks.buckets import BucketStore
from tests.conftest import RUN_1, RUN_2

ROWS = "source_sheet_id string, source_tab string, row_number long, payload map<string,string>"


def sheet(spark, *rows):
    return spark.createDataFrame([(s, "T", n, p) for s, n, p in rows], ROWS)


def removal(n, serial, **more):
    return ("removal_a", n, {"Drive Serial": serial, "timestamp": f"2024-01-01 00:00:{n:02d}", **more})


def shred(n, serial, **more):
    return ("shred_a", n, {"Serial": serial, "timestamp": f"2024-01-02 00:00:{n:02d}", "Batch ID": f"B{n % 3}", **more})


LOADS = [
    [removal(1, "d1"), removal(2, "d2"), removal(3, "d3 "), removal(4, "d3"), removal(5, ""), removal(6, "..."), shred(1, "d9", Client="c")],
    [shred(2, "D1", Tech="t"), shred(3, "d9"), removal(1, "d1")],
    [shred(4, "d2"), removal(7, "d9"), ("removal_shred", 1, {"Serial": "d8", "Drive Serial": "d7"})],
]


def plain(tables):
    """All tables without times of runs, load names and working columns."""
    skip = {"created_at", "ingested_at", "load", "finished_at", "decided_at", "first_seen_at", "last_seen_at"}
    out = {}
    for name in ("bronze", "stg_shred", "stg_removal", "drives", "batches", "events", "decisions"):
        df = tables[name].drop(*skip)
        if name == "bronze":
            df = df.withColumn("payload", F.to_json(F.array_sort(F.map_entries("payload"))))
        if name == "events":
            df = df.withColumn("event_time", F.when(F.col("event_time") < "2024-02-01", F.col("event_time")))
        out[name] = sorted(map(str, df.select(*sorted(df.columns)).collect()))
    return out


@pytest.mark.parametrize("mode", ["frozen", "recompute"])
def test_equals_the_ledger_over_all_history(spark, tmp_path, mode):
    whole = Ledger(spark, str(tmp_path / "whole"))
    own = IncrementalLedger(spark, str(tmp_path / "own"), buckets=4)
    for i, load in enumerate(LOADS):
        rows = sheet(spark, *load)
        found = whole.ingest(rows, RUN_1)
        counts = own.process(rows, RUN_1, f"load-{i}", mode)
        whole.run(RUN_1, mode)
        assert (counts["bronze"], counts["duplicates"]) == (found["inserted"], found["duplicates"])
        assert plain(own.tables()) == plain(whole.tables()), i
    assert {r.serial_norm: r.decision for r in own.tables()["decisions"].collect()}["D2"] == ("NO_MATCH" if mode == "frozen" else "MATCH")
    totals = {r.step: r.rows for r in step_totals(own.store.read("steps")).collect()}
    assert totals["bronze"] == 12 and totals["duplicates"] == 1
    views = {k: sorted(map(str, v.drop("decided_at").collect())) for k, v in own.views().items()}
    assert views == {k: sorted(map(str, v.drop("decided_at").collect())) for k, v in whole.views().items()}


class Stopped(Exception):
    pass


@pytest.mark.parametrize("mode", ["frozen", "recompute"])
def test_a_load_stopped_before_any_write_and_repeated_gives_the_same_tables(spark, tmp_path, monkeypatch, mode):
    right = IncrementalLedger(spark, str(tmp_path / "right"), buckets=2)
    for i, load in enumerate(LOADS[:2]):
        right.process(sheet(spark, *load), RUN_1, f"load-{i}", mode)
    want = {n: sorted(map(str, df.select(*[c for c in df.columns if c != "payload"]).collect())) for n, df in right.tables().items()}
    writes = {"n": 0, "stop": None}

    def counted(fn):
        def run(self, name, *args, **kwargs):
            writes["n"] += 1
            if writes["n"] == writes["stop"]:
                raise Stopped
            return fn(self, name, *args, **kwargs)

        return run

    for method in ("append_new", "upsert"):
        monkeypatch.setattr(BucketStore, method, counted(getattr(BucketStore, method)))
    for stop in (4, 7) if mode == "frozen" else (8,):
        own = IncrementalLedger(spark, str(tmp_path / f"stop-{stop}"), buckets=2)
        own.process(sheet(spark, *LOADS[0]), RUN_1, "load-0", mode)
        writes.update(n=0, stop=stop)
        with pytest.raises(Stopped):
            own.process(sheet(spark, *LOADS[1]), RUN_1, "load-1", mode)
        writes["stop"] = None
        if stop != 4:
            own.process(sheet(spark, *LOADS[1]), RUN_2, "load-1", mode)
        else:  # or completed from the stored rows
            assert [r.load for r in own.unfinished().collect()] == ["load-1"]
            assert own.repair(RUN_2, mode) == ["load-1"]
        assert own.unfinished().isEmpty()
        got = {n: sorted(map(str, df.select(*[c for c in df.columns if c != "payload"]).collect())) for n, df in own.tables().items()}
        known = [n for n in want if stop != 4 or n != "steps"]  # how many rows a load held twice is known only to a repeat
        assert {n: got[n] for n in known} == {n: want[n] for n in known}, stop


def test_a_load_repeated_whole_adds_nothing(spark, tmp_path):
    own = IncrementalLedger(spark, str(tmp_path), buckets=2)
    own.process(sheet(spark, *LOADS[0]), RUN_1, "one")
    before = {n: sorted(map(str, df.collect())) for n, df in own.tables().items()}
    own.process(sheet(spark, *LOADS[0]), RUN_2, "one")
    assert {n: sorted(map(str, df.collect())) for n, df in own.tables().items()} == before
    counts = own.process(sheet(spark, *LOADS[0]), RUN_2, "other name")
    assert counts["bronze"] == counts["events"] == counts["decisions"] == 0 and counts["duplicates"] == 7


def test_rows_read_follow_the_load_and_not_the_history(spark, tmp_path):
    """One row a load, into tables of which the history fills all buckets: the reads stay in a few buckets."""
    own = IncrementalLedger(spark, str(tmp_path), buckets=16)
    own.process(sheet(spark, *[removal(i, f"h{i}") for i in range(60)]), RUN_1, "history")
    load = own.store.stage("load", sheet(spark, shred(50, "h7")))
    for name, keys in (("sides", [("H7",)]), ("decisions", [("H7", "strict_serial_v1")])):
        layout = own.store.tables[name]
        frame = spark.createDataFrame(keys, ", ".join(f"{k} string" for k in layout.key))
        touched = own.store.touched(name, frame)
        assert len(touched) == 1
        near, whole = own.store.near(name, touched).count(), own.store.read(name).count()
        assert near < whole / 4
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("of=16/bucket=*/*.parquet") if "/sides/" in str(f) or "/drives/" in str(f)}
    own.process(load, RUN_2, "late", "recompute")
    after = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("of=16/bucket=*/*.parquet") if "/sides/" in str(f) or "/drives/" in str(f)}
    changed = {f.parent for f, _ in set(before.items()) ^ set(after.items())}
    assert len(changed) == 2  # one bucket of either table
    assert own.store.read("decisions").where("serial_norm = 'H7'").first().decision == "MATCH"


def test_counters_add_up():
    assert combined({"a": 1}, {"a": 2, "b": 3}) == {"a": 3, "b": 3}
    assert combined() == {}
