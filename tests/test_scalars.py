"""Scalar functions on edge cases; expected values written by hand."""

import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from custody.functions import labels, text, times, units, variants
from custody.functions.hashing import bundle_hash, json_string, json_text, payload_hash, payload_json
from custody.functions.serials import (
    ledger_serial,
    looks_like_url,
    plausible_serial,
    serial_tag,
    tracker_serial,
)


def values(spark, fn, inputs, schema="v STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i INT, {schema}")
    return [r[0] for r in df.repartition(2).select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_ledger_serial(spark):
    given = [None, "", "  ab-1 ", "ab. ,;:", " x1 ", "...", "a.b", "straße", "\tq\n", "a b ."]
    want = ["", "", "AB-1", "AB", "X1", "", "A.B", "STRASSE", "Q", "A B"]
    assert values(spark, ledger_serial, given) == want
    assert values(spark, lambda c: ledger_serial(ledger_serial(c)), given) == want


def test_tracker_serial(spark):
    given = [None, "", " a  b ", "A\tB", "ＡＢ１", "x  y", "a\x7fb\x00", "ﬁx", "café", "..."]
    want = ["", "", "A B", "AB", "AB1", "X Y", "AB", "FIX", "CAFÉ", "..."]
    assert values(spark, tracker_serial, given) == want
    assert values(spark, lambda c: tracker_serial(tracker_serial(c)), given) == want


def brute_tracker(s):
    s = unicodedata.normalize("NFKC", s or "")
    s = "".join(ch for ch in s if not (ord(ch) < 32 or ord(ch) == 127))
    return " ".join(s.split()).upper()


def test_tracker_serial_against_brute_force(spark):
    given = ["".join(chr(c) for c in range(a, a + 40)) for a in [1, 90, 120, 8180, 8220, 12270, 65280]]
    assert values(spark, tracker_serial, given) == [brute_tracker(s) for s in given]


def test_plausible_and_tags(spark):
    given = [None, "", "12345", "123456", " 12345 ", "unknown", "NOT SPECIFIED", "0000000", "0000000000"]
    assert values(spark, plausible_serial, given) == [False, False, False, True, False, False, False, False, True]
    assert values(spark, serial_tag, [None, "", "NOSERIAL-ab", "S1"]) == [None, None, "(no serial)", "(SN S1)"]
    assert values(spark, looks_like_url, ["HTTP://x", "wWw.a", "https://", "http:/x", None]) == [True, True, True, False, False]


def test_bytes(spark):
    n = [None, 0.0, 1.0, 1023.9, 1024.0, 1536.0, 1023.96 * 1024, 256 * 1024.0**3, 5 * 1024.0**5, 0.25 * 1024]
    assert values(spark, units.format_bytes, n, "v DOUBLE") == [
        "0 B", "0 B", "1.0 B", "1023.9 B", "1.0 KB", "1.5 KB", "1024.0 KB", "256.0 GB", "5.0 PB", "256.0 B",
    ]
    assert values(spark, units.capacity_text, [None, 0.0, 2048.0], "v DOUBLE") == [None, None, "2.0 KB"]
    assert values(spark, units.iec_bytes, ["x", None, "0", "1000", "1536", "2251799813685248"]) == [
        "—", "—", "0 B", "1000 B", "1.5 KiB", "2.0 PiB",
    ]


@pytest.mark.parametrize("x", [0.05, 0.15, 0.25, 0.35, 2.5, 1.45, 1000.65, 12345.25])
def test_rounding_is_that_of_printf_in_the_source(spark, x):
    assert values(spark, lambda c: units.fixed(c, 1), [x], "v DOUBLE") == [f"{x:.1f}"]


def test_memory_and_clock(spark):
    g = 1024**3
    assert values(spark, units.memory_text, [None, 0, 16 * g, int(15.6 * g), g + 5_000_000], "v BIGINT") == [
        None, None, "16 GB", "15.6 GB", "1 GB",
    ]
    assert values(spark, units.memory_text_to_bytes, ["16.0 GB", "2.5 MB", "7.0 B", None]) == [
        16 * g, int(2.5 * 1024**2), 7, None,
    ]
    assert values(spark, units.clock_text, [None, 0, -1, 999_999_999, 1_000_000_000, 3_456_000_000], "v BIGINT") == [
        None, None, None, "1000 MHz", "1.00 GHz", "3.46 GHz",
    ]
    assert values(spark, units.clock_text_ghz, ["0", None, "900000000", "x"]) == ["—", "—", "0.90 GHz", "—"]


def test_times(spark):
    given = ["2024-01-02 03:04:05", "1/2/2024 3:04:05", "01/02/2024 03:04:05", "2024-01-02T03:04:05", "2024-01-02",
             "13/02/2024 00:00:00", "", None, "2024-02-30 00:00:00", "24-01-02 03:04:05"]
    got = [None if v is None else str(v) for v in values(spark, times.parse_timestamp, given)]
    assert got == ["2024-01-02 03:04:05"] * 4 + [None] * 6
    dates = ["2024-01-02", "03/04/2024", "13/02/2024", "2024-13-01", "nonsense", ""]
    got = [None if v is None else str(v) for v in values(spark, times.parse_date, dates)]
    assert got == ["2024-01-02", "2024-03-04", "2024-02-13", None, None, None]
    iso = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04", "now", "2024-01-02T03:04:05.25"]
    got = [None if v is None else str(v) for v in values(spark, times.parse_iso, iso)]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 03:04:00", None, "2024-01-02 03:04:05.250000"]


def test_payload_hash_equals_sorted_ascii_json(spark):
    rows = [{"b": "1", "a": None}, {"Kunde": "Jäger €", "x": 'q"\\'}, {"e": "\U0001f600\n"}, {}]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i INT, m MAP<STRING,STRING>")
    got = df.select("i", payload_json("m").alias("j"), payload_hash("m").alias("h")).orderBy("i").collect()
    for row, want in zip(got, rows):
        canonical = json.dumps(want, sort_keys=True, separators=(",", ":"))
        assert row.j == canonical
        assert row.h == hashlib.sha256(canonical.encode()).hexdigest()


def test_bundle_hash(spark):
    a, b, c = '{"a":1,"b":{"c":[1,2]}}', ' {"b": {"c": [1, 2]}, "a": 1} ', '{"a":2}'
    h = values(spark, bundle_hash, [a, b, c, "{bad", '{"a":1}}'])
    assert h[0] == h[1] != h[2] and h[3] is None and h[4] is None
    assert h[0] == hashlib.sha256(a.encode()).hexdigest()
    assert len(set(values(spark, lambda v: bundle_hash(v, "text"), [a, b, c]))) == 3


def test_parse_document_is_strict(spark):
    given = ['{"a":1}', '{"a":1} x', '{"a":1},{"b":2}', "[1]", '{"a":1}]', "", "null", '{"a":1,"a":2}']
    got = values(spark, lambda c: F.to_json(variants.parse_document(c)), given)
    assert got == ['{"a":1}', None, None, "[1]", None, None, "null", '{"a":2}']


def test_json_texts(spark):
    docs = ['{"v":"é"}', '{"v":12}', '{"v":["a","b"]}', '{"v":null}', "{}"]
    got = values(spark, lambda c: json_text(variants.member(F.try_parse_json(c), "$.v")), docs)
    assert got == ['"\\u00e9"', "12", '["a", "b"]', "null", "null"]
    assert values(spark, json_string, ['x"y', "é", None, ""]) == ['"x\\"y"', '"\\u00e9"', "null", '""']


def test_text_helpers(spark):
    assert values(spark, text.preview, [None, "", "a" * 50, "a" * 51]) == ["-", "-", "a" * 50, "a" * 50 + "..."]
    assert values(spark, text.first_line, [" \n one \ntwo", "", None, "x" * 200]) == ["one ", None, None, "x" * 140]
    note = "seen elsewhere"
    got = values(spark, lambda c: text.append_note(c, note), [None, "", "old", f"old\n{note}"])
    assert got == [note, note, f"old\n{note}", f"old\n{note}"]
    assert values(spark, text.file_tag, ["A-1_x.json", "a.b.json", "x.JSON", "dir/x.json"]) == ["A-1_x", None, None, None]
    assert values(spark, lambda c: F.array_join(text.text_lines(c, "hub"), "|"), ["a\r\n\n b \nhub 1\rc"]) == ["a|b|c"]
    assert values(spark, lambda c: text.key_line(c, "energy-full"), ["energy-full-design: 1\n  energy-full:  2 Wh \n"]) == ["2 Wh"]
    assert values(spark, text.collector_status, [0, 127, 3], "v INT") == ["OK", "MISSING", "rc=3"]


def test_labels(spark):
    assert values(spark, lambda c: labels.label(c, labels.ASSET_STATUS), ["ready", "odd", None]) == [
        "Ready for Sale", "odd", None,
    ]
