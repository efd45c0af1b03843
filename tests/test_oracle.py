"""Every registered query against its SQL twin on the smallest given tables."""

import decimal
import os

import pytest

import __spark_entry__ as entry
from custody.workload import catalog

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return None if v is None else str(decimal.Decimal(v) if isinstance(v, decimal.Decimal) else v)


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple(x or "" for x in r))


def test_every_query_has_its_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = sql.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    pick = [theirs.index(c) for c in columns]
    want = ordered([[r[i] for i in pick] for r in cursor.fetchall()])
    assert ordered(df.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
