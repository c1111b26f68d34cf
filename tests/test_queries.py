"""Every query against its SQL on the smallest test tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def cell(v):
    if v is None or v != v or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, (float, int)) and not isinstance(v, bool):
        return float(f"{v:.9g}") if math.isfinite(v) else str(v)
    return v if isinstance(v, (str, bool)) else str(v)


def table(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False)) if len(df) < 1 else sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=str)


def names():
    return sorted(entry.queries())


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = df.toPandas()
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert table(got) == table(want)


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["doc_id", "relation_id"]
