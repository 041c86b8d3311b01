"""Every query against its SQL on the smallest test tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    if name == "four_way_evaluation":
        pytest.skip("trained in test_ml")
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    if name not in catalogue.ORACLE:
        assert got
        return
    result = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
