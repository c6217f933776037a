"""Every registered query runs on the smallest tables and, where SQL can say it, equals DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("MEMLOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def tidy(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(tidy, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


CORE = [n for n in entry.registry.QUERIES]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    cols = sorted(df.columns)
    if name not in entry.oracle_sql():
        return
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = [dict(zip(names, r)) for r in res.fetchall()]
    assert sorted(names) == cols
    key = lambda r: repr(r)
    assert sorted([tuple(tidy(r[c]) for c in cols) for r in rows], key=key) == sorted([tuple(tidy(r[c]) for c in cols) for r in want], key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
