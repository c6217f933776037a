"""Every registered query runs on the smallest tables and, where SQL can say it, equals DuckDB."""

import glob
import os

import duckdb
import pytest

from memloom.llm import registry

DATA = os.environ.get("MEMLOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    assert rows
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in registry.ORACLES:
        c = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        res = c.execute(registry.ORACLES[name])
        at = [[d[0] for d in res.description].index(x) for x in cols]
        assert sorted(rows, key=repr) == sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=repr)
