import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LIGHT = ["p3_found", "pair_census", "leakage", "stats_by_group", "hash_split", "threshold_sweep_f1", "interval_overlap", "session_union"]


def test_contract():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80 and all(callable(f) for f in q.values())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["call_id", "gap_start", "gap_end"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", LIGHT)
def test_light_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    r = con.sql(entry.oracle_sql()[name])
    order = [r.columns.index(c) for c in cols]
    assert got == sorted(str(tuple(x[i] for i in order)) for x in r.fetchall())
