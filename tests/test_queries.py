"""Every query with SQL gives the rows of its SQL on the smallest tables, and every other one runs."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def form(v):
    if isinstance(v, float):
        return "None" if v != v else f"{v:.9g}"
    if v is None or v is pd.NaT or v is pd.NA:
        return "None"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{v:.9g}" if abs(v) < 1e9 else str(v)
    return str(v.tolist() if hasattr(v, "tolist") else v)


def forms(df):
    return sorted(tuple(map(form, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if not n.startswith("p") or not n[1].isdigit() or n.startswith("p4_")])
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    if name not in entry.oracle_sql():
        got.write.format("noop").mode("overwrite").save()
        return
    got, want = got.toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert forms(got) == forms(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
