"""The driver's functions, and all registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from vellum.plans import coverage  # noqa: F401
from vellum.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float) and math.isnan(v):
        return None
    try:
        return float(f"{float(v):.8g}")
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_build_rows_normalises_no_text_below_its_sort(spark):
    plan = QUERIES["build_rows"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan.split("rangepartitioning")[1]  # a tree, its leaves last
