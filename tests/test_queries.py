"""Every registered query beside its SQL twin on the smallest tables, and rules on the plans."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from kindred.plans.registry import TABLES
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
TRAINING_DATA = re.compile(r"op\d+_|pipeline$")  # these have tests of their own
QUERIES = {n: q for n, q in entry.queries().items() if not TRAINING_DATA.match(n)}
TWINS = {n: q for n, q in entry.oracle_sql().items() if not TRAINING_DATA.match(n)}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    got = rows_of(df.columns, df.collect())
    if name in TWINS:
        cur = con.execute(TWINS[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows_of(cols, cur.fetchall())


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns
