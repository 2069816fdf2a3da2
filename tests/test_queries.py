"""Every query against its DuckDB twin at the smallest scale, and the shape of key plans."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check_oracles import TABLES, rows_of


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[0]
        return
    cur = con.execute(sql)
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["window_stats", "edge_features", "node_features", "window_target", "rollout_fixed"])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|ArrowEvalPython|MapInPandas", plan)


def test_flow_scan_is_pruned(spark):
    plan = entry.queries()["window_target"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "event_type" not in plan.rsplit("ReadSchema", 1)[1]
