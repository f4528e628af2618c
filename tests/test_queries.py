"""Every named query against its SQL, and what its plan must not contain."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from data_folder import DATA
from suite import failures, logs, metrics, reports, text, tickets

BASE = (failures, metrics, text, tickets, logs, reports)
QUERIES = {name: query for m in BASE for name, (query, _) in m.QUERIES.items()}
SQL = {name: sql for m in BASE for name, (_, sql) in m.QUERIES.items() if sql}
WITHOUT_SQL = set()
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroups"]


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, DATA, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert [f for f in FORBIDDEN if f in plan] == []
    assert ("MapInPandas" in plan) == (name == "user_scoring")


def test_build_and_status_reach_the_scan_and_columns_are_pruned(spark, tmp_path):
    from buildlens.operators.failures import failing_runs, history_runs
    from buildlens.schemas import TEST_RUNS
    spark.createDataFrame([], TEST_RUNS).write.parquet(str(tmp_path / "runs"))
    runs = spark.read.schema(TEST_RUNS).parquet(str(tmp_path / "runs"))
    plan = failing_runs(runs, "7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(build,7)" in plan and "In(status, [error,fail,timeout])" in plan
    history = history_runs(runs, "7").select("name", "status")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<build:string,name:string,status:string>" in history


@pytest.mark.parametrize("name, node", [("last_n_runs", "WindowGroupLimit"), ("summary_chips", "WindowGroupLimit"), ("recent_builds", "TakeOrderedAndProject"),
                                        ("slowest_files", "TakeOrderedAndProject")])
def test_rankings_are_limited_before_the_shuffle(spark, name, node):
    assert node in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_postings_are_limited_before_the_shuffle(spark):
    from buildlens.operators.tickets import ticket_postings
    from suite.tables import view
    plan = ticket_postings(view(spark, DATA, "tickets"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]


def test_flagship(spark):
    assert entry.entry(spark).count() == 7
