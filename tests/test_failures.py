"""Failing runs, history strips and nesting, against a plain Python fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from buildlens.operators import failures as FA
from buildlens.operators.nesting import case_rows
from buildlens.schemas import TEST_RUNS

DAY = dt.datetime(2024, 1, 1)


def run(i, build, name, status, scenario="S", config="c", hours=None, **more):
    row = dict(id=i, build=build, scenario=scenario, config=config, name=name, status=status, duration_s=10.0,
               failure_msg=None, failure_txt=None, jira=None, jira_url=None, task_url=None, log_url=None,
               ran_at=DAY + dt.timedelta(hours=i if hours is None else hours))
    return tuple({**row, **more}[f.name] for f in TEST_RUNS)


@pytest.fixture(scope="module")
def rows():
    """One hot name has a third of all rows."""
    rng = random.Random(5)
    out, i = [], 0
    for build in range(1, 31):
        for n in range(20):
            for _ in range(2 if n else 20):
                i += 1
                status = rng.choice(["pass", "pass", "pass", "fail", "error", "timeout", "skip"])
                out.append(run(i, str(build), f"t{n}", status, scenario=f"S{n % 3}", config=f"c{i % 2}", hours=rng.randrange(200)))
    return out


@pytest.fixture(scope="module")
def runs(spark, rows):
    return spark.createDataFrame(rows, TEST_RUNS).repartition(7)


def folded(rows, build, limit=7):
    names = [f.name for f in TEST_RUNS]
    recs = [dict(zip(names, r)) for r in rows]
    strips = {}
    for r in sorted((r for r in recs if r["build"] != build), key=lambda r: (r["ran_at"], r["id"]), reverse=True):
        kept = strips.setdefault(r["name"], [])
        if len(kept) < limit:
            kept.append((r["build"], r["status"]))
    return {r["id"]: [*reversed(strips.get(r["name"], [])), ("current", r["status"])]
            for r in recs if r["build"] == build and r["status"] in ("fail", "error", "timeout")}


def test_history_is_the_newest_runs_of_other_builds(runs, rows):
    got = FA.failure_class(runs, "15").collect()
    assert {r["id"]: [(h["build"], h["status"]) for h in r["history"]] for r in got} == folded(rows, "15")
    assert all(h["current"] == (h["build"] == "current") for r in got for h in r["history"])


def test_many_names_give_the_same_rows_without_broadcast(runs):
    names = FA.failing_names(FA.failing_runs(runs, "15"))
    few = FA.last_n_runs(runs, names, "15")
    many = FA.last_n_runs(runs, names, "15", few=False)
    key = lambda df: sorted(tuple(r) for r in df.select("name", "rn", "id").collect())
    assert key(few) == key(many) and key(few)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_tables_without_ids(runs):
    bare = runs.drop("id")
    assert FA.failure_class(bare, "15").count() == FA.failing_runs(runs, "15").count()


def test_name_without_history_gets_only_the_current_entry(spark):
    runs = spark.createDataFrame([run(1, "7", "new", "fail"), run(2, "7", "fine", "pass")], TEST_RUNS)
    row = FA.failure_class(runs, "7").collect()[0]
    assert [h["build"] for h in row["history"]] == ["current"]
    assert (row["history_rate"], row["history_note"]) == ("0 / 1 passed", "")


def test_clean_cases(spark):
    runs = spark.createDataFrame([
        run(1, "7", "a b", "fail", failure_msg=" HTTP 403\n", failure_txt="x" * 9000, jira="P-1", duration_s=192.0),
        run(2, "7", "c", "error", jira_url="u", task_url="v", log_url="w", duration_s=None)], TEST_RUNS)
    got = FA.clean_cases(FA.failing_runs(runs, "7"), "J/", "", "L/").orderBy("id").collect()
    assert (got[0]["failure_message"], len(got[0]["failure_text"]), got[0]["duration"]) == ("HTTP 403", 8192, "3m 12s")
    assert (got[0]["jira_url"], got[0]["task_url"], got[0]["log_url"]) == ("J/P-1", "#", "L/a_b")
    assert (got[1]["jira_url"], got[1]["task_url"], got[1]["log_url"], got[1]["duration"]) == ("u", "v", "w", "—")


@pytest.mark.parametrize("list_size", [1000, 5])
def test_groups_hold_every_case_in_name_order(runs, list_size):
    cases = FA.clean_cases(runs.filter(F.col("status") == "fail"))
    groups = FA.scenario_groups(cases, list_size).collect()
    assert sorted(c["id"] for g in groups for c in g["test_cases"]) == sorted(r["id"] for r in cases.collect())
    for g in groups:
        names = [c["name"] for c in g["test_cases"]]
        assert names == sorted(names)
    if list_size == 5:
        assert max(g["part"] for g in groups) > 0
        assert max(len(g["test_cases"]) for g in groups) <= 20


def test_nesting_round_trip(runs):
    cases = FA.clean_cases(FA.failing_runs(runs, "15"))
    back = case_rows(FA.scenario_groups(cases, 3))
    want = sorted(tuple(r) for r in cases.select("id", "scenario", "config", "name").collect())
    assert sorted(tuple(r) for r in back.select("id", "scenario", "scenario_config", "name").collect()) == want


def test_badge_and_gate(runs):
    cases = FA.clean_cases(FA.failing_runs(runs, "15"))
    assert FA.failed_badge(FA.scenario_groups(cases, 4)).first()["failed"] == cases.count()
    assert FA.gate(cases).first()["gate"] == 2
    assert FA.gate(cases.filter("false")).first()["gate"] == 0
    assert FA.failed_badge(FA.scenario_groups(cases.filter("false"))).first()["failed"] == 0


def test_environment_and_defaults(spark):
    cases = spark.createDataFrame([("", None, "a1", "C", "linux", "x"), ("own", "mac", None, "C", "linux", None)],
                                  "config string, os string, agent string, scenario_config string, scenario_os string, scenario_agent string")
    got = [tuple(r)[:3] for r in FA.inherit_environment(cases).collect()]
    assert got == [("C", "linux", "a1"), ("own", "mac", "")]
    plain = FA.case_defaults(spark.createDataFrame([("t",)], "name string")).first()
    assert (plain["is_scenario_error"], plain["error_label"], plain["has_ai"]) == (False, "", False)


def test_a_few_names_reach_the_files_of_a_lake(spark, tmp_path):
    from buildlens.schemas import TEST_RUNS
    from buildlens.sources import tables as TB
    rows = [run(i, "6", f"case {i:04d}", "pass") for i in range(400)] + [run(1000 + i, "7", f"case {i:04d}", "fail") for i in (3, 399)] + [run(2000, "7", None, "fail")]
    path = str(tmp_path / "runs")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    TB.write_lake(spark.createDataFrame(rows, TEST_RUNS), path, "test_runs")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lake = TB.read_lake(spark, path, "test_runs")
    names = FA.failing_names(FA.failing_runs(lake, "7"))
    last = FA.last_n_runs(lake, names, "7")
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "In(name, [case 0003,case 0399])" in plan and "Join" not in plan
    assert sorted(r["name"] for r in last.collect()) == ["case 0003", "case 0399"]
    many = spark.range(3000).select(F.concat(F.lit("case "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("name"))
    assert FA.names_for_filter(many) is None
    assert FA.last_n_runs(lake, many, "7").count() == 400
    assert FA.names_for_filter(spark.createDataFrame([("x" * 1_000_001,)], "name string")) is None


def test_a_name_with_most_cases_keeps_them(spark):
    from buildlens.schemas import TEST_RUNS
    runs = spark.createDataFrame([run(i, "7", "hot" if i % 3 else f"n{i}", "fail") for i in range(300)] + [run(900, "6", "hot", "pass")], TEST_RUNS)
    got = FA.failure_history(FA.clean_cases(FA.failing_runs(runs, "7")), runs, "7").collect()
    assert len(got) == 300 and {(r["name"] == "hot", len(r["history"])) for r in got} == {(True, 2), (False, 1)}
