"""Whole reports: merge, checks, read and write."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from buildlens.operators import merge as MG
from buildlens.operators import nesting as NE
from buildlens.operators import quality as Q
from buildlens.plans.report import Settings, Source, analyse, build_report, resolve, write_report
from buildlens.schemas import PERFORMANCE_METRICS, TEST_RUNS
from buildlens.sources import tables as TB
from buildlens.sources.documents import read_report
from test_failures import run
from test_metrics import perf_rows


def document(**parts):
    return {"build": {"number": "1247", "ref_build": "1244", "badges": {"passed": 3}}, "failures": [], "performance": [], **parts}


@pytest.fixture
def saved(spark, tmp_path):
    def save(*docs):
        for i, d in enumerate(docs):
            (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=2, ensure_ascii=False))
        return read_report(spark, str(tmp_path))
    return save


def test_valid_report_has_no_violations(saved):
    good = document(failures=[{"scenario": "S", "test_cases": [{"name": "a", "status": s} for s in ("fail", "error", "timeout", "skip", None)]}],
                    performance=[{"model": "M", "metrics": [{"name": "x", "current": 1, "direction": "lower_better"}]}])
    assert Q.violations(saved(good)).count() == 0


def test_violations_name_their_place(saved):
    bad = document(
        failures=[{"scenario": "S", "test_cases": []}, {"scenario": "", "test_cases": [{"name": "a", "status": "fail"}, {"name": None, "status": "broken"}]}],
        performance=[{"metrics": [{"name": "X"}, {"current": 1.5, "direction": "sideways"}]}])
    bad["build"]["number"] = " "
    got = {(r["location"], r["message"]) for r in Q.violations(saved(bad)).collect()}
    assert got == {
        ("build", "build.number is missing — was a build name provided?"),
        ("failures[1]", "missing 'scenario' field"),
        ("failures[1].test_cases[1]", "missing 'name' field"),
        ("failures[1].test_cases[1]", "unknown status 'broken' — expected one of ['error', 'fail', 'skip', 'timeout']"),
        ("performance[0]", "missing 'model' field"),
        ("performance[0].metrics[0]", "missing 'current' value"),
        ("performance[0].metrics[1]", "missing 'name' field"),
        ("performance[0].metrics[1]", "invalid direction 'sideways' — expected one of ['higher_better', 'lower_better']"),
    }


def test_report_rows(saved):
    doc = document(failures=[{"scenario": "S", "config": "c", "test_cases": [{"name": "a", "status": "fail", "history": [
        {"build": "1", "status": "pass", "duration": "1s"}, {"build": "2", "status": "fail", "duration": "1s", "current": True}]}]}],
        performance=[{"model": "M", "metrics": [{"name": "x", "unit": "u", "direction": "lower_better", "current": 234, "reference": 255.0,
                                                "history_values": [1, 2.5], "history_builds": ["1", "2"]}]}])
    reports = saved(doc)
    case = NE.report_cases(reports).first()
    assert (case["build"], case["scenario"], case["scenario_config"], case["name"], len(case["history"])) == ("1247", "S", "c", "a", 2)
    metric = NE.report_metrics(reports).first()
    assert (metric["model"], metric["current"], metric["history_values"]) == ("M", 234.0, [1.0, 2.5])


def test_merge_rules(spark):
    attrs = spark.createDataFrame([("7", "branch", "main", 0), ("7", "commit", "a", 1), ("7", "commit", "b", 2)], "build string, key string, value string, source_ord int")
    assert MG.attribute_map(MG.merge_attributes(attrs)).first()["attrs"] == {"branch": "main", "commit": "b"}
    badges = spark.createDataFrame([("7", "muted", 6, 0), ("7", "failed", 70, 0), ("7", "graphs", 2, 1), ("8", "muted", 1, 0)],
                                   "build string, key string, value long, source_ord int")
    cases = spark.createDataFrame([("7",), ("7",)], "build string")
    got = {(r["build"], r["key"]): r["value"] for r in MG.merge_badges(badges, cases).collect()}
    assert got == {("7", "muted"): 6, ("7", "graphs"): 2, ("7", "failed"): 2, ("8", "muted"): 1, ("8", "failed"): 0}
    with pytest.raises(ValueError):
        MG.union_sources({"a": None})


@pytest.fixture
def sources(spark):
    runs = spark.createDataFrame([
        run(1, "6", "t [PI-1]", "pass"), run(2, "7", "t [PI-1]", "fail", failure_msg="HTTP 403"), run(3, "7", "u", "pass"),
        run(4, "7", "v", "timeout", scenario="S2")], TEST_RUNS)
    other = spark.createDataFrame([run(1, "7", "w", "error")], TEST_RUNS)
    perf = spark.createDataFrame(perf_rows(builds=["5", "6", "7"]), PERFORMANCE_METRICS)
    return {"lab": Source(runs, perf, {"commit": "abc"}), "cloud": lambda: Source(runs=other), "empty": Source()}


def test_whole_report(spark, sources, tmp_path):
    tickets = spark.createDataFrame([("PI-1", "s", "Open", "Bug", "High", "u", 1, "403 again"), ("PI-2", "s", "Open", "Bug", "High", "u", 2, "http 403")],
                                    "key string, summary string, status string, type string, priority string, url string, updated long, text string")
    r = build_report(sources, Settings("7", "5", jira_base="J/"), {"branch": "main/{build}", "commit": "old"},
                     {"muted": 6, "failed": 70}, tickets)
    cases = {(c["source"], c["name"]): c for c in r.cases.collect()}
    assert set(cases) == {("lab", "t [PI-1]"), ("lab", "v"), ("cloud", "w")}
    assert [(t["key"], t["match"]) for t in cases[("lab", "t [PI-1]")]["jira_context"]] == [("PI-1", "direct"), ("PI-2", "related")]
    assert cases[("lab", "t [PI-1]")]["history_rate"] == "1 / 2 passed" and cases[("lab", "v")]["history_note"] == ""
    assert r.attrs == {"branch": "main/7", "commit": "abc", "number": "7"}
    assert r.gate.first()["gate"] == 2
    assert {b["key"]: b["value"] for b in r.badges.collect()} == {"muted": 6, "failed": 3}
    model = r.models.first()
    assert (model["source"], model["counts_display"], model["summary_chips_display"][0]["value"]) == ("lab", "1 / 1 improved", "21.0 kg")
    write_report(r, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out/failures"))
    assert {(g["source"], g["scenario"], len(g["test_cases"])) for g in back.collect()} == {("lab", "S", 1), ("lab", "S2", 1), ("cloud", "S", 1)}
    assert spark.read.json(str(tmp_path / "out/performance")).first()["metrics"][0]["current"] == 21.0


def test_analysis_of_a_report(spark, sources, tmp_path):
    def call(system, prompt):
        return '{"text": "%s"}' % ("with log" if "## Log\nseen" in prompt else "plain")

    r = build_report(sources, Settings("7", "5"))
    logs = spark.createDataFrame([("v.txt", " seen ")], "file string, text string")
    done = analyse(r, call, str(tmp_path / "scored"), "Agents.", logs, batches=2)
    assert {c["name"]: c["ai_analysis"]["text"] for c in done.cases.collect()} == {"t [PI-1]": "plain", "v": "with log", "w": "plain"}
    assert done.scenarios().count() == 3


def test_resolve():
    assert resolve({"a": ["{build}", 1], "b": {"c": "x/{build}"}, "d": None}, "7") == {"a": ["7", 1], "b": {"c": "x/7"}, "d": None}
    assert Settings("7", log_base="l/{build}/").log_base == "l/7/"


def test_lake_tables_round_trip(spark, sources, tmp_path):
    path = str(tmp_path / "runs")
    TB.write_lake(sources["lab"].runs, path, "test_runs")
    back = TB.read_lake(spark, path, "test_runs")
    assert back.schema["build"].dataType.simpleString() == "string" and back.count() == 4
    plan = back.filter(F.col("build") == "7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(build" in plan


def test_jdbc_options():
    o = TB.jdbc_options("clickhouse", "h", 8123, "ci", "test_runs", "u", "p", ("ran_at", "2024-01-01", "2024-02-01", 16))
    assert o["url"] == "jdbc:ch://h:8123/ci" and o["numPartitions"] == "16" and o["partitionColumn"] == "ran_at"
    assert TB.jdbc_options("mysql", "h", 3306, "ci", "test_runs")["driver"] == "com.mysql.cj.jdbc.Driver"
