"""Saved states of a report, and what a run says about its sources."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from buildlens.operators import nesting as NE
from buildlens.plans import saved
from buildlens.plans.report import Settings, Source, analyse, build_report
from buildlens.schemas import REPORT, TEST_RUNS
from test_failures import run


@pytest.fixture
def report(spark):
    runs = spark.createDataFrame([run(1, "6", "t", "pass"), run(2, "7", "t", "fail"), run(3, "7", "v", "timeout", scenario="S2"), run(4, "7", "", "fail", scenario="S0")], TEST_RUNS)
    ready = spark.createDataFrame([("S", "c", "own", "odd", "m1"), ("S", "c", "own", "fail", "m2")], "scenario string, config string, name string, status string, failure_message string")
    metrics = spark.createDataFrame([("M", "speed", "u", "higher_better", 3.0, 2.0, [2.0, 3.0], ["6", "7"]), ("M", "size", "u", "up", 1.0, 1.0, [1.0], ["7"])],
                                    "model string, metric_name string, unit string, direction string, current double, reference double, history_values array<double>, history_builds array<string>")

    def broken():
        raise KeyError("password")

    late = spark.range(3).select(F.raise_error(F.lit("table is gone")).cast("string").alias("scenario"))
    sources = {"lab": Source(runs, None, {"commit": "abc"}, spans={"query": 1.5}), "bad": broken, "late": Source(cases=late), "own": Source(cases=ready, metrics=metrics),
               "nothing": lambda: None, "empty": Source(runs.limit(0))}
    return build_report(sources, Settings("7"), {"branch": "main"}, {"passed": 4})


def test_sources_are_kept_apart(spark, report):
    rows = {r["source"]: r for r in report.sources.collect()}
    assert {n: (r["ok"], r["n_cases"], r["n_models"], r["n_violations"]) for n, r in rows.items()} == {
        "lab": (True, 3, 0, 1), "bad": (False, 0, 0, 0), "late": (False, 0, 0, 0), "own": (True, 2, 1, 2), "nothing": (True, 0, 0, 0), "empty": (True, 0, 0, 0)}
    assert "KeyError" in rows["bad"]["error"] and "table is gone" in rows["late"]["error"] and rows["lab"]["error"] is None
    assert sorted((c["source"], c["name"], c["history_rate"] is not None) for c in report.cases.collect()) == [
        ("lab", "", True), ("lab", "t", True), ("lab", "v", True), ("own", "own", True), ("own", "own", True)]
    assert report.gate.first()["gate"] == 2 and report.attrs == {"branch": "main", "commit": "abc", "number": "7"}
    assert {(r["source"], r["span"]) for r in report.spans.collect()} >= {("lab", "query"), ("lab", "total_s"), ("bad", "total_s")}
    assert {r["metric_name"]: r["status"] for r in report.metrics.collect()}["speed"] == "improved"


def test_violations_of_a_run_name_their_place(report):
    # lab: S, S0 and S2 in this order; own: S after them, whose two cases have the same name
    found = {(v["location"], v["message"]) for v in report.violations.collect()}
    assert {v[0] for v in found} - {"failures[3].test_cases[0]", "failures[3].test_cases[1]"} == {"failures[1].test_cases[0]", "performance[0].metrics[0]"}
    assert sorted(v[1].split(" — ")[0] for v in found) == ["invalid direction 'up'", "missing 'name' field", "unknown status 'odd'"]


def test_a_report_without_runs_passes_the_gate(spark):
    report = build_report({"nothing": lambda: None}, Settings("7"), {}, {"passed": 1})
    assert report.gate.first()["gate"] == 0 and report.cases is None
    assert {b["key"]: b["value"] for b in report.badges.collect()} == {"passed": 1, "failed": 0}
    assert report.violations.count() == 0
    assert [v["location"] for v in build_report({}, Settings(" ")).violations.collect()] == ["build"]


def test_states_are_saved_and_read(spark, report, tmp_path):
    path = str(tmp_path / "r")
    assert saved.save(report, path, "collected") == 1
    first = saved.load(spark, path)
    assert first.attrs == report.attrs and first.timings == report.timings and first.build == "7"
    for name in saved.SECTIONS:
        a, b = getattr(report, name), getattr(first, name)
        assert a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name
    scored = analyse(first, lambda system, prompt: '{"text": "seen"}', str(tmp_path / "kept"))
    assert saved.save(scored, path, "analysed", changed=("cases",)) == 2
    one, two = (json.loads((Path(path) / f"manifests/00000{i}.json").read_text()) for i in (1, 2))
    assert [n for n in saved.SECTIONS if one["sections"][n] != two["sections"][n]] == ["cases"]
    assert {c["ai_analysis"]["text"] for c in saved.load(spark, path).cases.collect()} == {"seen"}
    assert {c["ai_analysis"]["text"] for c in saved.load(spark, path, 1).cases.collect()} == {None}
    assert saved.load(spark, path).timings.keys() >= {"collection_s", "ai_s"}


def test_a_save_that_stops_leaves_the_state_before(spark, report, tmp_path, monkeypatch):
    from dataclasses import replace
    path = str(tmp_path / "r")
    saved.save(report, path, "collected")
    bad = replace(report, spans=spark.range(1).select(F.raise_error(F.lit("disk")).alias("x")))
    with pytest.raises(Exception, match="disk"):
        saved.save(bad, path, "collected")
    assert saved.load(spark, path).cases.count() == 5
    monkeypatch.setattr(saved, "_states", lambda spark, path: [])
    with pytest.raises(Exception, match="exist"):
        saved.save(report, path, "collected")
    monkeypatch.undo()
    with pytest.raises(FileNotFoundError):
        saved.load(spark, str(tmp_path / "none"))


def test_document_in_pieces(spark, report, monkeypatch):
    document = saved.document(report)
    assert [(f.name, f.dataType) for f in document.schema][1:] == [(f.name, f.dataType) for f in REPORT]
    rows = document.orderBy("piece").collect()
    assert [[s["scenario"] for s in r["failures"]] + [m["model"] for m in r["performance"]] for r in rows] == [["S"], ["S0"], ["S2"], ["S"], ["M"]]
    assert {(r["build"]["number"], r["build"]["commit"], str(r["build"]["badges"])) for r in rows} == {("7", "abc", "{'passed': 4, 'failed': 5}")}
    assert sorted(c["name"] for c in NE.report_cases(document).collect()) == ["", "own", "own", "t", "v"]
    assert saved.document(build_report({}, Settings("9"))).select("build.number", "build.badges.failed").first() == ("9", 0)
