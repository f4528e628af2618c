"""Metric windows, series and roll-ups."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from buildlens.operators import metrics as ME
from buildlens.schemas import PERFORMANCE_METRICS

DAY = dt.datetime(2031, 3, 2, 4, 5)
BUILDS = ["31", "33", "34", "38", "40", "47"]
WORSE = {
    ("Cache Hit Share", "%", "higher_better"): [90, 88, 85.5, 84, 81, 80],
    ("Deploy Minutes", "min", "lower_better"): [30, 30, 31, 32, 33, 34],
    ("Queue Depth", "jobs", "lower_better"): [5, 6, 8, 7, 9, 10],
}


def perf_rows(model="boiler", metric="Steam", unit="kg", direction="higher_better", builds=BUILDS, values=(12, 15, 21, 18, 24, 30), first=0):
    return [(first + i, b, model, metric, unit, direction, float(v), DAY + dt.timedelta(hours=7 * i))
            for i, (b, v) in enumerate(zip(builds, values))]


@pytest.fixture
def perf(spark):
    return lambda rows: spark.createDataFrame(rows, PERFORMANCE_METRICS)


def report(df, build="47", ref="38", limit=8):
    return {(r["model"], r["metric_name"]): r for r in ME.metric_report(df, build, ref, limit).collect()}


def test_a_model_that_gets_worse(perf):
    df = perf([r for (m, u, d), vs in WORSE.items() for r in perf_rows("plant", m, u, d, values=vs)])
    got = report(df)
    cache = got[("plant", "Cache Hit Share")]
    assert (cache["current"], cache["reference"], round(cache["delta_pct"], 4), cache["delta_css"]) == (80.0, 84.0, -4.7619, "neg")
    assert cache["sparkline_heights"] == [20, 18, 15, 13, 9, 8]
    assert got[("plant", "Queue Depth")]["delta_display"] == "▲ +42.9%"
    assert got[("plant", "Deploy Minutes")]["delta_display"] == "▲ +6.2%"
    model = ME.model_summary(ME.metric_report(df, "47", "38"), "38").first()
    assert (model["trend_label"], model["counts_display"], model["history_length"]) == ("▼ Regressed", "3 / 3 regressed", 6)
    assert [(c["label"], c["value"]) for c in model["summary_chips_display"]] == [("cache hit shar", "80.0 %"), ("deploy minutes", "34.0 min")]


def test_window_and_fallbacks(perf):
    steam = ("boiler", "Steam")
    got = report(perf(perf_rows()), limit=3)[steam]
    assert got["history_builds"] == ["38", "40", "47"] and got["history_values"] == [18.0, 24.0, 30.0]
    assert report(perf(perf_rows()), ref="9")[steam]["reference"] == 30.0
    assert report(perf(perf_rows()), build="9", ref="40")[steam]["current"] == 30.0
    # the reference build exists but lies outside the window
    assert report(perf(perf_rows()), ref="31", limit=3)[steam]["reference"] == 30.0


def test_gaps_become_zero_on_the_models_own_axis(perf):
    rows = perf_rows("a", "x", builds=["1", "2", "10"]) + perf_rows("a", "y", builds=["2"]) + perf_rows("b", "x", builds=["10"])
    got = report(perf(rows), build="10", ref="1")
    assert got[("a", "x")]["history_builds"] == ["1", "2", "10"]
    y = got[("a", "y")]
    assert (y["history_values"], y["filled"], y["current"]) == ([0.0, 12.0, 0.0], [True, False, True], 0.0)
    assert got[("b", "x")]["history_builds"] == ["10"]


def test_last_write_and_first_attributes(perf):
    rows = [(1, "5", "m", "x", "s", "higher_better", 1.0, DAY), (3, "5", "m", "x", "ms", "lower_better", 3.0, DAY + dt.timedelta(hours=1)),
            (2, "5", "m", "x", "ms", "lower_better", 2.0, DAY + dt.timedelta(hours=1))]
    got = report(perf(rows), build="5", ref="5")[("m", "x")]
    assert (got["current"], got["unit"], got["direction"]) == (3.0, "s", "higher_better")
    no_id = report(perf(rows).drop("id").filter("value <> 2"), build="5", ref="5")[("m", "x")]
    assert (no_id["current"], no_id["unit"]) == (3.0, "s")


def test_recent_is_by_time_and_window_by_number(perf):
    rows = [(1, "9", "m", "x", "s", "higher_better", 9.0, DAY + dt.timedelta(days=5)),
            (2, "10", "m", "x", "s", "higher_better", 10.0, DAY), (3, "8", "m", "x", "s", "higher_better", 8.0, DAY + dt.timedelta(days=9))]
    got = report(perf(rows), build="9", ref="8", limit=2)[("m", "x")]
    assert got["history_builds"] == ["8", "9"]


@pytest.mark.parametrize("builds, want", [
    (["1242", "1240", "99"], ["99", "1240", "1242"]), (["c", "a", "b"], ["a", "b", "c"]),
    (["10", "9", "x"], ["10", "9", "x"]), (["1.5", "10"], ["1.5", "10"])])
def test_build_order(spark, builds, want):
    df = spark.createDataFrame([(b,) for b in builds], "build string")
    assert [r["build"] for r in ME.build_order(df).orderBy("build_num", "build").collect()] == want


def test_each_model_has_its_own_order(perf):
    rows = [(1, "10", "A", "x", "s", "higher_better", 10.0, DAY), (2, "9", "A", "x", "s", "higher_better", 9.0, DAY),
            (3, "rc1", "B", "x", "s", "higher_better", 1.0, DAY), (4, "9", "B", "x", "s", "higher_better", 2.0, DAY)]
    got = report(perf(rows), build="none", ref="none")
    assert got[("A", "x")]["history_builds"] == ["9", "10"] and got[("A", "x")]["current"] == 10.0
    assert got[("B", "x")]["history_builds"] == ["9", "rc1"]


def test_a_later_write_wins_whatever_its_id(perf):
    rows = [(2**63 - 1, "1", "m", "x", "s", "higher_better", 1.0, DAY),
            (-(2**63), "1", "m", "x", "s", "higher_better", 2.0, DAY + dt.timedelta(microseconds=1))]
    assert ME.metric_cells(perf(rows)).first()["value"] == 2.0


def test_the_window_prunes_partitions(spark, perf, tmp_path):
    from buildlens.sources.tables import read_lake, write_lake
    rows = [(i, str(i), "m", "x", "s", "higher_better", float(i), DAY + dt.timedelta(days=i)) for i in range(12)]
    write_lake(perf(rows), str(tmp_path / "perf"), "performance_metrics")
    recent = ME.recent_rows(read_lake(spark, str(tmp_path / "perf"), "performance_metrics"), 2)
    assert sorted(r["build"] for r in recent.collect()) == ["10", "11"]
    scan = next(line for line in recent._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line)
    assert "PartitionFilters: [build#" in scan and " IN (" in scan


def test_empty(perf):
    assert report(perf([])) == {}


def test_wide_models_come_in_parts(perf):
    rows = [r for i in range(30) for r in perf_rows("wide", f"m{i:02d}", builds=["1", "2"], first=10 * i)] + perf_rows("small", "z")
    metrics = ME.metric_report(perf(rows), "2", "1", 9)
    parts = ME.model_rollup(metrics, list_size=5).collect()
    assert sorted(m["name"] for p in parts if p["model"] == "wide" for m in p["metrics"]) == [f"m{i:02d}" for i in range(30)]
    assert len([p for p in parts if p["model"] == "wide"]) > 1 and len([p for p in parts if p["model"] == "small"]) == 1


def test_cells_use_hash_aggregation_on_the_rows(perf):
    plan = ME.metric_cells(perf(perf_rows()))._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange")[-1]
    assert "HashAggregate" in below and "SortAggregate" not in below


def test_micros_do_not_depend_on_the_session_zone(spark, perf):
    from buildlens.functions.numbers import micros
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 1, 5),), (dt.datetime(1969, 12, 31, 23, 59, 59),)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = [r["m"] for r in df.select(micros(F.col("t")).alias("m")).collect()]
            assert got == [int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for t in (dt.datetime(2024, 3, 10, 2, 30, 1, 5), dt.datetime(1969, 12, 31, 23, 59, 59))]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_long_build_ids_keep_their_order(spark):
    ids = ["99999999999999999999", "100000000000000000000", "7", " 12 "]
    order = [r["build"] for r in ME.build_order(spark.createDataFrame([(i,) for i in ids], "build string")).orderBy("build_num").collect()]
    assert order == ["7", " 12 ", "99999999999999999999", "100000000000000000000"]


def test_the_window_of_a_lake_reads_no_measurement(spark, tmp_path):
    from buildlens.sources import tables as TB
    path = str(tmp_path / "perf")
    assert TB.read_build_times(spark, path) is None
    for builds in (["5", "6"], ["6", "7", "8"], ["4"]):
        TB.write_lake(spark.createDataFrame(perf_rows(builds=builds), PERFORMANCE_METRICS), path, "performance_metrics")
    perf, times = TB.read_lake(spark, path, "performance_metrics"), TB.read_build_times(spark, path)
    for limit in (1, 2, 8):
        assert ME.recent_builds(times, limit).collect() == ME.recent_builds(perf, limit).collect()
        assert sorted(map(str, ME.windowed_cells(perf, limit, times).collect())) == sorted(map(str, ME.windowed_cells(perf, limit).collect()))
    assert all(".build-times/" in f for f in ME.recent_builds(times).inputFiles())
