"""Fetch statistics, log ingest, timing spans."""

import random

import pytest
from pyspark.sql import functions as F

from buildlens.operators import logs as LG
from buildlens.operators import merge as MG
from buildlens.schemas import FETCH_LOG
from buildlens.sources import logs as LF
from buildlens.sources.documents import ingest_logs, read_texts


def fetch(key, ok=True, s=0.1, size=100, cached=False, connect=0.05, transfer=0.05):
    return (key, f"http://x/{key}", ok, f"/l/{key}.log" if ok else "", size, s, connect, transfer, cached, "" if ok else "boom")


@pytest.fixture
def fetches(spark):
    return lambda rows: spark.createDataFrame(rows, FETCH_LOG).withColumn("source", F.lit("s"))


def summary(df, wall):
    return LG.fetch_summary(df, ["source"], F.lit(wall)).first()


def test_counts_and_rates(fetches):
    st = summary(fetches([fetch("a", s=0.5, size=500), fetch("b", s=0.5, size=500), fetch("c", ok=False), fetch("d", cached=True, size=999, s=0.0)]), 0.5)
    assert (st["count"], st["ok"], st["failed"], st["cached"]) == (4, 3, 1, 1)
    assert (st["sum_s"], st["speedup"], st["bytes_total"], st["throughput_mb_s"]) == (1.0, 2.0, 1000, 0.0)
    assert (st["connect_sum_s"], st["transfer_sum_s"]) == (0.1, 0.1)
    none = LG.fetch_summary(fetches([]), [], F.lit(0.0)).first()
    assert (none["count"], none["sum_s"], none["speedup"], none["bytes_total"]) == (0, 0.0, 0.0, 0)


def test_slowest(fetches):
    df = fetches([fetch("a", s=0.1), fetch("b", s=0.9), fetch("c", s=0.5), fetch("d", s=9.0, cached=True), fetch("e", s=9.0, ok=False)])
    assert [r["key"] for r in LG.slowest_files(df).collect()] == ["b", "c", "a"]
    assert [r["key"] for r in LG.slowest_by(df, ["source"], 2).orderBy("rn").collect()] == ["b", "c"]


def test_percentiles_of_worked_groups(spark):
    """Of the 2001 values 0.0, 0.5, ..., 1000.0 rank 1000 is 500.0 and rank 1900 is 950.0."""
    groups = {"hot": [i / 2 for i in range(2001)], "one": [0.3], "same": [2.5] * 77,
              "neg": [7.125, -1.5, 3.0, -0.25, 0.0, 3.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: [r["min"], r["p50"], r["p95"], r["max"], r["mean"]] for r in LG.nearest_rank(df, ["g"], "v").collect()}
    assert got == {"hot": [0.0, 500.0, 950.0, 1000.0, 500.0], "one": [0.3] * 5, "same": [2.5] * 5,
                   "neg": [-1.5, 0.0, 7.125, 7.125, 1.896]}


def test_percentiles_of_a_group_without_downloads(fetches):
    r = LG.fetch_percentiles(fetches([fetch("a", ok=False)]), ["source"]).first()
    assert tuple(r)[1:] == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_percentiles_of_any_values(spark):
    """A million values within one second in one group, signs, zeros, huge and tiny values, and the NULL group."""
    odd = [-1e300, -2.5, -1e-300, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0, 3e12, 1e300]
    df = spark.range(1_000_000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise("hot").alias("g"),
                                       ((F.col("id") * 7919) % 1_000_000 / 1_000_000).alias("v"))
    df = df.unionByName(spark.createDataFrame([("odd", v) for v in odd], "g string, v double"))
    got = {r["g"]: (r["n"], r["min"], r["p50"], r["p95"], r["max"]) for r in LG.nearest_rank(df, ["g"], "v").collect()}
    values = {True: [], False: []}
    for i in range(1_000_000):
        values[i % 10 == 0].append(i * 7919 % 1_000_000 / 1_000_000)
    for g, vs in ((None, sorted(values[True])), ("hot", sorted(values[False]))):
        n = len(vs)
        assert got[g] == (n, *[round(v, 3) for v in (vs[0], vs[round(0.5 * (n - 1))], vs[round(0.95 * (n - 1))], vs[-1])])
    assert got["odd"] == (11, -1e300, 0.0, 1e300, 1e300)


def test_null_group_and_long_seconds(fetches):
    df = fetches([fetch("a", s=2e12), fetch("b", s=1.0)]).withColumn("source", F.lit(None).cast("string"))
    r = LG.fetch_percentiles(df, ["source"]).first()
    assert tuple(r) == (None, 2, 1.0, 1.0, 2e12, 2e12, 1000000000000.5) or tuple(r)[:3] == (None, 2, 1.0) and r["max"] == 2e12
    assert LG.fetch_summary(df, ["source"], F.lit(1.0)).first()["sum_s"] == 2e12 + 1


def test_attach_and_candidates(spark, fetches):
    cases = spark.createDataFrame([("a", "", None), ("b x", "P-1", None), ("c", "P-1", None), ("d", "", "given.log"), ("e", None, None)],
                                  "name string, jira string, log_file string")
    got = {r["name"]: r["log_file"] for r in LG.attach_logs(cases.drop("log_file"), fetches([fetch("a"), fetch("c", ok=False)])).collect()}
    assert got == {"a": "/l/a.log", "b x": None, "c": None, "d": None, "e": None}
    files = spark.createDataFrame([("b_x.txt",), ("P-1.log",), ("a.txt",), ("b_x.log",), ("d.log",)], "file string")
    picked = {r["name"]: r["picked"] for r in LG.pick_log(cases, files).collect()}
    # a file attached to the case is the only candidate, found or not
    assert picked == {"a": "a.txt", "b x": "b_x.log", "c": "P-1.log", "d": None, "e": None}


def test_ingest_skips_stored_files_and_keeps_the_tail(spark, tmp_path):
    for name, text in {"a": "0123456789", "b": "old", "c": "not wanted"}.items():
        (tmp_path / f"{name}.log").write_text(text)
    jobs = spark.createDataFrame([("a", "u"), ("b", "u"), ("z", "u")], "key string, url string")
    stored = spark.createDataFrame([("b",)], "key string")
    got = ingest_logs(spark, str(tmp_path), jobs, stored, tail_bytes=4).collect()
    assert [(r["key"], r["bytes"], r["log_text"]) for r in got] == [("a", 4, "6789")]
    assert {r["key"] for r in LG.cached_logs(jobs, stored).collect()} == {"b"}
    assert {r["key"] for r in LG.pending_logs(jobs, stored).collect()} == {"a", "z"}


def test_texts(spark, tmp_path):
    (tmp_path / "context.txt").write_text("\n  four\nlines \n")
    row = read_texts(spark, str(tmp_path / "context.txt"), max_chars=6).first()
    assert (row["file"], row["text"]) == ("context.txt", "four\nl\n… (truncated)")


def test_spans(spark, one):
    df = spark.createDataFrame([("m", "connect", 0.055), ("m", "query", 0.82), ("c", "b", 1.0), ("c", "a", 1.0)], "source string, span string, seconds double")
    assert {r["source"]: (r["span"], r["seconds"]) for r in MG.slowest_span(df).collect()} == {"m": ("query", 0.82), "c": ("a", 1.0)}
    assert {r["source"]: r["spans"] for r in MG.spans_by_source(df).collect()}["m"] == {"connect": 0.055, "query": 0.82}
    assert one(MG.span_gain, "b double, a double", (0.82, 0.095), (0.0, 1.0), (1.0, 1.004)) == ["88% faster", "n/a", "-0% faster"]


def record(df):
    return {r["key"]: (r["ok"], r["cached"], r["bytes"], r["error"] != "") for r in df.collect()}


def test_ingest_opens_only_what_is_asked_for_and_only_its_end(spark, tmp_path):
    logs, kept = tmp_path / "logs", str(tmp_path / "kept")
    (logs / "deep").mkdir(parents=True)
    for key, text in {"a": "0123456789", "b b": "é" * 5, "d%41": "x"}.items():
        (logs / "deep" / f"{key}.log").write_text(text)
    # three gigabytes each, all holes: reading one whole would not fit a row
    for key in ("huge", "unasked"):
        with open(logs / f"{key}.log", "wb") as f:
            f.truncate(3 << 30)
    with open(logs / "huge.log", "r+b") as f:
        f.seek(0, 2)
        f.write(b"the end")
    listed = LF.list_logs(spark, str(logs), "*.log")
    assert {r["key"]: r["length"] for r in listed.collect()} == {"a": 10, "b b": 10, "d%41": 1, "huge": (3 << 30) + 7, "unasked": 3 << 30}
    jobs = spark.createDataFrame([("a", "u1"), ("b b", "u2"), ("huge", "u3"), ("gone", "u4"), ("d%41", "u5"), ("a", "u6")], "key string, url string")
    got = LF.ingest(spark, jobs.filter("key <> 'a'"), listed, kept, tail_bytes=7)
    assert record(got) == {"b b": (True, False, 7, False), "huge": (True, False, 7, False), "gone": (False, False, 0, True), "d%41": (True, False, 1, False)}
    texts = {r["path"].split("/")[-1]: r["text"] for r in LF.log_text(LF.read_stored(spark, kept)).collect()}
    assert texts == {"b b.log": "�" + "é" * 3, "huge.log": "the end", "d%41.log": "x"}
    again = LF.ingest(spark, jobs, listed, kept, tail_bytes=7, max_bytes=3)
    assert again.dtypes == spark.createDataFrame([], FETCH_LOG).dtypes
    assert again.count() == 6
    assert record(again) == {"a": (True, False, 3, False), "b b": (True, True, 0, False), "huge": (True, True, 0, False), "gone": (False, False, 0, True),
                             "d%41": (True, True, 0, False)}
    assert LF.read_stored(spark, str(tmp_path / "nothing")).count() == 0


def test_an_unreadable_file_is_a_record(spark, tmp_path):
    listed = spark.createDataFrame([("a", f"file:{tmp_path}/went.log", 5), ("b", "nostore://x/y", 5)], "key string, path string, length long")
    got = LF.ingest(spark, spark.createDataFrame([("a", "u"), ("b", "v")], "key string, url string"), listed, str(tmp_path / "kept"))
    assert record(got) == {"a": (False, False, 0, True), "b": (False, False, 0, True)}


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"key=k{i}").mkdir()
        (tmp_path / f"key=k{i}" / "part.log").write_text("x" * (i + 1))
    spread, context = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    given = spark.conf.get(spread)
    context.setJobGroup("listing", "")
    try:
        listed = LF.list_logs(spark, str(tmp_path), "*.log", by_folder="key")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= LF.LISTING_TASKS * context.defaultParallelism < 60
    assert spark.conf.get(spread) == given
    assert {(r.key, r.length) for r in listed.collect()} == {(f"k{i}", i + 1) for i in range(60)}


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.log").write_text("x")
    plan = LF.list_logs(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_files_are_dealt_evenly(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.log").write_bytes(b"x" * (1000 if i % 10 == 0 else 10 + i))
    files = LF.list_logs(spark, str(tmp_path)).withColumn("url", F.lit("u"))
    read = LF.read_tails(files, task_bytes=700).withColumn("task", F.spark_partition_id())
    sums = [r["n"] for r in read.groupBy("task").agg(F.sum("bytes").alias("n")).collect()]
    assert len(sums) == 8 and max(sums) <= 1000 + 200


def test_every_link_of_a_name_is_fetched_and_attached(spark, tmp_path):
    cases = spark.createDataFrame(
        [("s", "c1", "n", "l/1"), ("s", "c2", "n", "l/2"), ("s", "c2", "n", "l/2"), ("s", "c2", "n", "l/3"), ("s", None, "n", "l/4"), ("s", "c1", "m", "#"), ("s", "c1", "o", None)],
        "scenario string, config string, name string, log_url string")
    requests = LG.log_requests(cases)
    assert requests.count() == 4 and requests.select("key").distinct().count() == 4
    records = requests.select("key", "url", (F.col("url") != "l/3").alias("ok"), F.concat(F.lit("/kept/"), "url").alias("path"))
    got = sorted((str(r["config"]), r["name"], str(r["log_url"]), r["log_file"]) for r in LG.attach_fetched(cases, requests, records).collect())
    assert got == sorted([("c1", "n", "l/1", "/kept/l/1"), ("c2", "n", "l/2", "/kept/l/2"), ("c2", "n", "l/2", "/kept/l/2"), ("c2", "n", "l/3", None),
                          ("None", "n", "l/4", "/kept/l/4"), ("c1", "m", "#", None), ("c1", "o", "None", None)])


def test_attached_paths_and_nameless_tickets(spark):
    cases = spark.createDataFrame([("a", "", "/kept/x/a.log"), ("b", "", "/kept/gone.log"), ("c", None, None), ("d", "", None), ("e", "T-1", None)],
                                  "name string, jira string, log_file string")
    files = spark.createDataFrame([("/kept/x/a.log", "a.log"), ("/l/.log", ".log"), ("/l/d.log", "d.log"), ("/l/e.txt", "e.txt"), ("/l/b.log", "b.log")], "path string, file string")
    picked = {r["name"]: r["picked"] for r in LG.pick_log(cases, files).collect()}
    assert picked == {"a": "/kept/x/a.log", "b": None, "c": ".log", "d": "d.log", "e": "e.txt"}
    many = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("").alias("jira"), F.lit(None).cast("string").alias("log_file"))
    assert LG.log_candidates(many).groupBy("file").count().agg(F.max("count")).first()[0] == 1
    assert {r["picked"] for r in LG.pick_log(many, files).collect()} == {".log"}
