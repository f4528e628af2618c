"""Log ingest, fetch statistics, timing spans."""

from pyspark.sql import functions as F

from buildlens.functions.numbers import micros
from buildlens.functions.text import safe_name
from buildlens.operators import failures as FA
from buildlens.operators import logs as LG
from buildlens.operators import merge as MG
from suite.tables import table, view, with_views

SAFE = "regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g')"
DL = "ok AND NOT cached"


def _wall():
    return (micros(F.max("ts")) - micros(F.min("ts"))) / 1e6


def _log_records(spark, d):
    """Fetch log keyed by case name, one record per event."""
    runs, fetches = view(spark, d, "runs"), view(spark, d, "fetches")
    return runs.select("id", "name").join(fetches, "id").select(F.col("name").alias("key"), "ok", "path")


def log_attach(spark, d):
    runs = view(spark, d, "runs").select("id", "name")
    return LG.attach_logs(runs, _log_records(spark, d))


def log_pending(spark, d):
    """Files of linkable runs; those of events seen as views are stored already."""
    jobs = LG.log_jobs(FA.linkable(view(spark, d, "runs")))
    stored = table(spark, d, "events").filter((F.col("event_type") == "view") & (F.col("value") > 150)).select(
        safe_name(F.concat(F.lit("case "), F.col("user_id").cast("string"), F.lit(" [PIPE-"), F.col("user_id").cast("string"), F.lit("]"))).alias("key"))
    pending = LG.pending_logs(jobs, stored).withColumn("cached", F.lit(False))
    return pending.unionByName(LG.cached_logs(jobs, stored)).select("key", "url", "cached")


def log_candidate(spark, d):
    runs = view(spark, d, "runs")
    name, user = safe_name(F.col("name")), F.regexp_extract("name", r"(\d+)", 1)
    attached = F.when(F.col("id") % 5 == 0, F.concat(F.lit("kept-"), F.col("id").cast("string")))
    kind = user.cast("int") % 4
    file = (F.when(kind == 0, F.concat("jira", F.lit(".log"))).when(kind == 1, F.concat(name, F.lit(".log")))
            .when(kind == 2, F.concat(name, F.lit(".txt"))).otherwise(F.lit(".log")))
    files = runs.select(file.alias("file")).unionByName(runs.filter(F.col("duration_s") < 50).select(attached.alias("file"))).filter("file IS NOT NULL")
    cases = runs.select("id", "name", "jira", attached.alias("log_file"))
    return LG.pick_log(cases, files).select("id", "picked")


def fetch_summary(spark, d):
    return LG.fetch_summary(view(spark, d, "fetches"), ["source"], _wall(), F.lit(8))


def fetch_percentiles(spark, d):
    return LG.fetch_percentiles(view(spark, d, "fetches"), ["source"])


def slowest_files(spark, d):
    return LG.slowest_files(view(spark, d, "fetches"))


def span_bottleneck(spark, d):
    return MG.slowest_span(view(spark, d, "spans"))


def span_gain(spark, d):
    def total(phase):
        kept = F.when(F.col("phase") == phase, F.col("seconds").cast("decimal(18,2)"))
        return F.coalesce(F.sum(kept), F.lit(0)).cast("double").alias(phase)

    spans = view(spark, d, "spans").groupBy("source", "span").agg(total("before"), total("after"))
    return spans.select("source", "span", "before", "after", MG.span_gain(F.col("before"), F.col("after")).alias("gain"))


def spans_by_source(spark, d):
    rows = MG.spans_by_source(view(spark, d, "spans")).select("source", F.explode("spans").alias("span", "seconds"))
    return rows


QUERIES = {
    "log_attach": (log_attach, with_views("runs", "fetches", more="""
        p AS (SELECT name, max(path) AS log_file FROM runs JOIN fetches ON runs.id = fetches.id WHERE ok GROUP BY name)""") + """
        SELECT runs.id, runs.name, p.log_file FROM runs LEFT JOIN p ON p.name = runs.name"""),
    "log_pending": (log_pending, with_views("runs", more=f"""
        jobs AS (SELECT {SAFE} AS key, max(log_url) AS url FROM runs WHERE log_url NOT IN ('', '#') GROUP BY 1),
        stored AS (SELECT DISTINCT 'case_' || user_id || '__PIPE-' || user_id || '_' AS key FROM events
                   WHERE event_type = 'view' AND value > 150)""") + """
        SELECT key, url, key IN (SELECT key FROM stored) AS cached FROM jobs"""),
    "log_candidate": (log_candidate, with_views("runs", more=f"""
        f AS (SELECT DISTINCT CASE cast(regexp_extract(name, '([0-9]+)', 1) AS integer) % 4 WHEN 0 THEN jira || '.log' WHEN 1 THEN {SAFE} || '.log'
                              WHEN 2 THEN {SAFE} || '.txt' ELSE '.log' END AS file FROM runs
              UNION SELECT 'kept-' || id FROM runs WHERE duration_s < 50 AND id % 5 = 0)""") + f"""
        SELECT id, CASE WHEN id % 5 = 0 THEN CASE WHEN 'kept-' || id IN (SELECT file FROM f WHERE file IS NOT NULL) THEN 'kept-' || id END
                        WHEN {SAFE} || '.log' IN (SELECT file FROM f WHERE file IS NOT NULL) THEN {SAFE} || '.log'
                        WHEN coalesce(jira, '') || '.log' IN (SELECT file FROM f WHERE file IS NOT NULL) THEN coalesce(jira, '') || '.log'
                        WHEN {SAFE} || '.txt' IN (SELECT file FROM f WHERE file IS NOT NULL) THEN {SAFE} || '.txt' END AS picked
        FROM runs"""),
    "fetch_summary": (fetch_summary, with_views("fetches", more=f"""
        a AS (SELECT source, count(*) AS count, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed,
                     count(*) FILTER (cached) AS cached, 8 AS workers,
                     cast(printf('%.3f', (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS double) AS wall_s,
                     cast(sum(cast(s AS decimal(18,6))) FILTER ({DL}) AS double) AS sum_s,
                     cast(sum(bytes) FILTER ({DL}) AS bigint) AS bytes_total,
                     cast(sum(cast(connect_s AS decimal(18,6))) FILTER ({DL}) AS double) AS connect_sum_s,
                     cast(sum(cast(transfer_s AS decimal(18,6))) FILTER ({DL}) AS double) AS transfer_sum_s
              FROM fetches GROUP BY source)""") + """
        SELECT *, cast(printf('%.2f', sum_s / wall_s) AS double) AS speedup,
               cast(printf('%.2f', bytes_total / 1e6 / wall_s) AS double) AS throughput_mb_s FROM a"""),
    "fetch_percentiles": (fetch_percentiles, with_views("fetches", more=f"""
        r AS (SELECT source, s, row_number() OVER (PARTITION BY source ORDER BY s) - 1 AS i,
                     count(*) OVER (PARTITION BY source) AS n FROM fetches WHERE {DL})""") + """
        SELECT source, n, min(s) AS min,
               max(s) FILTER (i = cast(printf('%.0f', 0.5 * (n - 1)) AS bigint)) AS p50,
               max(s) FILTER (i = cast(printf('%.0f', 0.95 * (n - 1)) AS bigint)) AS p95,
               max(s) AS max, cast(printf('%.3f', cast(sum(cast(s AS decimal(18,6))) AS double) / n) AS double) AS mean
        FROM r GROUP BY source, n"""),
    "slowest_files": (slowest_files, with_views("fetches") + f"""
        SELECT key, s, bytes FROM fetches WHERE {DL} ORDER BY s DESC, id LIMIT 5"""),
    "span_bottleneck": (span_bottleneck, with_views("spans") + """
        SELECT source, span, seconds FROM (SELECT source, span, max(seconds) AS seconds,
            row_number() OVER (PARTITION BY source ORDER BY max(seconds) DESC, span) AS rn FROM spans GROUP BY source, span) WHERE rn = 1"""),
    "span_gain": (span_gain, with_views("spans", more="""
        t AS (SELECT source, span, cast(coalesce(sum(cast(seconds AS decimal(18,2))) FILTER (phase = 'before'), 0) AS double) AS before,
                     cast(coalesce(sum(cast(seconds AS decimal(18,2))) FILTER (phase = 'after'), 0) AS double) AS after
              FROM spans GROUP BY source, span)""") + """
        SELECT *, CASE WHEN before = 0 THEN 'n/a' ELSE printf('%.0f', (before - after) / before * 100) || '% faster' END AS gain FROM t"""),
    "spans_by_source": (spans_by_source, with_views("spans") + """
        SELECT source, span, max(seconds) AS seconds FROM spans GROUP BY source, span"""),
}
