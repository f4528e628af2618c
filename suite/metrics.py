"""Metric windows, series, deltas, roll-ups."""

from pyspark.sql import functions as F

from buildlens.functions import text as X
from buildlens.functions import trends as D
from buildlens.functions.numbers import float_text
from buildlens.operators import metrics as ME
from suite.tables import BUILD, REF_BUILD, table, view, with_views

# Last eight builds by time, cells of these builds, dense series per model axis.
RECENT = """
recent AS (SELECT build, max(recorded_at) AS last_recorded FROM perf GROUP BY build
           ORDER BY last_recorded DESC, build DESC LIMIT 8),
kept AS (SELECT * FROM perf WHERE build IN (SELECT build FROM recent)),
cells AS (SELECT model, metric_name, build, arg_max(value, (recorded_at, id)) AS value FROM kept GROUP BY ALL),
attrs AS (SELECT model, metric_name, arg_min(unit, (recorded_at, id)) AS unit,
                 arg_min(direction, (recorded_at, id)) AS direction FROM kept GROUP BY ALL),
axis AS (SELECT model, build, cast(row_number() OVER (PARTITION BY model ORDER BY cast(build AS bigint)) - 1 AS integer) AS pos
         FROM (SELECT DISTINCT model, build FROM kept)),
series AS (SELECT a.model, a.metric_name, a.unit, a.direction, x.pos, x.build, coalesce(c.value, 0.0) AS value,
                  c.value IS NULL AS filled
           FROM attrs a JOIN axis x ON a.model = x.model
           LEFT JOIN cells c ON c.model = a.model AND c.metric_name = a.metric_name AND c.build = x.build)"""
DELTAS = RECENT + f""",
cr AS (SELECT model, metric_name, any_value(unit) AS unit, any_value(direction) AS direction,
              list(value ORDER BY pos) AS vals,
              coalesce(max(value) FILTER (build = '{BUILD}' AND NOT filled), arg_max(value, pos)) AS current,
              max(value) FILTER (build = '{REF_BUILD}' AND NOT filled) AS ref
       FROM series GROUP BY model, metric_name),
cur AS (SELECT * EXCLUDE (ref), coalesce(ref, current) AS reference FROM cr),
d AS (SELECT *, CASE WHEN reference = 0 THEN 0.0 ELSE (current - reference) / abs(reference) * 100 END AS delta_pct FROM cur),
m AS (SELECT *, CASE WHEN direction = 'lower_better'
                     THEN CASE WHEN delta_pct < -2 THEN 'improved' WHEN delta_pct > 2 THEN 'regressed' ELSE 'neutral' END
                     ELSE CASE WHEN delta_pct > 2 THEN 'improved' WHEN delta_pct < -2 THEN 'regressed' ELSE 'neutral' END
                END AS status FROM d),
t AS (SELECT model, count(*) FILTER (status = 'improved') AS improved_count,
             count(*) FILTER (status = 'regressed') AS regressed_count,
             count(*) FILTER (status = 'neutral') AS neutral_count, count(*) AS total_metrics FROM m GROUP BY model)"""
# A float as text the way a shortest round-trip printer writes it.
FLOAT = "CASE WHEN {c} = floor({c}) AND abs({c}) < 1e16 THEN printf('%d.0', cast({c} AS bigint)) ELSE cast({c} AS varchar) END"
DELTA_TEXT = """CASE WHEN {r} = 0 THEN '→ N/A' WHEN abs({p}) < 0.05 THEN '→ 0%'
    WHEN {p} > 0 THEN '▲ +' || printf('%.1f', {p}) || '%' ELSE '▼ ' || printf('%.1f', {p}) || '%' END"""


def _perf(spark, d):
    return view(spark, d, "perf")


def _cells(spark, d):
    return ME.windowed_cells(_perf(spark, d))


def _report(spark, d):
    return ME.metric_report(_perf(spark, d), BUILD, REF_BUILD)


def recent_builds(spark, d):
    return ME.recent_builds(_perf(spark, d))


def build_order(spark, d):
    """Customer numbers as all-numeric ids, and the same mixed with order states as text ids."""
    orders = table(spark, d, "orders")
    numeric = orders.select(F.col("o_custkey").cast("string").alias("build"))
    mixed = numeric.unionByName(orders.select(F.col("o_orderstatus").alias("build")))
    return (
        ME.build_order(numeric).withColumn("kind", F.lit("numeric"))
        .unionByName(ME.build_order(mixed).withColumn("kind", F.lit("mixed")))
        .withColumn("build_num", F.col("build_num").cast("bigint"))
        .orderBy("kind", "build_num", "build")
    )


def metric_cells(spark, d):
    return ME.metric_cells(_perf(spark, d)).select("model", "metric_name", "build", "value", "writes")


def build_axis(spark, d):
    axis = ME.build_axis(_cells(spark, d))
    return axis.select("model", F.posexplode("axis").alias("pos", "build"))


def metric_attrs(spark, d):
    return ME.metric_attrs(_cells(spark, d))


def metric_series(spark, d):
    s = ME.metric_series(_cells(spark, d))
    rows = s.select("model", "metric_name", F.posexplode(
        F.arrays_zip("history_builds", "history_values", "filled")).alias("pos", "p"))
    return rows.select("model", "metric_name", "pos", F.col("p.history_builds").alias("build"),
                       F.col("p.history_values").alias("value"), F.col("p.filled").alias("filled"))


def metric_current_ref(spark, d):
    s = ME.current_and_reference(ME.metric_series(_cells(spark, d)), BUILD, REF_BUILD)
    return s.select("model", "metric_name", "current", "reference")


def sparkline(spark, d):
    """Bars of the series, and of every customer's order totals in both directions."""
    series = _report(spark, d).select(
        F.concat_ws("/", "model", "metric_name").alias("series"), "direction", "history_values")
    totals = (table(spark, d, "orders").groupBy((F.col("o_custkey")).alias("k"))
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))),
                               lambda o: o["o_totalprice"]).alias("history_values")))
    both = totals.select(F.col("k").cast("string").alias("series"), F.explode(
        F.array(F.lit("higher_better"), F.lit("lower_better"))).alias("direction"), "history_values")
    rows = series.unionByName(both)
    bars = D.sparkline(F.col("history_values"), F.col("direction"))
    return rows.select("series", "direction", F.array_join(bars, ",").alias("bars"))


def metric_delta(spark, d):
    """Every order line: quantity against discount in percent (0 for some)."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("current"),
        (F.col("l_discount") * 100).alias("reference"),
        F.when(F.col("l_linestatus") == "O", "lower_better").otherwise("higher_better").alias("direction"))
    pct = D.delta_pct(F.col("current"), F.col("reference"))
    rows = lines.withColumn("delta_pct", pct)
    css = D.delta_class(F.col("delta_pct"), F.col("direction"))
    return rows.select("l_orderkey", "l_linenumber", F.round("delta_pct", 6).alias("delta_pct"),
                       D.delta_text(F.col("delta_pct"), F.col("reference")).alias("delta_display"),
                       css.alias("delta_css"), D.colour_class(css).alias("value_color"))


def metric_status(spark, d):
    return _report(spark, d).select("model", "metric_name", F.round("delta_pct", 6).alias("delta_pct"),
                                    "delta_display", "delta_css", "status", "value_color")


def unit_text(spark, d):
    return _perf(spark, d).select("id", D.unit_text(F.col("unit"), F.col("direction")).alias("unit_display"))


def model_trend(spark, d):
    s = ME.model_summary(_report(spark, d), REF_BUILD)
    return s.select("model", "improved_count", "neutral_count", "regressed_count", "total_metrics", "trend_class",
                    "trend_label", "counts_display", "summary_note", "history_length",
                    X.trend_label(F.col("trend_class")).alias("chip_class"))


def summary_chips(spark, d):
    chips = ME.summary_chips(_report(spark, d)).select("model", F.posexplode("summary_chips_display").alias("pos", "c"))
    return chips.select("model", "pos", "c.label", "c.value", "c.css_class")


def model_rollup(spark, d):
    m = ME.model_rollup(_report(spark, d))
    text = F.transform("metrics", lambda x: F.concat_ws(":", x["name"], float_text(x["current"]), float_text(x["reference"]), x["status"]))
    return m.select("model", "part", F.size("metrics").alias("n_metrics"), F.array_join(text, "|").alias("metrics"))


def model_parts(spark, d):
    """Metrics nested under their model in lists of two."""
    m = ME.model_rollup(_report(spark, d), 2)
    return m.select("model", "part", F.array_join("metrics.name", "|").alias("metrics"))


QUERIES = {
    "recent_builds": (recent_builds, with_views("perf", more=RECENT) + "SELECT build, last_recorded FROM recent"),
    "build_order": (build_order, """
        SELECT DISTINCT cast(o_custkey AS varchar) AS build, o_custkey AS build_num, 'numeric' AS kind FROM orders
        UNION ALL
        SELECT DISTINCT build, cast(NULL AS bigint), 'mixed' FROM
          (SELECT cast(o_custkey AS varchar) AS build FROM orders UNION ALL SELECT o_orderstatus FROM orders)"""),
    "metric_cells": (metric_cells, with_views("perf") + """
        SELECT model, metric_name, build, arg_max(value, (recorded_at, id)) AS value, count(*) AS writes
        FROM perf GROUP BY ALL"""),
    "build_axis": (build_axis, with_views("perf", more=RECENT) + "SELECT model, pos, build FROM axis"),
    "metric_attrs": (metric_attrs, with_views("perf", more=RECENT) + "SELECT * FROM attrs"),
    "metric_series": (metric_series, with_views("perf", more=RECENT) + """
        SELECT model, metric_name, pos, build, value, filled FROM series"""),
    "metric_current_ref": (metric_current_ref, with_views("perf", more=DELTAS) + """
        SELECT model, metric_name, current, reference FROM cur"""),
    "sparkline": (sparkline, with_views("perf", more=DELTAS) + """
        , s AS (SELECT model || '/' || metric_name AS series, direction, vals FROM m
                UNION ALL
                SELECT cast(o_custkey AS varchar), dir, list(o_totalprice ORDER BY o_orderkey)
                FROM orders, (VALUES ('higher_better'), ('lower_better')) t(dir) GROUP BY o_custkey, dir),
          r AS (SELECT series, direction, vals, list_min(vals) AS lo, list_max(vals) AS hi FROM s),
          u AS (SELECT series, direction, lo, hi, unnest(vals) AS v, generate_subscripts(vals, 1) AS i FROM r)
        SELECT series, direction, string_agg(CASE WHEN lo = hi THEN '20' ELSE printf('%.0f', 8 +
                 (CASE WHEN direction = 'lower_better' THEN hi - v ELSE v - lo END) / (hi - lo) * 12) END, ',' ORDER BY i) AS bars
        FROM u GROUP BY series, direction"""),
    "metric_delta": (metric_delta, f"""
        WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS c, l_discount * 100 AS r, l_linestatus = 'O' AS lower FROM lineitem),
        b AS (SELECT *, CASE WHEN r = 0 THEN 0.0 ELSE (c - r) / abs(r) * 100 END AS p FROM a),
        k AS (SELECT *, CASE WHEN (lower AND p < -2) OR (NOT lower AND p > 2) THEN 'pos'
                             WHEN (lower AND p > 2) OR (NOT lower AND p < -2) THEN 'neg' ELSE 'neu' END AS delta_css FROM b)
        SELECT l_orderkey, l_linenumber, round(p, 6) + 0.0 AS delta_pct, {DELTA_TEXT.format(r='r', p='p')} AS delta_display, delta_css,
               CASE delta_css WHEN 'pos' THEN 'green' WHEN 'neg' THEN 'red' ELSE '' END AS value_color FROM k"""),
    "metric_status": (metric_status, with_views("perf", more=DELTAS) + f"""
        SELECT model, metric_name, round(delta_pct, 6) AS delta_pct, {DELTA_TEXT.format(r='reference', p='delta_pct')} AS delta_display,
               CASE status WHEN 'improved' THEN 'pos' WHEN 'regressed' THEN 'neg' ELSE 'neu' END AS delta_css, status,
               CASE status WHEN 'improved' THEN 'green' WHEN 'regressed' THEN 'red' ELSE '' END AS value_color FROM m"""),
    "unit_text": (unit_text, with_views("perf") + """
        SELECT id, CASE direction WHEN 'lower_better' THEN unit || ' · ↓ lower better · bars inv.'
                                  ELSE unit || ' · ↑ higher better' END AS unit_display FROM perf"""),
    "model_trend": (model_trend, with_views("perf", more=DELTAS) + f"""
        SELECT t.model, improved_count, neutral_count, regressed_count, total_metrics,
               CASE WHEN improved_count > regressed_count THEN 'good' WHEN regressed_count > improved_count THEN 'bad' ELSE 'neu' END AS trend_class,
               CASE trend_class WHEN 'good' THEN '▲ Improved' WHEN 'bad' THEN '▼ Regressed' ELSE '→ Neutral' END AS trend_label,
               CASE trend_class WHEN 'good' THEN improved_count || ' / ' || total_metrics || ' improved'
                                WHEN 'bad' THEN regressed_count || ' / ' || total_metrics || ' regressed'
                                ELSE neutral_count || ' / ' || total_metrics || ' stable' END AS counts_display,
               CASE trend_class WHEN 'good' THEN 'All metrics at best in recent window'
                                WHEN 'bad' THEN 'Performance regression — investigation recommended'
                                ELSE 'All metrics stable vs ref build #{REF_BUILD}' END AS summary_note,
               (SELECT cast(count(*) AS integer) FROM axis WHERE axis.model = t.model) AS history_length,
               CASE trend_class WHEN 'good' THEN 'up' WHEN 'bad' THEN 'down' ELSE 'neu' END AS chip_class
        FROM t"""),
    "summary_chips": (summary_chips, with_views("perf", more=DELTAS) + f"""
        SELECT model, cast(rn - 1 AS integer) AS pos, left(lower(metric_name), 14) AS label,
               {FLOAT.format(c='current')} || ' ' || unit AS value,
               CASE status WHEN 'improved' THEN 'green' WHEN 'regressed' THEN 'red' ELSE '' END AS css_class
        FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY metric_name) AS rn FROM m) WHERE rn <= 2"""),
    "model_parts": (model_parts, with_views("perf", more=DELTAS) + """
        SELECT model, part, string_agg(metric_name, '|' ORDER BY metric_name) AS metrics
        FROM (SELECT model, metric_name, cast((row_number() OVER (PARTITION BY model ORDER BY metric_name) - 1) // 2 AS integer) AS part FROM m)
        GROUP BY model, part"""),
    "model_rollup": (model_rollup, with_views("perf", more=DELTAS) + f"""
        SELECT model, 0 AS part, cast(count(*) AS integer) AS n_metrics,
               string_agg(metric_name || ':' || {FLOAT.format(c='current')} || ':' || {FLOAT.format(c='reference')} || ':' || status,
                          '|' ORDER BY metric_name) AS metrics
        FROM m GROUP BY model"""),
}
