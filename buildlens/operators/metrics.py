"""Metric series over a shared window of recent builds, deltas and model roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions import trends as D
from buildlens.functions.numbers import micros
from buildlens.operators.sizing import LIST_SIZE, cut_lineage, join_unique, with_part

_WHOLE = r"^\s*[+-]?\p{Nd}+\s*$"


def _number(build: Column) -> Column:
    return F.when(build.rlike(_WHOLE), F.btrim(build)).try_cast("decimal(38,0)")


def build_order(builds: DataFrame, column: str = "build") -> DataFrame:
    """Distinct build ids with ``build_num``: their number if all are numbers, else NULL.

    Ordering by (build_num, build) is numeric if every id parses, else lexical.
    """
    seen = builds.select(F.col(column).alias("build")).distinct()
    numbered = seen.withColumn("_num", _number(F.col("build")))
    every = numbered.agg(F.bool_and(F.col("_num").isNotNull()).alias("ok")).scalar()
    return numbered.select("build", F.when(every, F.col("_num")).alias("build_num"))


def build_times(perf: DataFrame) -> DataFrame:
    """(build, last_recorded) of every build: a summary of measurements, or of summaries of parts of them."""
    last = "last_recorded" if "last_recorded" in perf.columns else "recorded_at"
    return perf.groupBy("build").agg(F.max(last).alias("last_recorded"))


def recent_builds(perf: DataFrame, limit: int = V.PERF_HISTORY_LIMIT) -> DataFrame:
    """The ``limit`` builds recorded last, from measurements or from the times that a lake keeps of its builds."""
    return build_times(perf).orderBy(F.desc("last_recorded"), F.desc("build")).limit(limit)


def recent_rows(perf: DataFrame, limit: int = V.PERF_HISTORY_LIMIT) -> DataFrame:
    """Rows of the recent builds. Their ids, at most ``limit``, are literals of the filter, which prunes partitions."""
    return perf.filter(F.col("build").isin(_recent_ids(perf, limit)))


def _recent_ids(perf: DataFrame, limit: int) -> list[str]:
    return [r["build"] for r in recent_builds(perf, limit).filter(F.col("build").isNotNull()).collect()]


def build_window(rows: DataFrame, limit: int = V.PERF_HISTORY_LIMIT) -> DataFrame:
    """Last ``limit`` builds of the rows, in build order, with their sort key."""
    return build_order(rows).orderBy(F.desc("build_num"), F.desc("build")).limit(limit)


def in_window(rows: DataFrame, window: DataFrame) -> DataFrame:
    """Rows of the window's builds, with ``build_num``; a window is at most ``limit`` rows."""
    return rows.join(F.broadcast(window.select("build", "build_num")), "build")


def metric_cells(rows: DataFrame) -> DataFrame:
    """Last value per (model, metric, build), with the first-recorded unit and direction.

    Units and directions have few values, so they join the grouping key of a
    first aggregation whose buffers are all fixed-width: it combines on the map
    side by hashing, without a sort. The second one sees a few rows per cell.
    """
    order = micros(F.col("recorded_at"))
    if "id" in rows.columns:
        # One decimal orders by (recorded_at, id): ids of either sign span less than 2 * 10**19.
        order = order.cast("decimal(18,0)") * F.lit(Decimal(2 * 10 ** 19)) + F.coalesce("id", F.lit(0))
        order = order.cast("decimal(38,0)")
    build = [c for c in ("build", "build_num") if c in rows.columns]
    partial = (
        rows.withColumn("_ord", order)
        .groupBy("model", "metric_name", *build, "unit", "direction")
        .agg(
            F.max_by("value", "_ord").alias("value"),
            F.max("_ord").alias("last"),
            F.min("_ord").alias("first"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return partial.groupBy("model", "metric_name", *build).agg(
        F.max_by("value", "last").alias("value"),
        F.min_by(F.struct("unit", "direction"), "first").alias("attrs"),
        F.min("first").alias("first"),
        F.sum("n").alias("writes"),
    )


def windowed_cells(perf: DataFrame, limit: int = V.PERF_HISTORY_LIMIT, times: DataFrame | None = None) -> DataFrame:
    """Cells of the builds recorded last; all models share this window.

    Axis, attributes and series are all made from the cells, so the raw rows
    are read once and the cells are written down. With the ``times`` that a lake keeps, no measurement is read to find the window.
    """
    ids = _recent_ids(perf if times is None else times, limit)
    window = build_window(perf.sparkSession.createDataFrame([(b,) for b in ids], "build string"), limit)
    return cut_lineage(metric_cells(in_window(perf.filter(F.col("build").isin(ids)), window)))


def metric_attrs(cells: DataFrame) -> DataFrame:
    """Unit and direction of each metric from its earliest row in the window."""
    return (
        cells.groupBy("model", "metric_name")
        .agg(F.min_by("attrs", "first").alias("attrs"))
        .select("model", "metric_name", "attrs.unit", "attrs.direction")
    )


def build_axis(cells: DataFrame) -> DataFrame:
    """Per model, its builds inside the window in build order (at most window-size long).

    The order is numeric if all of the model's own builds are numbers, else lexical.
    """
    builds = F.collect_set(F.struct(_number(F.col("build")).alias("num"), "build"))
    by_number = F.transform(F.array_sort("builds"), lambda b: b["build"])
    numeric = F.forall("builds", lambda b: b["num"].isNotNull())
    return cells.groupBy("model").agg(builds.alias("builds")).select(
        "model", F.when(numeric, by_number).otherwise(F.array_sort("builds.build")).alias("axis")
    )


def metric_series(cells: DataFrame) -> DataFrame:
    """One row per (model, metric): a value for every build of the model's axis, gaps as 0.0."""
    metrics = cells.groupBy("model", "metric_name").agg(
        F.map_from_entries(F.collect_list(F.struct("build", "value"))).alias("cells"),
        F.min_by("attrs", "first").alias("attrs"),
    )
    series = join_unique(metrics, build_axis(cells), ["model"], "inner")
    value = lambda b: F.try_element_at(F.col("cells"), b)
    return series.select(
        "model",
        "metric_name",
        "attrs.unit",
        "attrs.direction",
        F.col("axis").alias("history_builds"),
        F.transform("axis", lambda b: F.coalesce(value(b), F.lit(0.0))).alias("history_values"),
        F.transform("axis", lambda b: value(b).isNull()).alias("filled"),
        "cells",
    )


def current_and_reference(series: DataFrame, build: str, ref_build: str) -> DataFrame:
    """Value at the build (else the last of the series) and at the reference (else the current)."""
    last = F.coalesce(F.try_element_at("history_values", F.lit(-1)), F.lit(0.0))
    current = F.coalesce(F.try_element_at("cells", F.lit(build)), last)
    return series.withColumn("current", current).withColumn(
        "reference", F.coalesce(F.try_element_at("cells", F.lit(ref_build)), F.col("current"))
    )


def metric_deltas(metrics: DataFrame) -> DataFrame:
    """Delta, status, bar heights and display texts from current, reference and direction."""
    pct, direction = F.col("delta_pct"), F.col("direction")
    return (
        metrics.withColumn("delta_pct", D.delta_pct(F.col("current"), F.col("reference")))
        .withColumns({
            "delta_display": D.delta_text(pct, F.col("reference")),
            "delta_css": D.delta_class(pct, direction),
            "status": D.metric_status(pct, direction),
            "sparkline_heights": D.sparkline(F.col("history_values"), direction),
            "unit_display": D.unit_text(F.col("unit"), direction),
        })
        .withColumn("value_color", D.colour_class(F.col("delta_css")))
    )


def metric_report(perf: DataFrame, build: str, ref_build: str, limit: int = V.PERF_HISTORY_LIMIT, times: DataFrame | None = None) -> DataFrame:
    """Flat metric rows of the report, from raw measurements."""
    series = metric_series(windowed_cells(perf, limit, times))
    return metric_deltas(current_and_reference(series, build, ref_build)).drop("cells")


def _model_keys(metrics: DataFrame) -> list[str]:
    return [*[c for c in ("source", "source_ord") if c in metrics.columns], "model"]


def model_trend(metrics: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Counts of improved, regressed and neutral metrics per model, and the majority."""
    keys = list(keys or _model_keys(metrics))
    counts = metrics.groupBy(*keys).agg(
        F.count_if(F.col("status") == "improved").alias("improved_count"),
        F.count_if(F.col("status") == "regressed").alias("regressed_count"),
        F.count(F.lit(1)).alias("total_metrics"),
    )
    neutral = F.col("total_metrics") - F.col("improved_count") - F.col("regressed_count")
    trend = F.col("trend_class")
    return (
        counts.withColumn("neutral_count", neutral)
        .withColumn("trend_class", D.trend_class(F.col("improved_count"), F.col("regressed_count")))
        .withColumn("trend_label", D.trend_title(trend))
        .withColumn("counts_display", D.counts_text(
            trend, F.col("improved_count"), F.col("regressed_count"), F.col("neutral_count"), F.col("total_metrics")))
    )


def summary_chips(metrics: DataFrame, count: int = 2) -> DataFrame:
    """Chips of each model's first metrics; the ranking is limited before the shuffle."""
    keys = _model_keys(metrics)
    first = W.partitionBy(*keys).orderBy("metric_name")
    chip = D.chip(F.col("metric_name"), F.col("current"), F.col("unit"), F.col("delta_css"))
    return (
        metrics.withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") <= count)
        .groupBy(*keys)
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rn", chip.alias("chip")))), lambda c: c["chip"])
            .alias("summary_chips_display"),
            F.max_by(F.size("history_builds"), -F.col("rn")).alias("history_length"),
        )
    )


def model_summary(metrics: DataFrame, ref_build: str | None = None, given: DataFrame | None = None) -> DataFrame:
    """One row per model: trend, counts, chips and note.

    ``given`` (model, summary_note, summary_chips, and source if the metrics have one) are notes and chips that come with a model; they win
    where they are not blank or empty.
    """
    keys = _model_keys(metrics)
    rows = model_trend(metrics).join(summary_chips(metrics), keys)
    note, chips = F.lit(None).cast("string"), F.col("summary_chips_display")
    if given is not None:
        own = [c for c in keys if c in given.columns]
        known = given.groupBy(*own).agg(F.max("summary_note").alias("_note"), F.max("summary_chips").alias("_chips"))
        rows = rows.join(known, own, "left")
        note, chips = F.col("_note"), D.chips_or_given(F.col("_chips"), chips)
    rows = rows.withColumns({
        "summary_note": D.summary_note(note, F.col("trend_class"), F.lit(ref_build).cast("string")),
        "summary_chips_display": chips,
    })
    return rows.drop("_note", "_chips")


def model_rollup(metrics: DataFrame, list_size: int = LIST_SIZE) -> DataFrame:
    """Metrics nested under their model by name; a very wide model comes in several parts, in order."""
    keys = _model_keys(metrics)
    rest = [c for c in metrics.columns if c not in (*keys, "metric_name", "cells", "part")]
    entry = F.struct(F.col("metric_name").alias("name"), *rest)
    return (
        with_part(metrics, keys, ["metric_name"], list_size)
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(entry)).alias("metrics"))
    )
