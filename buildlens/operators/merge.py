"""Several sources into one report: concatenation, attributes, badges, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(sources: dict[str, DataFrame | None]) -> DataFrame:
    """Rows of all sources in order, duplicates kept; ``source`` and ``source_ord`` say whose."""
    tagged = [
        df.withColumns({"source": F.lit(name), "source_ord": F.lit(i)})
        for i, (name, df) in enumerate(sources.items())
        if df is not None
    ]
    if not tagged:
        raise ValueError("no source gave any rows")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_attributes(attrs: DataFrame, by: tuple[str, ...] = ("build",)) -> DataFrame:
    """Rows (key, value, source_ord): per key the value of the last source; the base is the lowest."""
    return attrs.groupBy(*by, "key").agg(F.max_by("value", "source_ord").alias("value"))


def merge_badges(badges: DataFrame, cases: DataFrame, by: tuple[str, ...] = ("build",)) -> DataFrame:
    """Badges merged key by key, then ``failed`` set to the number of cases."""
    kept = merge_attributes(badges, by).filter(F.col("key") != "failed")
    builds = badges.select(*by).distinct()
    counted = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    failed = builds.join(counted, list(by), "left").select(
        *by, F.lit("failed").alias("key"), F.coalesce("n", F.lit(0)).cast("long").alias("value")
    )
    return kept.withColumn("value", F.col("value").cast("long")).unionByName(failed)


def attribute_map(attrs: DataFrame, by: tuple[str, ...] = ("build",)) -> DataFrame:
    """Merged (key, value) rows as one map per build; keys are unique by then."""
    return attrs.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("attrs"))


def source_counts(cases: DataFrame, metrics: DataFrame) -> DataFrame:
    """Failing cases and models per source."""
    n_cases = cases.groupBy("source").agg(F.count(F.lit(1)).alias("n_cases"))
    n_models = metrics.select("source", "model").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n_models"))
    return n_cases.join(n_models, "source", "full").select(
        "source",
        F.coalesce("n_cases", F.lit(0)).alias("n_cases"),
        F.coalesce("n_models", F.lit(0)).alias("n_models"),
    )


def spans_by_source(spans: DataFrame) -> DataFrame:
    """Timing spans of each source as one map; sources without spans are absent."""
    last = spans.filter(F.col("seconds").isNotNull()).groupBy("source", "span").agg(F.max("seconds").alias("seconds"))
    return last.groupBy("source").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("span", "seconds")))).alias("spans")
    )


def slowest_span(spans: DataFrame) -> DataFrame:
    """The slowest span of each source; equal ones by name."""
    per_span = spans.groupBy("source", "span").agg(F.max("seconds").alias("seconds"))
    best = per_span.groupBy("source").agg(
        F.min(F.struct((-F.col("seconds")).alias("neg"), "span")).alias("b")
    )
    return best.select("source", F.col("b.span").alias("span"), (-F.col("b.neg")).alias("seconds"))


def span_gain(before, after):
    """Gain text of a span: '88% faster', 'n/a' where there was no time before."""
    from buildlens.functions.numbers import fixed_text

    pct = F.try_divide(before - after, before) * 100
    return F.when(before == 0, "n/a").otherwise(F.concat(fixed_text(pct, 0), F.lit("% faster")))
