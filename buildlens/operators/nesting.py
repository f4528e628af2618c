"""Report documents to flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_rows(groups: DataFrame) -> DataFrame:
    """Scenario groups to one row per case; scenario fields get the prefix ``scenario_``."""
    fields = [c for c in groups.columns if c not in ("test_cases", "part")]
    cases = groups.select(*[F.col(c).alias(f"scenario_{c}") for c in fields], F.explode("test_cases").alias("c"))
    return cases.select(*[f"scenario_{c}" for c in fields], "c.*").withColumnRenamed("scenario_scenario", "scenario")


def report_cases(reports: DataFrame) -> DataFrame:
    """Nested reports to case rows with build attributes and positions."""
    scenarios = reports.select("build", F.posexplode("failures").alias("i", "s"))
    cases = scenarios.select("build", "i", "s", F.posexplode("s.test_cases").alias("j", "c"))
    return cases.select(
        F.col("build.number").alias("build"),
        F.col("build.ref_build").alias("ref_build"),
        "i",
        "j",
        F.col("s.scenario").alias("scenario"),
        F.col("s.config").alias("scenario_config"),
        F.col("s.os").alias("scenario_os"),
        F.col("s.agent").alias("scenario_agent"),
        "c.*",
    )


def report_metrics(reports: DataFrame) -> DataFrame:
    """Nested reports to metric rows with positions."""
    models = reports.select("build", F.posexplode("performance").alias("i", "m"))
    metrics = models.select("build", "i", "m", F.posexplode("m.metrics").alias("j", "x"))
    return metrics.select(
        F.col("build.number").alias("build"),
        F.col("build.ref_build").alias("ref_build"),
        "i",
        "j",
        F.col("m.model").alias("model"),
        F.col("x.name").alias("metric_name"),
        "x.unit",
        "x.direction",
        "x.current",
        "x.reference",
        "x.history_values",
        "x.history_builds",
    )
