"""Structural checks of reports. They report rows and never stop a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions.text import null_to_blank, strip


def _blank(c: Column) -> Column:
    return null_to_blank(c) == ""


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"


def _violations(df: DataFrame, keys: list[str], checks: list[tuple[Column, Column, Column]]) -> DataFrame:
    """One row per failed check; ``checks`` are (failed, location, message)."""
    found = F.array_compact(F.array(*[
        F.when(failed, F.struct(location.alias("location"), message.alias("message")))
        for failed, location, message in checks
    ]))
    return df.select(*keys, F.explode(found).alias("v")).select(*keys, "v.location", "v.message")


def bad_case() -> Column:
    """Whether a flat case (scenario, name, status) has any violation."""
    status = null_to_blank(F.col("status"))
    return _blank(F.col("scenario")) | _blank(F.col("name")) | ((status != "") & ~status.isin(V.CASE_STATUSES))


def bad_metric(name: str = "name") -> Column:
    """Whether a flat metric (model, name, current, direction) has any violation."""
    direction = null_to_blank(F.col("direction"))
    return _blank(F.col("model")) | _blank(F.col(name)) | F.col("current").isNull() | ((direction != "") & ~direction.isin(V.DIRECTIONS))


def build_violations(builds: DataFrame) -> DataFrame:
    """Rows (build, number): a blank number is an error."""
    return _violations(builds, ["build"], [
        (strip(null_to_blank(F.col("number"))) == "", F.lit("build"),
         F.lit("build.number is missing — was a build name provided?")),
    ])


def scenario_violations(scenarios: DataFrame) -> DataFrame:
    """Rows (build, i, scenario)."""
    loc = F.concat(F.lit("failures["), F.col("i").cast("string"), F.lit("]"))
    return _violations(scenarios, ["build"], [
        (_blank(F.col("scenario")), loc, F.lit("missing 'scenario' field")),
    ])


def case_violations(cases: DataFrame) -> DataFrame:
    """Rows (build, i, j, name, status)."""
    loc = F.concat(F.lit("failures["), F.col("i").cast("string"), F.lit("].test_cases["), F.col("j").cast("string"), F.lit("]"))
    status = null_to_blank(F.col("status"))
    return _violations(cases, ["build"], [
        (_blank(F.col("name")), loc, F.lit("missing 'name' field")),
        ((status != "") & ~status.isin(V.CASE_STATUSES), loc,
         F.concat(F.lit("unknown status '"), status, F.lit(f"' — expected one of {_listed(V.CASE_STATUSES)}"))),
    ])


def model_violations(models: DataFrame) -> DataFrame:
    """Rows (build, i, model)."""
    loc = F.concat(F.lit("performance["), F.col("i").cast("string"), F.lit("]"))
    return _violations(models, ["build"], [
        (_blank(F.col("model")), loc, F.lit("missing 'model' field")),
    ])


def metric_violations(metrics: DataFrame) -> DataFrame:
    """Rows (build, i, j, name, current, direction)."""
    loc = F.concat(F.lit("performance["), F.col("i").cast("string"), F.lit("].metrics["), F.col("j").cast("string"), F.lit("]"))
    direction = null_to_blank(F.col("direction"))
    return _violations(metrics, ["build"], [
        (_blank(F.col("name")), loc, F.lit("missing 'name' field")),
        (F.col("current").isNull(), loc, F.lit("missing 'current' value")),
        ((direction != "") & ~direction.isin(V.DIRECTIONS), loc,
         F.concat(F.lit("invalid direction '"), direction, F.lit(f"' — expected one of {_listed(V.DIRECTIONS)}"))),
    ])


def violations(reports: DataFrame) -> DataFrame:
    """All checks of nested report documents: (build, location, message)."""
    number = F.col("build.number")
    scenarios = reports.select(number.alias("build"), F.posexplode("failures").alias("i", "s"))
    cases = scenarios.select("build", "i", F.posexplode("s.test_cases").alias("j", "c"))
    models = reports.select(number.alias("build"), F.posexplode("performance").alias("i", "m"))
    metrics = models.select("build", "i", F.posexplode("m.metrics").alias("j", "x"))
    return (
        build_violations(reports.select(number.alias("build"), number.alias("number")))
        .unionByName(scenario_violations(scenarios.select("build", "i", "s.scenario")))
        .unionByName(case_violations(cases.select("build", "i", "j", "c.name", "c.status")))
        .unionByName(model_violations(models.select("build", "i", "m.model")))
        .unionByName(metric_violations(metrics.select("build", "i", "j", "x.name", "x.current", "x.direction")))
    )
