"""Reports saved after a stage and read again to redo a later one.

The tables of a report are sections: Parquet folders of their own, written once and never changed. A manifest names the sections
of one saved state and holds what is small: attributes, gate and timings. It is one file, made complete in the store by one write after all sections
are there, so a reader sees the state before or the state after, and a save that stops leaves files that nothing names.
States are numbered; a section that has not changed since the state before is named again, not written again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from buildlens import schemas as SC
from buildlens.operators.sizing import with_ordinal
from buildlens.plans.report import Report

SECTIONS = ("cases", "metrics", "models", "badges", "gate", "sources", "violations", "spans")


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _states(spark: SparkSession, path: str) -> list[int]:
    store, place = _file(spark, f"{path}/manifests")
    if not store.exists(place):
        return []
    names = [s.getPath().getName() for s in store.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, path: str, state: int) -> dict:
    return json.loads(spark.read.text(f"{path}/manifests/{state:06d}.json", wholetext=True).first()[0])


def save(report: Report, path: str, stage: str, changed: tuple[str, ...] | None = None) -> int:
    """Save a report and return the number of its state. ``changed`` names the sections that differ from the last state (None: all)."""
    spark = SparkSession.active()
    before = _states(spark, path)
    last = _manifest(spark, path, before[-1])["sections"] if before and changed is not None else {}
    sections = {}
    for name in SECTIONS:
        table = getattr(report, name)
        if table is None:
            continue
        if changed is not None and name not in changed and name in last:
            sections[name] = last[name]
            continue
        folder = f"sections/{name}-{uuid.uuid4().hex}"
        table.write.parquet(f"{path}/{folder}")
        sections[name] = {"folder": folder, "schema": table.schema.jsonValue()}
    state = before[-1] + 1 if before else 1
    text = json.dumps({"build": report.build, "stage": stage, "attrs": report.attrs, "timings": report.timings, "sections": sections}, indent=1)
    store, place = _file(spark, f"{path}/manifests/{state:06d}.json")
    out = store.create(place, False)  # a state that another run has published is not written over
    out.write(bytearray(text.encode()))
    out.close()
    return state


def load(spark: SparkSession, path: str, state: int | None = None) -> Report:
    """A saved report; the last state unless another is asked for."""
    states = _states(spark, path)
    if not states:
        raise FileNotFoundError(f"no report under {path}")
    found = _manifest(spark, path, states[-1] if state is None else state)
    tables = {name: spark.read.schema(StructType.fromJson(s["schema"])).parquet(f"{path}/{s['folder']}") for name, s in found["sections"].items()}
    blank = Report(found["build"], None, None, None, found["attrs"], None, None, timings=found["timings"])
    return replace(blank, **tables)


def _in_shape(have: DataFrame, kind: StructType, given: dict[str, Column] | None = None) -> Column:
    """A struct of the fixed shape from columns of the same names; what is missing is NULL."""
    given = given or {}
    names = {f.name for f in have.schema}
    return F.struct(*[(given[f.name] if f.name in given else F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])


def _each_in_shape(df: DataFrame, name: str, kind: StructType) -> Column:
    """A list of structs as a list of the fixed shape, fields by name."""
    have = df.schema[name].dataType.elementType.names
    return F.transform(name, lambda c: F.struct(*[(c[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind]))


def document(report: Report) -> DataFrame:
    """The report as rows of the document shape: the build in every row, and in each the next scenario or model, its list of bounded size.

    Rows are numbered by ``piece``; failures come before performance, both in the order of their sources. One piece after the other they
    are the whole document, and the functions that flatten documents take them as they are.
    """
    spark = SparkSession.active()
    badges = {r["key"]: r["value"] for r in report.badges.select("key", "value").collect()} if report.badges is not None else {}
    build = F.from_json(F.lit(json.dumps({**report.attrs, "badges": badges})), SC.BUILD)
    none = {name: F.array().cast(SC.REPORT[name].dataType).alias(name) for name in ("failures", "performance")}
    pieces = []
    if report.cases is not None:
        groups = report.scenarios()
        pieces.append(groups.select(F.lit(0).alias("kind"), "source_ord", F.col("scenario").alias("first"), F.col("config").alias("second"), "part",
                                    F.array(_in_shape(groups, SC.SCENARIO, {"test_cases": _each_in_shape(groups, "test_cases", SC.TEST_CASE)})).alias("failures"), none["performance"]))
    if report.metrics is not None:
        notes = report.models.select("source", "model", "summary_note", F.col("summary_chips_display").alias("summary_chips"))
        models = report.performance().join(notes, ["source", "model"], "left")
        pieces.append(models.select(F.lit(1).alias("kind"), "source_ord", F.col("model").alias("first"), F.lit("").alias("second"), "part",
                                    none["failures"], F.array(_in_shape(models, SC.MODEL, {"metrics": _each_in_shape(models, "metrics", SC.METRIC)})).alias("performance")))
    if not pieces:
        return spark.range(1).select(F.col("id").alias("piece"), build.alias("build"), none["failures"], none["performance"])
    placed = with_ordinal(reduce(DataFrame.unionByName, pieces), [], ["kind", "source_ord", "first", "second", "part"])
    return placed.select(F.col("ordinal").alias("piece"), build.alias("build"), "failures", "performance")
