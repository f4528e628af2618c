"""Prompts, a user's scoring function, and results saved batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions.prompts import parse_response, prompt_text
from buildlens.operators.sizing import cut_lineage

FAILED = "Analysis failed: "


def pending_analysis(cases: DataFrame, skip_if_present: bool = True) -> DataFrame:
    """Cases without analysis text; blank text counts as none."""
    if not skip_if_present:
        return cases
    return cases.filter(F.btrim(F.coalesce(F.col("ai_analysis.text"), F.lit("")), F.lit(V.WHITESPACE)) == "")


def with_prompt(cases: DataFrame, build: dict[str, str], context: str | None = None) -> DataFrame:
    """Adds ``prompt``; tickets and log are used where the columns exist."""
    have = set(cases.columns)
    tickets = F.col("jira_context") if "jira_context" in have else F.lit(None).cast(
        "array<struct<key:string,summary:string,status:string,type:string,priority:string,url:string,match:string>>")
    log = F.col("log") if "log" in have else F.lit(None).cast("string")

    def attr(name: str) -> Column:
        return F.lit(build.get(name)).cast("string")

    return cases.withColumn("prompt", prompt_text(
        attr("number"), attr("branch"), attr("ref_build"),
        F.col("name"), F.col("status"), F.col("duration"), F.col("failure_message"), F.col("failure_text"),
        tickets, F.col("history"), log, F.lit(context).cast("string"),
    ))


def score(prompts: DataFrame, call: Callable[[str, str], str], key: str = "id", concurrency: int = 0) -> DataFrame:
    """Run ``call(system_prompt, prompt)`` for every row; an error becomes a row, not a failed job.

    Only the key and the prompt cross to Python, in Arrow batches.
    ``concurrency`` sets how many calls run side by side.
    """
    system = V.SYSTEM_PROMPT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, error = [], []
            for prompt in batch["prompt"]:
                try:
                    answer = call(system, prompt)
                    if not isinstance(answer, str):
                        raise TypeError(f"the answer is {type(answer).__name__}, not text")
                    raw.append(answer)
                    error.append(None)
                except Exception as exc:  # noqa: BLE001 - the user's function may raise anything
                    raw.append(None)
                    error.append(str(exc))
            yield pd.DataFrame({key: batch[key], "raw": raw, "error": error})

    rows = prompts.select(key, "prompt")
    rows = rows.repartition(concurrency) if concurrency else rows
    kind = prompts.schema[key].dataType.simpleString()
    answered = rows.mapInPandas(run, f"{key} {kind}, raw string, error string")
    failed = F.struct(
        F.concat(F.lit(FAILED), F.col("error")).alias("text"),
        F.lit(V.ERROR_TAG).alias("tag"),
        F.lit("warn").alias("tag_type"),
    )
    return answered.select(
        key, F.when(F.col("error").isNotNull(), failed).otherwise(parse_response(F.col("raw"))).alias("ai_analysis")
    )


def _saved(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def score_and_save(
    prompts: DataFrame,
    call: Callable[[str, str], str],
    path: str,
    key: str = "id",
    batches: int = 10,
    concurrency: int = 0,
) -> DataFrame:
    """Score in ``batches`` appended one after the other, skipping keys already saved.

    Every finished batch is kept if the run stops, and running again goes on
    with the rest. Batches are hash slices of the key, so each is spread over
    all tasks and a retried task gives the same slice. The prompts are written
    to the checkpoint folder once, not computed again per batch.
    """
    spark = prompts.sparkSession
    concurrency = concurrency or spark.sparkContext.defaultParallelism
    prompts = cut_lineage(prompts.select(key, "prompt"))
    for batch in range(batches):
        rows = prompts.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == batch)
        saved = _saved(spark, path)
        if saved is not None:
            rows = rows.join(saved.select(key).distinct(), key, "left_anti")
        score(rows, call, key, concurrency).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def attach_analysis(cases: DataFrame, scored: DataFrame, key: str = "id") -> DataFrame:
    """Cases with new analyses; earlier ones stay where there is no new one."""
    new = scored.select(key, F.col("ai_analysis").alias("new_analysis"))
    old = F.col("ai_analysis") if "ai_analysis" in cases.columns else F.lit(None).cast(
        "struct<text:string,tag:string,tag_type:string>")
    return (
        cases.join(new, key, "left")
        .withColumn("ai_analysis", F.coalesce(F.col("new_analysis"), old))
        .drop("new_analysis")
    )
