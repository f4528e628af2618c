"""Answers of the user's function, each kept as soon as it is there, by build."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions.prompts import parse_response
from buildlens.operators.analysis import FAILED
from buildlens.operators.sizing import cut_lineage

ANSWER = "key string, raw string, error string"
SLICES = 64


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if ":/" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(quote(path, safe=":/@%"))


def _folder(path: str, build: str) -> str:
    return f"{path}/build={quote(build, safe='')}"


def answers(spark: SparkSession, path: str, build: str) -> DataFrame:
    """(key, raw, error) of everything answered for a build; one row per key. Other builds are not read."""
    try:
        # each answer is one file, named by its slice; the glob keeps files that a stopped task has left half written out
        found = spark.read.schema(ANSWER).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(_folder(path, build))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], ANSWER)
        raise
    first = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "raw", "error"))
    return found.filter("key IS NOT NULL").groupBy("key").agg(first.alias("a")).select("key", "a.raw", "a.error")


def score_to_archive(prompts: DataFrame, call: Callable[[str, str], str], path: str, build: str, key: str = "case_key", slices: int = SLICES) -> DataFrame:
    """(key, ai_analysis) for every prompt, calling the function only for keys that the build's part of the archive does not hold.

    Keys are dealt by hash into slices, a task each and a folder each. A task lists its folder before its first call and
    writes every answer as a file of its own when it comes, complete or not at all. So a task that is tried again, on another
    executor or in another run, finds what the one before it has answered, and a stop costs the calls in flight. Two attempts at the same time can
    both answer a key; one answer of a key counts, rather one that is no error. ``path`` is a folder in a store that Arrow
    reaches (local and shared disks, HDFS, S3, GCS, ABFS). An error of the function is an answer, too; keys must not be NULL.
    """
    spark = prompts.sparkSession
    known = answers(spark, path, build).select("key")
    asked = prompts.select(F.col(key).cast("string").alias("key"), "prompt").groupBy("key").agg(F.min("prompt").alias("prompt"))
    todo = cut_lineage(asked.join(known, "key", "left_anti").withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")))
    folder, system = _folder(path, build), V.SYSTEM_PROMPT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, attempt, made, done = None, uuid.uuid4().hex, 0, {}
        for batch in batches:
            for row in batch.to_pylist():
                if store is None:
                    store, top = _store(folder)
                if row["slice"] not in done:
                    done[row["slice"]] = _finished(store, f"{top}/slice={row['slice']}")
                if row["key"] in done[row["slice"]]:
                    continue
                raw, error = _ask(call, system, row["prompt"])
                place = f"{top}/slice={row['slice']}"
                store.create_dir(place, recursive=True)
                _write(store, place, f"{attempt}-{made}.json", {"key": row["key"], "raw": raw, "error": error})
                made += 1
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["made"])

    todo.repartitionById(slices, "slice").mapInArrow(run, "made long").agg(F.sum("made")).collect()
    failed = F.struct(F.concat(F.lit(FAILED), F.col("error")).alias("text"), F.lit(V.ERROR_TAG).alias("tag"), F.lit("warn").alias("tag_type"))
    found = answers(spark, path, build).select(F.col("key").alias(key), F.when(F.col("error").isNotNull(), failed).otherwise(parse_response(F.col("raw"))).alias("ai_analysis"))
    return found.join(asked.select(F.col("key").alias(key)), key, "left_semi")


def _ask(call: Callable[[str, str], str], system: str, prompt: str) -> tuple[str | None, str | None]:
    try:
        answer = call(system, prompt)
        if not isinstance(answer, str):
            raise TypeError(f"the answer is {type(answer).__name__}, not text")
        return answer, None
    except Exception as exc:  # noqa: BLE001 - the user's function may raise anything
        return None, str(exc)


def _finished(store: fs.FileSystem, place: str) -> set[str]:
    """Keys answered in a slice's folder."""
    keys = set()
    for info in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        if info.path.endswith(".json"):
            with store.open_input_stream(info.path) as file:
                keys.add(json.loads(file.read())["key"])
    return keys


def _write(store: fs.FileSystem, place: str, name: str, answer: dict) -> None:
    """Object stores show a file when it is complete; on file systems a rename does."""
    text = json.dumps(answer).encode()
    own = store.type_name in ("local", "hdfs")
    with store.open_output_stream(f"{place}/.{name}.part" if own else f"{place}/{name}") as file:
        file.write(text)
    if own:
        store.move(f"{place}/.{name}.part", f"{place}/{name}")
