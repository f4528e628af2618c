"""Report documents, text files and log directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens import fixed_values as V
from buildlens.functions.text import cap_with_marker, strip
from buildlens.operators.logs import log_texts, pending_logs
from buildlens.schemas import RAW_TICKETS, REPORT


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Saved report documents, one row each."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path)


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """Exported issue records, one JSON object per line."""
    return spark.read.schema(RAW_TICKETS).json(path)


def _file_name(path: str = "path"):
    return F.regexp_extract(F.col(path), r"([^/]+)$", 1)


def read_texts(spark: SparkSession, path: str, max_chars: int = V.TEXT_FILE_CAP) -> DataFrame:
    """Whole text files (file, text): stripped, then capped with a mark."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"),
        cap_with_marker(strip(F.col("value")), max_chars).alias("text"),
    )


def read_log_files(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """Log files as binary: key (file name without ending), path, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace(_file_name(), r"\.[^.]*$", "").alias("key"), "path", "content")


def ingest_logs(
    spark: SparkSession, path: str, jobs: DataFrame, stored: DataFrame | None = None, tail_bytes: int = 0
) -> DataFrame:
    """Log texts of the jobs not stored yet, one row per file."""
    todo = pending_logs(jobs, stored) if stored is not None else jobs
    files = read_log_files(spark, path).join(todo.select("key").distinct(), "key", "left_semi")
    return log_texts(files, tail_bytes)


def write_section(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """One section of a report, under its build."""
    writer = df.write.mode(mode)
    (writer.partitionBy("build") if "build" in df.columns else writer).format(fmt).save(path)
