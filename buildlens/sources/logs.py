"""Log files: listed without being opened, read from their end, kept with the record of every fetch."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.operators.sizing import cut_lineage, with_ordinal
from buildlens.schemas import FETCH_LOG

#: Bytes that one task reads, about; files are dealt out to match.
TASK_BYTES = 64 << 20
#: Tasks for each core that list folders.
LISTING_TASKS = 4
#: A batch of texts is handed on when it has so many bytes.
BATCH_BYTES = 8 << 20
STORED = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in FETCH_LOG)}, content binary"


def list_logs(spark: SparkSession, path: str, pattern: str = "*", by_folder: str | None = None) -> DataFrame:
    """(key, path, length) of the files under ``path``; no file is opened.

    The key is the file name without its ending, or the value of a folder ``by_folder=value``, as Spark writes them.
    """
    # One task for nearly every folder, as is the default, costs more than to list it.
    spread, given = "spark.sql.sources.parallelPartitionDiscovery.parallelism", None
    tasks = LISTING_TASKS * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(spread)) > tasks:
        given = spark.conf.get(spread)
        spark.conf.set(spread, tasks)
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    finally:
        if given is not None:
            spark.conf.set(spread, given)
    if by_folder:
        key = F.url_decode(F.regexp_extract("path", f"/{by_folder}=([^/]*)/", 1))
    else:
        key = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return files.select(key.alias("key"), "path", "length")


def _open(path: str):
    """A file of any store that Arrow knows, for reading at any place."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    if ":/" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    store, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(place)


def _fetch(path: str, last_bytes: int) -> tuple[bytes | None, float, float, str]:
    """The last bytes of a file (0: all), seconds to open and to read it, and what went wrong."""
    began = time.perf_counter()
    opened = began
    try:
        with _open(path) as file:
            opened = time.perf_counter()
            size = file.size()
            file.seek(max(0, size - last_bytes) if last_bytes else 0)
            content = file.read()
        return content, round(opened - began, 3), round(time.perf_counter() - opened, 3), ""
    except Exception as exc:  # noqa: BLE001 - whatever a store raises is the record of this file, not the end of the job
        return None, round(opened - began, 3), 0.0, str(exc) or type(exc).__name__


def read_tails(files: DataFrame, tail_bytes: int = 0, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Fetch records with ``content`` for files (key, url, path, length): only the last ``tail_bytes`` of each are read (0: all).

    Files are dealt out to tasks by what is read of them: in the order of that size every next file goes to the next task, so that tasks
    read about the same. The list of files stays distributed. A file that cannot be read gives a record with its error.
    """
    asked = F.least("length", F.lit(tail_bytes)) if tail_bytes else F.col("length")
    known = cut_lineage(files.select("key", "url", "path", "length", asked.alias("asked")))
    total = known.agg(F.coalesce(F.sum("asked"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // task_bytes), known.sparkSession.sparkContext.defaultParallelism)
    dealt = with_ordinal(known, [], [F.desc("asked"), "path"]).repartitionById(int(tasks), F.pmod("ordinal", F.lit(int(tasks))).cast("int"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                content, connect, transfer, error = _fetch(row["path"], tail_bytes)
                rows.append({"key": row["key"], "url": row["url"], "ok": content is not None, "path": row["path"] if content is not None else "",
                             "bytes": len(content or b""), "s": round(connect + transfer, 3), "connect_s": connect, "transfer_s": transfer,
                             "cached": False, "error": error, "content": content})
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema([*((n, pa.string()) for n in ("key", "url")), ("ok", pa.bool_()), ("path", pa.string()), ("bytes", pa.int64()),
                       *((n, pa.float64()) for n in ("s", "connect_s", "transfer_s")), ("cached", pa.bool_()), ("error", pa.string()), ("content", pa.binary())])
    return dealt.select("key", "url", "path").mapInArrow(read, STORED)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """All fetch records with their content kept under ``path``; none if nothing is there yet."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], STORED)
        raise


def ingest(spark: SparkSession, jobs: DataFrame, listed: DataFrame, path: str, tail_bytes: int = 0, max_bytes: int = 0,
           skip_if_present: bool = True) -> DataFrame:
    """Fetch the logs of ``jobs`` (key, url) among the ``listed`` files, keep them under ``path``, and return one record for each job.

    A job whose key is stored already is answered from there and reported as cached; its bytes and seconds are 0. A key without a file, or
    whose file cannot be read, gives a failed record. Only files of jobs that are still to be fetched are opened. A file that several jobs ask for is read once.
    """
    stored = read_stored(spark, path)
    kept = stored.filter("ok").groupBy("key").agg(F.max("path").alias("path"))
    jobs = cut_lineage(jobs.select("key", "url").distinct())
    todo = jobs.join(kept, "key", "left_anti") if skip_if_present else jobs
    cached = jobs.join(kept, "key").select(
        "key", "url", F.lit(True).alias("ok"), "path", F.lit(0).cast("long").alias("bytes"),
        *[F.lit(0.0).alias(c) for c in ("s", "connect_s", "transfer_s")], F.lit(True).alias("cached"), F.lit("").alias("error"))
    wanted = todo.groupBy("key").agg(F.max("url").alias("url"))
    one = listed.groupBy("key").agg(F.max_by(F.struct("path", "length"), "path").alias("file"))
    files = wanted.join(one, "key").select("key", "url", "file.path", "file.length")
    cap = min((n for n in (tail_bytes, max_bytes) if n > 0), default=0)
    fetched = read_tails(files, cap)
    missing = wanted.join(one, "key", "left_anti").select(
        "key", "url", F.lit(False).alias("ok"), F.lit("").alias("path"), F.lit(0).cast("long").alias("bytes"),
        *[F.lit(0.0).alias(c) for c in ("s", "connect_s", "transfer_s")], F.lit(False).alias("cached"), F.lit("no such file").alias("error"),
        F.lit(None).cast("binary").alias("content"))
    # A second record of a key, from a job run twice, is harmless: the last path counts.
    new = cut_lineage(fetched.unionByName(missing))
    new.filter("ok").write.mode("append").parquet(path)
    records = todo.join(new.drop("url", "content"), "key").select(*FETCH_LOG.names)
    return records.unionByName(cached.select(*FETCH_LOG.names)) if skip_if_present else records


def log_text(stored: DataFrame) -> DataFrame:
    """(path, text) of the stored logs; bytes that are no UTF-8 become the replacement character."""
    return stored.filter("ok").groupBy("path").agg(F.max("content").alias("content")).select(
        "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
