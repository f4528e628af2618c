"""Tables, intermediate results and word splitting shared by the operators of this package."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Code points that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (32, 9, 10, 11, 12, 13)
WORD = r"[^\x20\x09-\x0D]+"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_CHUNK_BYTES = 1 << 19
_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def store(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there, and lost executors cost nothing."""
    path = f"{work_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def store_parts(spark: SparkSession, parts: Iterable[DataFrame], schema: str) -> DataFrame:
    """Write one DataFrame after the other to one table of the shared folder and read it back."""
    path = f"{work_folder(spark)}/llm-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._stored_at = path
    return back


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of ``store`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory of this Python worker to the system: workers are kept between tasks, and what they hold adds up on an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, for a small working set in Python; freed memory is given back after each of the batches given."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        give_back()


def send_small(spark: SparkSession, rows: int = 1000, read: int = 250) -> None:
    """From now on this session sends at most so many rows at a time to Python tasks and back, and reads so many at a time from Parquet,
    for a small working set on both sides: whole texts of the 4,096 rows read by default are one array of many megabytes."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", read)):
        if not 0 < int(spark.conf.get(key)) <= most:
            spark.conf.set(key, most)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; a bijection."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * _CHUNK_BYTES)
        inverse = pow(_P, -1, 1 << 64)
        made = []
        for base in (_P, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def _texts_of(column, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the rows [first, last) with a space after each, and where each row begins."""
    parts = [(x.as_buffer() if x.is_valid else b"") for x in (column[i] for i in range(first, last))]
    sizes = np.array([len(x) if isinstance(x, bytes) else x.size for x in parts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    joined = b" ".join(parts) + b" " if parts else b""
    return np.frombuffer(joined, np.uint8), begins


def hashed_words(column, seed: int = 0, separates: np.ndarray = _IS_SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of an Arrow string column, about half a megabyte of text each, and a longer text whole:
    first row, last row (exclusive), hash of every word, index of each row's first word (one more at the end),
    UTF-8 bytes, and the start and end of each word in them. Null is an empty text. ``separates`` tells for each byte
    whether it separates words.
    """
    n = len(column)
    if not n:
        return
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    first = 0
    while first < n:
        last, total = first, 0
        while last < n and (last == first or total + sizes[last] <= _CHUNK_BYTES):
            total += int(sizes[last]) + 1
            last += 1
        data, begins = _texts_of(column, first, last)
        space = separates[data]
        edge = np.empty(len(data), bool)
        if len(data):
            edge[0] = not space[0]
            np.logical_and(space[:-1], ~space[1:], out=edge[1:])
        start = np.flatnonzero(edge)
        if len(data):
            edge[0] = False
            np.logical_and(~space[:-1], space[1:], out=edge[1:])
        end = np.flatnonzero(edge)
        power, inverse = _powers(len(data) + 1)
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=running[1:])
        words = mix((running[end] - running[start]) * inverse[start] + np.uint64(seed))
        yield first, last, words, np.searchsorted(start, begins), data, start, end
        first = last


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words, from the words' hashes; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(h)
