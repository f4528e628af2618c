"""Measured broadcasts, joins that spread hot keys, distributed places in an order, and bounded nested lists."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
LIST_SIZE = 1_000
HOT_ROWS = 200_000
HOT_KEYS = 10_000

_NO_HASH = ("map", "variant")


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a DataFrame's values, by one distributed aggregation."""
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df)), F.lit(0))).first())


def widest_row(df: DataFrame) -> int:
    """Bytes of the widest row."""
    return df.agg(F.coalesce(F.max(_width(df)), F.lit(0))).first()[0]


def _width(df: DataFrame) -> Column:
    return sum((F.coalesce(_bytes(df, c), F.lit(0)) for c in df.columns), F.lit(0)).cast("long")


def _bytes(df: DataFrame, name: str) -> Column:
    scalar = df.schema[name].dataType.typeName() not in ("array", "struct", "map")
    return F.octet_length(F.col(name).cast("string") if scalar else F.to_json(F.struct(F.col(name))))


def fits(rows: int, size: int, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    return rows <= max_rows and size <= max_bytes


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measured to be fit for a broadcast."""
    return fits(*measure(df), max_rows, max_bytes)


def work_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder of the session; a temporary folder is set only where there is none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir to name a shared folder")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back.

    For results that are much smaller than their input and used several times.
    The table survives lost executors, and its size is known to the optimizer.
    """
    path = work_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f.name) for f in df.schema if f.dataType.typeName() not in _NO_HASH])


def dealt_out(df: DataFrame, size: Column, task_bytes: int) -> DataFrame:
    """The same rows, dealt out by a hash of each so that a task has about ``task_bytes`` of ``size``, however large the table and its files.

    For steps whose tasks must hold several times what they read. A table that fits one task stays as it is.
    """
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    tasks = -(-total // task_bytes)
    return df.repartition(int(tasks), _row_hash(df)) if tasks > 1 else df


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key as ``_n``, combined on the map side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _hot_keys(counts: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys far above an even share, and the slots to spread each over.

    A hot key has more than 1 / HOT_KEYS of all rows, so there are fewer than
    HOT_KEYS of them however large the data: a proven bound for a broadcast.
    """
    total = counts.agg(F.sum("_n")).scalar()
    share = F.greatest(F.lit(float(hot_rows)), total / F.lit(HOT_KEYS))
    return counts.filter(F.col("_n") > share).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / share).cast("int").alias("_slots")
    )


def _with_slots(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(F.broadcast(hot), same, "left").drop(*[f"_{k}" for k in keys])


def join_unique(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    small: bool | None = None,
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join to a side with one row per key, whatever share of ``left`` a key holds.

    A right side measured to be ``small`` is broadcast. Otherwise rows of a hot
    key are spread over several slots by their hash, and its one right row is
    repeated per slot; a retried task gives the same slots.
    """
    keys = list(keys)
    added = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in keys]
    columns = [*left.columns, *added]
    if small or (small is None and is_small(right)):
        return left.join(F.broadcast(right), keys, how).select(*columns)
    hot = _hot_keys(counts if counts is not None else key_counts(left, keys), keys, hot_rows)
    slot = F.coalesce(F.pmod(_row_hash(left), F.col("_slots")), F.lit(0)).cast("int")
    spread = _with_slots(left, hot, keys).withColumn("_slot", slot).drop("_slots")
    slots = F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1)
    repeated = _with_slots(right, hot, keys).withColumn("_slot", F.explode(slots)).drop("_slots")
    return spread.join(repeated, [*keys, "_slot"], how).select(*columns)


def with_ordinal(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Add ``ordinal``: the place from 0 of a row in its group, ordered by ``order``, however large the group.

    Rows are sorted by range over all tasks and written once with their task and their place there. Counts per task and group,
    of which there are no more than tasks and groups together, give every task the number of rows of its group before it.
    Ties of ``order`` are put in the order of a hash of the row. No group is ever in one task, unless it is small.
    Grouping columns must not be NULL.
    """
    by = list(by)
    ties = F.xxhash64(*[F.col(f.name) for f in df.schema if f.dataType.typeName() not in _NO_HASH])
    keys = [*by, *order, "_tie"]
    ranged = df.withColumn("_tie", ties).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(ranged.withColumns({"_task": F.spark_partition_id(), "_place": place}))
    pieces = placed.groupBy("_task", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = W.partitionBy(*by).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    shifts = pieces.select("_task", *by, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    shifts = cut_lineage(shifts)
    shifts = F.broadcast(shifts) if is_small(shifts) else shifts
    numbered = placed.join(shifts, ["_task", *by]).withColumn("ordinal", F.col("_place") + F.col("_shift"))
    return numbered.select(*df.columns, "ordinal")


def with_part(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], list_size: int = LIST_SIZE) -> DataFrame:
    """Add ``part``: the place of a row in its group, ordered by ``order``, divided by ``list_size``.

    Every part of a group is a contiguous range of its order and full but for the last, so the lists collected per (group, part),
    one part after the other, are the sorted group. Only rows of groups with more than one part are sorted for it.
    """
    # One text key, in which NULLs are told apart by being left out.
    keyed = df.withColumn("_key", F.to_json(F.struct(*by)))
    large = key_counts(keyed, ["_key"]).filter(F.col("_n") > list_size).select("_key", F.lit(True).alias("_large"))
    rows, size = measure(large)
    if rows == 0:
        return df.withColumn("part", F.lit(0))
    marked = keyed.join(F.broadcast(large) if fits(rows, size) else large, "_key", "left")
    whole = marked.filter(F.col("_large").isNull()).select(*df.columns, F.lit(0).alias("part"))
    several = with_ordinal(marked.filter("_large").select(*df.columns, "_key"), ["_key"], order)
    part = F.floor(F.col("ordinal") / list_size).cast("int").alias("part")
    return whole.unionByName(several.select(*df.columns, part))
