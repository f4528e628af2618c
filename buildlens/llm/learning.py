"""What the two document classifiers share: labelled rows, and isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A classifier is fitted on at most about this many labelled rows.
FIT_ROWS = 60_000
BINS = 1000


def fold(id_col: str, parts: int):
    return F.crc32(F.col(id_col).cast("string")) % parts


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int = FIT_ROWS) -> DataFrame:
    """Rows of ``docs`` with a label 0.0 or 1.0 outside the held-out fold: ids whose labels disagree have none.

    Beyond ``most`` labelled ids, a share of them is taken by hash, the same at every run.
    """
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", parts) != held))
             .groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high"))
             .filter(F.col("low") == F.col("high")).select("doc_id", F.col("low").cast("double").alias("label")))
    share = min(1.0, most / max(1, known.count()))
    kept = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.join(F.broadcast(kept), "doc_id")  # about FIT_ROWS small rows at most


def isotonic(scored: DataFrame, score: str = "raw", label: str = "label", level: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing map from raw scores to probabilities, by pooling adjacent violators over at most BINS bins
    of raw scores in [0, 1]. Only the bins' sums come to the driver. Returns the points to interpolate between: the middle of each
    pooled block or, if ``level``, both its ends, so that the map is level inside a block."""
    binned = scored.select(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))) * (BINS - 1)).alias("bin"), F.col(score).alias("s"), F.col(label).alias("y"))
    rows = sorted(tuple(r) for r in binned.groupBy("bin").agg(F.avg("s").alias("s"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).collect())
    blocks: list[list[float]] = []
    for _, at, positive, n in rows:
        blocks.append([at * n, positive, n, at, at])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [*(a + b for a, b in zip(blocks[-1][:3], last[:3], strict=True)), blocks[-1][3], last[4]]
    if not blocks:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    at = np.array([b[0] / b[2] for b in blocks])
    value = np.maximum.accumulate(np.array([(b[1] + 0.02) / (b[2] + 0.04) for b in blocks]))
    if level:
        return np.array([e for b in blocks for e in b[3:]]), np.repeat(value, 2)
    return at, value
