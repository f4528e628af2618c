"""Quality of documents by random Fourier features.

Statistics of each whole text (lengths, shares of kinds of characters, repetition) are
standardized over all documents and mapped to random Fourier features, which approximate a
Gaussian kernel. Normal equations are summed by partition over the labelled rows and solved
as a ridge regression; isotonic calibration on labelled rows outside the fit turns scores
into probabilities.

Only the text is an input of a score. Null texts are empty texts and get a score like any
other; repeated rows and null ids keep a row each. Without a label of either class every
score is the share of label 1, or 0.5 without labels. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import drop_stored, small, store
from buildlens.llm.learning import fold, isotonic, labelled

FEATURES = 256
RIDGE = 1e-3
CALIBRATED = 4
SUM_TASKS = 16
PARTS, HELD = 4, 2
REJECT_BELOW = 0.7
STATISTICS = ("chars", "words", "word_length", "lines", "upper", "letters", "digits", "exclaimed", "bars", "symbols", "stops",
              "distinct", "most_common", "repeated", "repeated_far", "symbol_ends", "upper_words")


def statistics(text: str) -> list[float]:
    """The numbers named in STATISTICS for one text."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    seen = Counter(words)
    symbols = counts[35:39].sum() + counts[42] + counts[64] + counts[94:97].sum() + counts[123:127].sum()
    ends = sum(1 for w in seen if w[-1] in "#$%&*|!@^~")
    return [math.log1p(len(text)), math.log1p(len(words)), min(40.0, len(raw) / n), (counts[10] + 1) / n, upper / size,
            (upper + lower + counts[128:].sum()) / size, counts[48:58].sum() / size, counts[33] / size, counts[124] / size, symbols / size,
            (counts[46] + counts[44]) / n, len(seen) / n, max(seen.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
            sum(map(eq, words, words[20:])) / n, ends / max(1, len(seen)), sum(1 for w in seen if w.isupper()) / max(1, len(seen))]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = [statistics(t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])


class Model:
    """Standardization, random features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, 1 / math.sqrt(len(mean)), (len(mean), FEATURES))
        self.phases = rng.uniform(0, 2 * math.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.points = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        waves = math.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.points)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(STATISTICS))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of its text."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measure, f"doc_id {kind}, x array<double>")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", parts: int = PARTS, held: int = HELD) -> Model:
    """A model of ``label`` from the labelled rows outside the held-out fold."""
    n = len(STATISTICS)
    sums = stats.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(n)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(n)]).first()
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(n)])
    model = Model(mean, np.array([sums[f"s{i}"] or 1.0 for i in range(n)]))
    known = store(labelled(stats, labels, label, parts, held).withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(CALIBRATED)) == 0))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                phi = model.features(_matrix(batch.column("x")))
                left += phi.T @ phi
                right += phi.T @ np.asarray(batch.column("label"))
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], ["a", "b"])

    parts_of = known.filter(~F.col("calibrates")).repartition(SUM_TASKS).mapInArrow(equations, "a binary, b binary").collect()
    left = sum((np.frombuffer(r["a"]).reshape(FEATURES + 1, -1) for r in parts_of), np.zeros((FEATURES + 1, FEATURES + 1)))
    right = sum((np.frombuffer(r["b"]) for r in parts_of), np.zeros(FEATURES + 1))
    size = left[-1, -1]
    if 0 < right[-1] < size:
        model.weights = np.linalg.solve(left / size + RIDGE * np.diag([1.0] * FEATURES + [0.0]), right / size)
        model.points = isotonic(_applied(known.filter("calibrates"), model.raw, "raw", keep="label"))
    else:
        model.points = (np.array([0.0, 1.0]), np.full(2, right[-1] / size if size else 0.5))
    drop_stored(known)
    return model


def _applied(stats: DataFrame, function, name: str, keep: str) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = function(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(values)], [keep, name])

    return stats.mapInArrow(apply, f"{keep} {stats.schema[keep].dataType.simpleString()}, {name} double")


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = PARTS, held: int = HELD,
           threshold: float = REJECT_BELOW) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    stats = store(measured(docs))
    model = fit(stats, labels, label, parts, held)
    scored = _applied(stats, model.score, "score", keep="doc_id")
    return scored.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, below: float = REJECT_BELOW) -> DataFrame:
    """The documents, all columns, without those whose score is below the threshold."""
    model = fit_documents(docs, labels)
    own = docs.schema

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if batch.num_rows:
                x = np.array([statistics(t.as_py() or "") for t in batch.column(batch.schema.get_field_index("text"))])
                yield batch.filter(pa.array(model.score(x) >= below))

    return docs.mapInArrow(good, own)


def fit_documents(docs: DataFrame, labels: DataFrame) -> Model:
    stats = store(measured(docs))
    model = fit(stats, labels)
    drop_stored(stats)
    return model
