"""Near-duplicate vectors by spherical-cap filters.

The filters are the directions of a structured random code: a codeword for each half of the
coordinates, every pair of codewords being one filter. A vector passes all filters whose inner
product with it reaches a threshold; they are listed by decoding the halves, best codewords
first, without trying all pairs. Vectors meet where they share a filter, and every pair that meets is
verified in double precision. A pair that shares several filters counts at the least of them.

Equal vectors are one class and meet once. A filter with many vectors is split into blocks,
and every two blocks meet in a task of their own, so a task's memory is bounded; no pair is
left out. How many filters a code has follows the number of vectors (the mean filter holds
MEAN_BUCKET of them), its threshold from a mean of MEAN_PASSED filters for each vector. Codes
are added until RECALL of simulated pairs at exactly the similarity share a filter; pairs
closer than that are found more surely. Recall on data is measured in tests/llm.

Null, zero, or non-finite vectors link with nothing. Vectors of different lengths do not meet.
Repeated ids keep a row each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import store
from buildlens.llm.graph import components

SIMILARITY = 0.95
MEAN_BUCKET = 100
MEAN_PASSED = 14
RECALL = 0.99
SIMULATED = 600
MOST_CODES = 32
BLOCK = 1500


class Code:
    """A product code for vectors of one length, passed by about MEAN_PASSED filters for each vector."""

    def __init__(self, length: int, n: int, seed: int):
        rng = np.random.default_rng(seed)
        self.side = max(4, math.ceil(math.sqrt(max(1, n) * MEAN_PASSED / MEAN_BUCKET)))
        turn = rng.permutation(length)
        self.cut = [turn[: length // 2], turn[length // 2 :]] if length > 1 else [turn, turn]
        self.halves = []
        for part in self.cut:
            words = rng.normal(size=(self.side, len(part)))
            self.halves.append(words / np.linalg.norm(words, axis=1, keepdims=True) * math.sqrt(len(part) / length))
        self.least = 0.0
        left, best, _ = self._products(_random(SIMULATED // 2, length, rng))
        low, high = 0.0, 1.5
        for _ in range(20):
            mid = (low + high) / 2
            many = sum(np.searchsorted(-best[i], left[i] - mid, side="right").sum() for i in range(len(left))) / len(left)
            low, high = (mid, high) if many > MEAN_PASSED else (low, mid)
        self.least = low

    def _products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = (x[:, part] @ words.T for part, words in zip(self.cut, self.halves, strict=True))
        order = np.argsort(-right, axis=1)
        return left, np.take_along_axis(right, order, 1), order

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each row of unit vectors the filters that it passes."""
        left, best, order = self._products(x)
        out = []
        for i in range(len(x)):
            a = np.flatnonzero(left[i] + best[i, 0] >= self.least)
            n = np.searchsorted(-best[i], left[i, a] - self.least, side="right")
            take = np.repeat(a, n)
            nth = np.arange(len(take)) - np.repeat(np.cumsum(n) - n, n)
            out.append(take * self.side + order[i, nth])
        return out


def _random(n: int, length: int, rng: np.random.Generator) -> np.ndarray:
    x = rng.normal(size=(n, length))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Filters:
    """As many codes, each turned another way, as find RECALL of random pairs at exactly the similarity."""

    def __init__(self, length: int, n: int, similarity: float = SIMILARITY, seed: int = 11):
        rng = np.random.default_rng(seed)
        x, y = _random(SIMULATED, length, rng), _random(SIMULATED, length, rng)
        if length > 1:
            y -= (x * y).sum(1, keepdims=True) * x
            y = similarity * x + math.sqrt(1 - similarity**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        else:
            y = x
        missed = np.ones(SIMULATED, bool)
        self.codes: list[Code] = []
        while missed.mean() > 1 - RECALL and len(self.codes) < MOST_CODES:
            self.codes.append(Code(length, n, seed + len(self.codes) + 1))
            pairs = zip(self.codes[-1].decode(x), self.codes[-1].decode(y), strict=True)
            missed &= ~np.array([np.isin(a, b).any() for a, b in pairs])
        self.simulated_recall = 1 - missed.mean()

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        found = [[f + (i << 34) for f in code.decode(x)] for i, code in enumerate(self.codes)]
        return [np.sort(np.concatenate(own)) for own in zip(*found, strict=True)]


def classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, and for a vector that may link its unit vector in double precision, and a key that equal vectors share."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for v in batch.column(1):
                x = np.array([np.nan if y is None else y for y in v.as_py()], np.float64) if v.is_valid else np.zeros(0)
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if not top:
                    keys.append(None)
                    units.append(None)
                    continue
                x = x / top
                x = x / math.sqrt(float(x @ x)) + 0.0
                keys.append(hashlib.md5(x.tobytes()).digest())
                units.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "key", "unit"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vector_col).mapInArrow(unit, f"vec_id {kind}, key binary, unit binary")


def _links(similarity: float):
    def links(key: tuple, group: pa.Table) -> pa.Table:
        """Links of two blocks of a filter (or of one with itself): for each class that has one, how many vectors it
        links with at this filter for the first time, and the least class of its component here."""
        here = key[0].as_py()
        x = np.frombuffer(b"".join(group.column("unit").to_pylist())).reshape(group.num_rows, -1)
        node = np.asarray(group.column("node"))
        n = np.asarray(group.column("n"))
        block = np.asarray(group.column("block"))
        first = np.flatnonzero(block == key[1].as_py())
        second = np.flatnonzero(block == key[2].as_py())
        near = x[first] @ x[second].T >= similarity
        if key[1] == key[2]:
            np.fill_diagonal(near, False)
        own, other = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        near = near[np.ix_(own, other)]
        first, second = first[own], second[other]
        passed = group.column("passed").to_pylist()
        before = sorted({f for i in {*first.tolist(), *second.tolist()} for f in passed[i] if f < here})
        place = {f: i for i, f in enumerate(before)}

        def held(rows: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows), len(before)), np.float32)
            for r, i in enumerate(rows.tolist()):
                out[r, [place[f] for f in passed[i] if f < here]] = 1
            return out

        new = near & (held(first) @ held(second).T == 0)
        least = {int(node[i]): int(node[i]) for i in (*first, *second)}
        rows: dict[int, int] = dict.fromkeys(least, 0)
        for side, far, m in ((first, second, new), (second, first, new.T)) if key[1] != key[2] else ((first, second, new),):
            for i, total in zip(side.tolist(), (m @ n[far]).tolist(), strict=True):
                rows[int(node[i])] += int(total)
        joined = _join(near, first, second, node)
        ids = list(rows)
        return pa.table({"node": pa.array(ids, pa.int64()), "links": pa.array([rows[i] for i in ids], pa.int64()),
                         "least": pa.array([joined[i] for i in ids], pa.int64())})

    return links


def _join(near: np.ndarray, first: np.ndarray, second: np.ndarray, node: np.ndarray) -> dict[int, int]:
    """Least node of each node's component in a bipartite link matrix."""
    low_first, low_second = node[first].copy(), node[second].copy()
    both: dict[int, int] = {}
    while True:
        for i in range(len(first)):
            low_first[i] = min(low_first[i], low_second[near[i]].min(initial=low_first[i]))
        for j in range(len(second)):
            low_second[j] = min(low_second[j], low_first[near[:, j]].min(initial=low_second[j]))
        now: dict[int, int] = {}
        for k, v in (*zip(node[first].tolist(), low_first.tolist(), strict=True), *zip(node[second].tolist(), low_second.tolist(), strict=True)):
            now[k] = min(v, now.get(k, v))
        low_first = np.array([now[k] for k in node[first].tolist()], np.int64)
        low_second = np.array([now[k] for k in node[second].tolist()], np.int64)
        if now == both:
            return now
        both = now


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (the least vec_id of its component), kept."""
    rows = store(classes(vectors, id_col, vector_col))
    known = store(rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
                  .withColumn("node", F.monotonically_increasing_id()))
    sizes = {r["size"]: r["count"] for r in known.groupBy(F.octet_length("unit").alias("size")).count().collect()}
    codes = {size: Filters(size // 8, n, similarity) for size, n in sizes.items()}
    base = {size: i << 40 for i, size in enumerate(sorted(sizes))}

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit").to_pylist()
            found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(units)
            for size, code in codes.items():
                at = [i for i, u in enumerate(units) if len(u) == size]
                for begin in range(0, len(at), 500):
                    part = at[begin : begin + 500]
                    caps = code.decode(np.frombuffer(b"".join(units[i] for i in part)).reshape(len(part), -1))
                    for i, cap in zip(part, caps, strict=True):
                        found[i] = cap + base[size]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("unit"), pa.array(found, pa.list_(pa.int64()))],
                                             ["node", "n", "unit", "passed"])

    decoded = store(known.select("node", "n", "unit").mapInArrow(passes, "node long, n long, unit binary, passed array<long>"))
    members = decoded.select("*", F.explode("passed").alias("cap"))
    blocks = members.groupBy("cap").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    dealt = members.join(blocks, "cap").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = meets.select("cap", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "node", "n", "unit", "passed", "block")
    found = store(placed.groupBy("cap", "a", "b").applyInArrow(_links(similarity), "node long, links long, least long"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    own = (known.select("key", "n", "least_id", "node").join(linked, "node", "left").join(joined, "node", "left")
           .withColumn("component", F.coalesce("component", "node")))
    ids = own.groupBy("component").agg(F.min("least_id").alias("component_id"))
    result = own.join(ids, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return (rows.select("vec_id", "key").join(result, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
