"""Hard negatives of anchors by bounds along a spanning tree.

Anchors are dealt into chunks. One task a chunk builds the minimum spanning tree of its anchors and the origin. A candidate's
score at an anchor is its score at the anchor's parent (0 at the origin), plus or minus the length of the edge times the candidate's
norm. Where that interval meets what the anchor still looks for, the candidate is rescored exactly; elsewhere
the interval, widened edge by edge, goes on to the children. Two passes over all rows serve a chunk: the first finds every
anchor's positives (the best rows of its label, so the interval must reach the last one found so far), the second the
best rows of other labels in the windows that the positives' scores set. Every task keeps only the best few for each anchor
or window, and rankings of these give the result, so it is exact. A chunk (at most about CHUNK anchors), its windows and its
tree are what the driver and each task hold.

A row without id, label or vector, and one with a null or non-finite entry, takes no part, and so do entries of 2**26 and more after
scaling. Vectors of different lengths do not meet. Rows that share an anchor's id are none of its positives or negatives; other
repeated rows are rows of their own; an anchor that is repeated whole is one. Ties go to the smaller id. Anchors without a
positive, and positives with an empty window, give no row. Extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from buildlens.llm.common import drop_stored, small, store, store_parts

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score is within these parts of the positive's, both included: 80 / 100 to 100 / 100.
LEAST, MOST, PARTS = 80, 100, 100
CHUNK = 8192
BATCH = 8192
LARGEST = float(1 << 26)
EXACT = 1 << 53


def rounded(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, x) of the rows that take part, x in whole numbers."""
    entries = F.col(vector_col).cast("array<double>")
    fits = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < LARGEST))
    taken = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector_col) > 0) & fits)
    return taken.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(entries, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1: the origin) and edge length of every row in the minimum spanning tree of the rows and the origin."""
    n = len(x)
    norms = (x * x).sum(1)
    near, parent = norms.copy(), np.full(n, -1)
    left = np.ones(n, bool)
    for _ in range(n):
        i = int(np.where(left, near, np.inf).argmin())
        left[i] = False
        away = np.maximum(norms + norms[i] - 2 * (x @ x[i]), 0)
        closer = left & (away < near)
        near[closer], parent[closer] = away[closer], i
    return parent, np.array([np.linalg.norm(x[i] - (x[p] if p >= 0 else 0)) for i, p in enumerate(parent.tolist())])


def walk(parent: np.ndarray) -> list[tuple[int, int, bool, bool]]:
    """(row, parent, whether it is the parent's last child, whether it has children), parents first and small subtrees first,
    so that few rows (the logarithm of their number) wait for a child at any time."""
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n + 1)]
    for i, p in enumerate(parent.tolist()):
        children[p].append(i)
    order, todo = [], list(children[-1])
    while todo:
        i = todo.pop()
        order.append(i)
        todo += children[i]
    size = np.ones(n, np.int64)
    for i in reversed(order):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    out: list[tuple[int, int, bool, bool]] = []
    stack = [(-1, sorted(children[-1], key=lambda c: (size[c], c)))]
    while stack:
        p, rest = stack[-1]
        if not rest:
            stack.pop()
            continue
        i = rest.pop(0)
        out.append((i, p, not rest, bool(children[i])))
        stack.append((i, sorted(children[i], key=lambda c: (size[c], c))))
    return out


class Chunk:
    """Anchors of one length with their tree."""

    def __init__(self, ids: np.ndarray, labels: list, x: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.ids, self.labels, self.x, self.edge = ids, labels, x, edge
        self.order = walk(parent)
        self.slack = 1e-12 * np.linalg.norm(x.astype(np.float64), axis=1)


def _packed(anchors: DataFrame, chunks: int) -> DataFrame:
    """A row for each chunk of anchors, with its tree."""
    kinds = dict(anchors.dtypes)

    def build(group: pa.Table) -> pa.Table:
        x = np.asarray(group.column("x").combine_chunks().flatten()).reshape(group.num_rows, -1)
        parent, edge = spanning_tree(x.astype(np.float64))
        return pa.table({"ids": [group.column("id").to_pylist()], "labels": [group.column("label").to_pylist()], "x": [np.ascontiguousarray(x).tobytes()],
                         "parent": [parent.tolist()], "edge": [edge.tolist()]}, schema=kind)

    kind = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(to_arrow_type(anchors.schema["label"].dataType))), ("x", pa.binary()),
                      ("parent", pa.list_(pa.int64())), ("edge", pa.list_(pa.float64()))])
    dealt = anchors.select("id", "label", "x", F.size("x").alias("length"),
                           F.pmod(F.xxhash64("id", "x"), F.lit(chunks)).alias("chunk"))
    return dealt.groupBy("length", "chunk").applyInArrow(build, f"ids array<long>, labels array<{kinds['label']}>, x binary, parent array<long>, edge array<double>")


class Best:
    """The best few (score, id) of a ranking: higher scores, then smaller ids."""

    __slots__ = ("most", "scores", "ids")

    def __init__(self, most: int):
        self.most, self.scores, self.ids = most, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """No lower score can come in."""
        return float(self.scores[-1]) if len(self.scores) == self.most else -math.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            first = np.lexsort((ids, -scores))[: self.most]
            self.scores, self.ids = scores[first], ids[first]


def _scan(chunk: Chunk, batches: Iterator[pa.RecordBatch], same: bool, wants: Callable[[int], tuple[float, float]],
          take: Callable[[int, np.ndarray, np.ndarray], None], seen: list[int] | None = None) -> None:
    """Go along the tree with every batch of candidates. ``wants`` tells the scores that an anchor looks for among rows of the same label or of
    other labels; ``take`` gets the ids and exact scores of the candidates that may be among them. ``seen`` counts scores and pairs."""
    length = chunk.x.shape[1]
    for batch in small(batches, BATCH):
        lengths = np.diff(np.asarray(batch.column("x").offsets))
        batch = batch.take(pa.array(np.flatnonzero(lengths == length)))
        if not batch.num_rows:
            continue
        ids = np.asarray(batch.column("id"))
        whole = np.asarray(batch.column("x").flatten()).reshape(-1, length)
        largest = max(int(np.abs(whole).max()), int(np.abs(chunk.x).max()))
        kind = np.float64 if largest * largest * length < EXACT else np.int64
        x, anchors = whole.astype(kind), chunk.x.astype(kind)
        norms = np.linalg.norm(whole.astype(np.float64), axis=1)
        of_label: dict[object, np.ndarray] = {}
        zero = np.zeros(len(ids))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {-1: (zero, zero)}
        for i, p, last, leads in chunk.order:
            low, high = bounds.pop(p) if last else bounds[p]
            reach = norms * (chunk.edge[i] * (1 + 1e-9) + chunk.slack[i]) + 0.5
            low, high = low - reach, high + reach
            label = chunk.labels[i]
            if label not in of_label:
                equal = pc.equal(batch.column("label"), pa.scalar(label, batch.column("label").type))
                of_label[label] = equal.to_numpy(zero_copy_only=False)
            least, most = wants(i)
            looked = (of_label[label] == same) & (high >= least) & (low <= most) & (ids != chunk.ids[i])
            n = int(np.count_nonzero(looked))
            if seen is not None:
                seen[0] += n
                seen[1] += len(ids)
            if n:
                if 4 * n >= len(ids):  # one product of the whole batch is cheaper than gathering rows, and settles all of it
                    scores = x @ anchors[i]
                    low = high = scores.astype(np.float64)
                    at = np.flatnonzero(looked & (scores >= least) & (scores <= most))
                    take(i, ids[at], scores[at].astype(np.int64))
                else:
                    at = np.flatnonzero(looked)
                    scores = x[at] @ anchors[i]
                    low[at] = high[at] = scores
                    good = (scores >= least) & (scores <= most)
                    take(i, ids[at[good]], scores[good].astype(np.int64))
            if leads:
                bounds[i] = (low, high)


def _positives(chunk: Chunk, most: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(most) for _ in chunk.ids]
        _scan(chunk, batches, True, lambda i: (best[i].least, math.inf), lambda i, ids, scores: best[i].add(scores, ids))
        yield _rows([(i, 0, b) for i, b in enumerate(best)])

    return search


def _negatives(chunk: Chunk, windows: list[dict[int, tuple[int, int]]], most: int):
    """``windows`` of every anchor: the least and the greatest score of a negative by the positive's score."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [{s: Best(most) for s in own} for own in windows]

        def wants(i: int) -> tuple[float, float]:
            if not best[i]:
                return math.inf, -math.inf
            return min(max(windows[i][s][0], b.least) for s, b in best[i].items()), max(w[1] for w in windows[i].values())

        def take(i: int, ids: np.ndarray, scores: np.ndarray) -> None:
            for s, b in best[i].items():
                least, greatest = windows[i][s]
                inside = (scores >= max(least, b.least)) & (scores <= greatest)
                b.add(scores[inside], ids[inside])

        _scan(chunk, batches, False, wants, take)
        yield _rows([(i, s, b) for i, own in enumerate(best) for s, b in own.items()])

    return search


def _rows(found: list[tuple[int, int, Best]]) -> pa.RecordBatch:
    counts = [len(b.ids) for _, _, b in found]
    keys = (np.repeat(np.array([row[k] for row in found], np.int64), counts) for k in (0, 1))
    ids, scores = (np.concatenate([np.zeros(0, np.int64), *(getattr(b, c) for _, _, b in found)]) for c in ("ids", "scores"))
    return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(ids), pa.array(scores)], ["anchor", "near", "id", "score"])


FOUND = "anchor long, near long, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _first(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor", "near").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = LEAST, most: int = MOST, parts: int = PARTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row with ``is_anchor`` and each of its first ``positives``
    rows of the same label the first ``negatives`` rows of other labels with ``least * positive <= parts * negative <= most * positive``."""
    candidates = store(rounded(rows, id_col, label_col, vector_col, scale))
    anchors = store(rounded(rows.filter(is_anchor), id_col, label_col, vector_col, scale).distinct())
    number = anchors.count()
    packs = store(_packed(anchors, max(1, math.ceil(number / CHUNK))).withColumn("pack", F.monotonically_increasing_id()))

    def chunk_results() -> Iterator[DataFrame]:
        for key in [r["pack"] for r in packs.select("pack").collect()]:
            row = packs.filter(F.col("pack") == key).first()
            ids = np.array(row["ids"], np.int64)
            chunk = Chunk(ids, row["labels"], np.frombuffer(row["x"], np.int64).reshape(len(ids), -1), np.array(row["parent"]), np.array(row["edge"]))
            ours = _first(candidates.mapInArrow(_positives(chunk, positives), FOUND), positives).select("anchor", "id", "score").collect()
            windows: list[dict[int, tuple[int, int]]] = [{} for _ in chunk.ids]
            for r in ours:
                low, high = -(-least * r["score"] // parts), most * r["score"] // parts
                if low <= high:
                    windows[r["anchor"]][r["score"]] = low, high
            theirs = _first(candidates.mapInArrow(_negatives(chunk, windows, negatives), FOUND), negatives)
            pairs = candidates.sparkSession.createDataFrame([(r["anchor"], int(ids[r["anchor"]]), r["id"], r["score"]) for r in ours],
                                                            "anchor long, anchor_id long, positive_id long, near long")
            joined = theirs.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(F.broadcast(pairs), ["anchor", "near"])
            yield joined.withColumnRenamed("near", "positive_score").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

    out = store_parts(candidates.sparkSession, chunk_results(), RESULT)
    drop_stored(candidates, anchors, packs)
    return out
