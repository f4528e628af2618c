"""Hard negatives against all pairs, the tree against all edges, and odd rows."""

import math

import numpy as np
import pytest

from buildlens.llm import negatives


def brute(rows, anchors, positives=5, most=5):
    out = []
    ok = [(i, label, [math.floor(256 * float(c)) for c in v]) for i, label, v in rows
          if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    for a, label, x in {(i, label, tuple(x)) for i, label, x in ok if i in anchors}:
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, own == label) for i, own, y in ok if i != a and len(x) == len(y))
        for s, i, _ in [t for t in scored if t[2]][:positives]:
            fit = [(n, t) for t, n, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s][:most]
            out += [(a, i, k, n, -s, -t) for k, (n, t) in enumerate(fit, 1)]
    return sorted(out)


def clustered(n, length, seed, labels=4, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, length))
    rows = [(i, int(rng.integers(labels)), (centres[rng.integers(5)] + rng.choice([0.05, 0.3, 1]) * rng.normal(size=length)).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(n + i, int(rng.integers(labels)), rows[i % 7][2]) for i in range(copies)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, x string, rank int")


def found(spark, rows, step, **more):
    from pyspark.sql import functions as F
    out = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % step == 0, **more)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                          ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("chunk, batch", [(8192, 8192), (9, 50)])
def test_against_all_pairs(spark, monkeypatch, chunk, batch):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    monkeypatch.setattr(negatives, "BATCH", batch)
    rows = clustered(500, 6, 1, copies=120)
    got = found(spark, rows, 10)
    assert len(got) > 500
    assert got == brute(rows, set(range(0, 1000, 10)))


def test_ties_repeated_rows_and_odd_rows(spark):
    same = [(i, i % 3, [1.0, 2.0]) for i in range(40)]
    odd = [(100, None, [1.0, 2.0]), (200, 1, None), (300, 1, [1.0, None]), (400, 1, [float("nan"), 1.0]), (None, 1, [1.0, 2.0]), (500, 1, []),
           (600, 1, [float("inf"), 0.0]), (700, 1, [0.0, 0.0]), (710, 2, [0.0, 0.0]), (720, 1, [-1.0, -2.0]), (800, 5, [1.0, 2.0]), (900, 1, [1.0, 2.0, 3.0]),
           (901, 1, [1.0, 2.0, 3.0]), (902, 2, [1.0, 2.0, 2.5]), (20, 2, [1.0, 2.0]), (20, 2, [1.0, 2.0]), (21, 0, [1.0, 2.0])]
    rows = same + odd
    assert found(spark, rows, 10) == brute(rows, set(range(0, 1000, 10)))
    assert found(spark, [], 10) == []
    assert found(spark, odd[:7], 10) == []


def test_few_rows_are_rescored_where_anchors_lie_close():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 300
    x = np.floor(np.repeat(centres, 40, 0) + rng.normal(size=(800, 16)) * 3).astype(np.int64)
    import pyarrow as pa
    parent, edge = negatives.spanning_tree(x[::8].astype(float))
    chunk = negatives.Chunk(np.arange(0, 800, 8), [0] * 100, x[::8], parent, edge)
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array([0] * 800), pa.array(x.tolist())], ["id", "label", "x"])
    seen = [0, 0]
    best = [negatives.Best(5) for _ in range(100)]
    negatives._scan(chunk, iter([batch]), True, lambda i: (60 * 300 * 300 * 0.2, math.inf), lambda i, ids, s: best[i].add(s, ids), seen)
    assert seen[1] == 80_000 and seen[0] < 0.5 * seen[1]
    for i in range(100):
        scores = [(-int(x[8 * i] @ x[j]), j) for j in range(800) if j != 8 * i and x[8 * i] @ x[j] >= 60 * 300 * 300 * 0.2]
        assert [(-s, j) for s, j in zip(best[i].scores.tolist(), best[i].ids.tolist(), strict=True)] == sorted(scores)[:5]


def test_tree_is_minimum_and_walk_keeps_few_open():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    parent, edge = negatives.spanning_tree(x)
    points = np.vstack([x, np.zeros(3)])
    far = np.linalg.norm(points[:, None] - points[None], axis=2)
    inside, total = {200}, 0.0
    while len(inside) < 201:
        d, j = min((far[i, j], j) for i in inside for j in range(201) if j not in inside)
        inside.add(j)
        total += d
    assert math.isclose(edge.sum(), total, rel_tol=1e-9)
    for tree in (parent, np.arange(-1, 199), np.full(200, -1)):
        waiting, most, met = {-1}, 0, {-1}
        for i, p, last, leads in negatives.walk(tree):
            assert p in waiting and p == tree[i]
            met.add(i)
            if last:
                waiting.discard(p)
            if leads:
                waiting.add(i)
            most = max(most, len(waiting))
        assert len(met) == 201 and not waiting and most <= 9


def test_large_entries_and_text_labels(spark):
    from pyspark.sql import functions as F
    rows = [(i, "ab"[i % 2], [200_000.0 - i, 150_000.0, float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id int, label string, embedding array<double>")
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") == 10).collect()))
    assert got == brute(rows, {10}) and len(got) == 25
