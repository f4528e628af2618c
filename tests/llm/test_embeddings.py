import numpy as np
import pytest

from buildlens.llm import embeddings


def brute(rows):
    own = {}
    for i, v in rows:
        ok = v and None not in v and np.isfinite(v).all() and any(v)
        own[i] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None
    links = {i: {j for j, y in own.items() if j != i and x is not None and y is not None and len(x) == len(y) and x @ y >= 0.95} for i, x in own.items()}
    component = {}
    for i in sorted(own):
        if i not in component:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in component:
                    component[j] = i
                    todo += links[j]
    return {i: (len(links[i]), component[i], component[i] == i) for i in own}


def vectors(n=300, length=64):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        base = rng.normal(size=length)
        for _ in range(int(rng.choice([1, 1, 2, 4]))):
            rows.append((len(rows), (base + rng.choice([0.0, 0.05, 0.2, 0.3]) * rng.normal(size=length)).astype(np.float32).tolist()))
    return rows


ODD = [(-1, None), (-2, [0.0] * 64), (-3, [float("nan")] * 64), (-4, [1.0, None]), (-5, [1.0]), (-6, [2.0]), (-7, [3.0]), (-8, [-3.0]), (-9, []), (-10, [float("inf"), 1.0])]


@pytest.mark.parametrize("block", [1500, 3])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors() + ODD
    rows += [(10_000 + i, v) for i, v in rows[:20]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, node int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    want = brute([(i, v) for i, v in rows])
    links = sum(w[0] for w in want.values())
    assert sum(f[0] for f in found.values()) >= 0.98 * links
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(found[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(found[i] == want[i] for i, _ in ODD)


def test_recall_of_filters_at_the_similarity():
    for n in (50, 5_000, 1_000_000):
        filters = embeddings.Filters(64, n)
        rng = np.random.default_rng(n)
        x, y = embeddings._random(500, 64, rng), embeddings._random(500, 64, rng)
        y -= (x * y).sum(1, keepdims=True) * x
        y = 0.95 * x + (1 - 0.95**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
        shared = [np.isin(a, b).any() for a, b in zip(filters.decode(x), filters.decode(y), strict=True)]
        assert np.mean(shared) > 0.95


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
