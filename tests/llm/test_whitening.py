"""Whitening against a dense eigensolver, exact sums, and odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from buildlens.llm import whitening


def dense(rows):
    x = np.array(sorted({tuple(int(np.floor(256 * float(c))) for c in v) for _, v in rows}), object)
    n, sums = len(x), x.sum(0)
    centred = (x - np.array([float(Fraction(int(s), n)) for s in sums])).astype(float)
    cov = centred.T @ centred / n
    values, columns = np.linalg.eigh(cov)
    return n, sums, cov, values[::-1], columns[:, ::-1]


def vectors(n, length, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    scale = spread ** np.arange(length)
    return [(i, (rng.normal(size=length) / 8 * scale + 0.3).astype(np.float32).tolist()) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, x string, n double")


@pytest.mark.parametrize("n, length, spread", [(600, 64, 1.0), (300, 24, 0.9), (40, 5, 1.0), (50, 3, 1.0), (3, 6, 1.0)])
def test_against_dense(spark, n, length, spread):
    rows = vectors(n, length, n, spread)
    rows += [(1000 + i, v) for i, v in rows[: n // 3]]
    got = whitening.whitened(table(spark, rows), "embedding").collect()
    count, sums, cov, values, columns = dense(rows)
    k = min(4, length)
    assert len(got) == k * len(rows)
    by = {(r.vec_id, r.component): r for r in got}
    positive = [c for c in range(k) if values[c] > 1e-9 * values[0]]
    for i, v in rows:
        x = np.array([int(np.floor(256 * float(c))) for c in v], object)
        for c in range(k):
            r = by[i, c + 1]
            assert (r.n, int(r.deviation)) == (count, sum((count * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
            assert r.identity_error <= 1e-10
            if c not in positive:
                assert (r.whitened, r.explained) == (0.0, 0.0)
            else:
                assert abs(r.explained / (values[c] / np.trace(cov)) - 1) < 1e-12
    signs = []
    for c in positive:
        x = np.array([[float(np.floor(256 * float(a))) for a in v] for _, v in rows])
        want = (x - np.array([float(Fraction(int(s), count)) for s in sums])) @ columns[:, c] / np.sqrt(values[c])
        mine = np.array([by[i, c + 1].whitened for i, _ in rows])
        signs.append(np.sign(want @ mine))
        assert np.abs(mine - signs[-1] * want).max() < 1e-8


@pytest.mark.parametrize("seed", range(6))
def test_solver_on_hard_spectra(seed):
    rng = np.random.default_rng(seed)
    length = 120
    q = np.linalg.qr(rng.normal(size=(length, length)))[0]
    spectrum = [np.linspace(1, 2, length), np.geomspace(1e-6, 1e3, length), np.r_[np.ones(length - 3), 5, 5, 5 + 1e-6], np.ones(length),
                np.r_[np.zeros(length - 2), 1, 2], np.r_[np.linspace(0, 1, length - 1), 1e6]][seed]
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    calls = []

    def product(columns):
        calls.append(columns.shape[1])
        return a @ columns

    values, found = whitening.leading_pairs(product, length, 4)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-11, atol=1e-12 * spectrum.max())
    assert np.abs(found.T @ found - np.eye(4)).max() < 1e-11
    assert np.linalg.norm(a @ found - found * values, axis=0).max() <= 2 * whitening.ROUNDING * np.finfo(float).eps * length**0.5 * spectrum.max()
    assert len(calls) < 400 and max(calls) <= 12


def test_minres_solves_each_column():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    right = rng.normal(size=(30, 4))
    shifts = np.array([0.0, 1.0, -2.0, 30.0])
    x = whitening.minres(lambda v: a @ v - v * shifts, right, 200, 1e-10)
    assert np.linalg.norm(a @ x - x * shifts - right, axis=0).max() < 1e-6


ODD = [(-1, None), (-2, [1.0, None]), (-3, [float("nan"), 1.0]), (-4, [float("inf"), 1.0]), (-5, []), (-6, [3e38, 1.0])]


def test_odd_rows_lengths_and_clashing_columns(spark):
    rows = vectors(30, 2) + [(100 + i, v) for i, v in vectors(20, 7, 2)] + [(200, [0.5]), (200, [0.5])]
    got = whitening.whitened(table(spark, rows + ODD), "embedding")
    assert got.columns == ["vec_id", "embedding", *whitening.RESULTS]
    got = got.collect()
    assert len(got) == 30 * 2 + 20 * 4 + 2
    assert {r.n for r in got if r.vec_id < 100} == {30} and {r.n for r in got if 100 <= r.vec_id < 200} == {20}
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got if r.vec_id == 200] == [(1, 0, 0.0, 0.0, 0.0)] * 2
    assert whitening.whitened(table(spark, ODD), "embedding").count() == 0
    assert whitening.whitened(table(spark, []), "embedding").count() == 0


def test_large_entries_are_summed_exactly(spark):
    rows = [(i, [float(2**50 + i), -float(2**52), float(i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whitened(df, "embedding").collect()}
    x = [[int(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {i: int(r.deviation) for i, r in got.items()} == {i: sum((5 * a - s) ** 2 for a, s in zip(x[i], sums, strict=True)) for i in range(5)}
