"""Whitening of vectors by a Jacobi-Davidson eigensolver over distributed products.

The covariance matrix is never formed. It is known by its products with a few columns: every task centres
its rows, multiplies them with the columns and sums ``(x - mean) ((x - mean) . columns)``, and the sums of all tasks
are added in a shuffle. The driver holds only columns of one vector's length.

The solver keeps a subspace with the products of its basis. Rayleigh-Ritz gives the best pairs there. A pair whose
residual has reached the rounding of the products is locked; for the others the projected correction
equation ``(I - QQ')(V - value)(I - QQ') t = -residual`` is solved by a few steps of MINRES, all open pairs in step
so that one pass serves them all, and the corrections widen the subspace. Pairs are locked from the largest on, and
GUARDS further pairs are followed, so that no eigenvalue is passed over. A full subspace is cut back to its best pairs.

Entries are scaled and rounded down to whole numbers. The fit is over distinct rounded vectors; sums, counts and
deviations are exact integers. Vectors that are null, or hold null, non-finite or no entries, are left out, and so are
entries of 2**62 and more. Vectors of different lengths are whitened apart from each other, each length by its own fit.
A component with no variance (equal vectors, fewer vectors than components) is whitened to 0 and explains 0.
A deviation of more than 38 digits is null. Repeated rows and null ids keep their rows. Columns of the input are kept,
but for those named like a result, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import drop_stored, small, store

COMPONENTS = 4
GUARDS = 2
SCALE = 256
INNER_STEPS = 12
INNER_TOLERANCE = 0.02
MOST_BASIS = 48
MOST_ROUNDS = 300
#: A residual of so many units of rounding of the products is as good as none.
ROUNDING = 16.0
#: Bytes of vectors that a task reads for a product at least, so that tasks add up rows rather than make them.
TASK_BYTES = 1 << 22
LARGEST = float(1 << 62)
HALF = 10**18
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Fit:
    """Exact sums of the distinct vectors, and the leading components (columns) of their covariance."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def rounded(rows: DataFrame, vector_col: str, scale: int = SCALE) -> DataFrame:
    """The rows that take part, with ``x``, their vector in whole numbers."""
    entries = F.col(vector_col).cast("array<double>")
    fits = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < LARGEST))
    taken = rows.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fits)
    return taken.withColumn("x", F.transform(entries, lambda c: F.floor(c * scale).cast("long")))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _total(x: np.ndarray) -> list[int]:
    """Exact sums of columns of whole numbers."""
    largest = int(np.abs(x).max(initial=0))
    return [int(s) for s in (x.sum(0) if largest * len(x) < 1 << 62 else x.astype(object).sum(0))]


def _squares(x: np.ndarray) -> np.ndarray:
    largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    x = x if largest < 1 << 31 else x.astype(object)
    return x * x


def _sums(vectors: DataFrame, length: int) -> tuple[list[int], list[int]]:
    """Exact sums of the entries and of their squares in every dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (2 * length)
        for batch in small(batches, 4000):
            x = _matrix(batch)
            total = [a + b for a, b in zip(total, _total(x) + _total(_squares(x)), strict=True)]
        exact = pa.decimal128(38, 0)
        high, low = zip(*(divmod(t, HALF) for t in total), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * length), pa.int32()), pa.array(map(Decimal, high), exact), pa.array(map(Decimal, low), exact)],
                                         ["at", "high", "low"])

    parts = vectors.select("x").mapInArrow(add, "at int, high decimal(38,0), low decimal(38,0)")
    found = {r["at"]: int(r["high"]) * HALF + int(r["low"]) for r in parts.groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    return [found[i] for i in range(length)], [found[length + i] for i in range(length)]


def covariance_product(vectors: DataFrame, n: int, mean: np.ndarray) -> Product:
    """Products of the covariance of ``x`` (divisor n) with a few columns, by one pass over the vectors each."""

    def product(columns: np.ndarray) -> np.ndarray:
        width = columns.shape[1]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(columns.shape)
            for batch in small(batches, 4000):
                centred = _matrix(batch) - mean
                total += centred.T @ (centred @ columns)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "part"])

        out = np.zeros(len(mean) * width)
        for row in vectors.select("x").mapInArrow(add, "at int, part double").groupBy("at").agg(F.sum("part").alias("total")).collect():
            out[row["at"]] = row["total"]
        return out.reshape(len(mean), width) / n

    return product


def minres(operator: Product, right: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Columns x with operator(x) near ``right``, every column solved for itself, all in step.

    ``operator`` is symmetric in each column; it may differ between columns. A column that has reached the tolerance,
    or whose Krylov space is exhausted, is left as it is.
    """
    tiny = np.finfo(float).tiny
    beta = np.linalg.norm(right, axis=0)
    start = beta.copy()
    x, last, before, older = (np.zeros_like(right) for _ in range(4))
    now = right / np.maximum(beta, tiny)
    beta_now = np.zeros_like(beta)
    eta, c0, c1, s0, s1 = beta.copy(), *np.ones((2, len(beta))), *np.zeros((2, len(beta)))
    for _ in range(steps):
        open_ = (np.abs(eta) > tolerance * start) & (beta > 0)
        if not open_.any():
            break
        made = operator(now)
        alpha = (now * made).sum(0)
        made = made - alpha * now - beta_now * last
        beta_next = np.linalg.norm(made, axis=0)
        delta = c1 * alpha - c0 * s1 * beta_now
        one = np.maximum(np.hypot(delta, beta_next), tiny)
        two, three = s1 * alpha + c0 * c1 * beta_now, s0 * beta_now
        c0, c1, s0, s1 = c1, delta / one, s1, beta_next / one
        step = (now - three * older - two * before) / one
        x = np.where(open_, x + c1 * eta * step, x)
        eta = np.where(open_, -s1 * eta, eta)
        older, before, last, now, beta_now = before, step, now, made / np.maximum(beta_next, tiny), beta_next
        beta = beta_next
    return x


def _orthonormal(columns: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns made orthogonal to others and to each other, twice; those of which nothing is left are gone."""
    out = np.zeros((len(columns), 0))
    for column in columns.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            for basis in (*against, out):
                column = column - basis @ (basis.T @ column)
        if size and np.linalg.norm(column) > 1e-8 * size:
            out = np.column_stack([out, column / np.linalg.norm(column)])
    return out


def leading_pairs(product: Product, length: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric operator known by its products."""
    rng = np.random.default_rng(seed)
    eps = np.finfo(float).eps
    wanted = min(wanted, length)
    follow = min(wanted + GUARDS, length)
    most = min(length, max(MOST_BASIS, 4 * follow))
    basis = _orthonormal(rng.normal(size=(length, min(length, 2 * follow))))
    made = product(basis)
    locked, locked_values, scale = np.zeros((length, 0)), np.zeros(0), 0.0
    best, since = math.inf, 0
    for _ in range(MOST_ROUNDS):
        small_matrix = basis.T @ made
        values, turn = np.linalg.eigh((small_matrix + small_matrix.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, made = basis @ turn, made @ turn
        scale = max(scale, *np.abs(values), *np.abs(locked_values))
        residuals = made - basis * values
        residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        enough = ROUNDING * eps * math.sqrt(length) * scale
        whole = basis.shape[1] + locked.shape[1] >= length
        since = 0 if sizes[0] < best / 2 else since + 1
        best = min(best, sizes[0])
        stalled = since > 8 and sizes[0] <= 1e-11 * scale
        done = 0
        while done < len(values) and (sizes[done] <= enough or whole or (stalled and not done)):
            done += 1
        if done:
            locked = np.column_stack([locked, basis[:, :done]])
            locked_values = np.append(locked_values, values[:done])
            basis, made, values, residuals, sizes = basis[:, done:], made[:, done:], values[done:], residuals[:, done:], sizes[done:]
            best, since = math.inf, 0
        if len(locked_values) >= wanted:
            least = np.sort(locked_values)[-wanted]
            # the next pair cannot come to stand above the least one wanted
            if not len(values) or sizes[0] <= max(enough, least - values[0]):
                order = np.argsort(-locked_values, kind="stable")[:wanted]
                return locked_values[order], locked[:, order]
        if basis.shape[1] + follow > most:
            keep = min(basis.shape[1], 2 * follow)
            basis, made = basis[:, :keep], made[:, :keep]
        goals = max(1, min(follow - len(locked_values), len(values)))
        near = np.column_stack([locked, basis[:, :goals]])

        def project(columns: np.ndarray) -> np.ndarray:
            return columns - near @ (near.T @ columns)

        def corrected(columns: np.ndarray) -> np.ndarray:
            columns = project(columns)
            return project(product(columns) - columns * values[:goals])

        steps = minres(corrected, -project(residuals[:, :goals]), INNER_STEPS, INNER_TOLERANCE) if len(values) else np.zeros((length, 0))
        new = _orthonormal(steps, locked, basis)
        if not new.shape[1]:
            new = _orthonormal(rng.normal(size=(length, 1)), locked, basis)
        if new.shape[1]:
            basis, made = np.column_stack([basis, new]), np.column_stack([made, product(new)])
    raise RuntimeError(f"{len(locked_values)} of {wanted} components settled; the residual of the next is {sizes[0]:.3g}")


def fit(vectors: DataFrame, n: int, length: int, components: int = COMPONENTS) -> Fit:
    """The fit of ``n`` distinct vectors ``x`` of one length."""
    vectors = vectors.coalesce(max(1, math.ceil(n * length * 8 / TASK_BYTES)))
    sums, squares = _sums(vectors, length)
    mean = np.array([s / n for s in sums])
    trace = sum(n * q - s * s for s, q in zip(sums, squares, strict=True)) / n**2
    product = covariance_product(vectors, n, mean)
    values, columns = leading_pairs(product, length, components)
    columns = columns * np.where(columns[np.abs(columns).argmax(0), np.arange(columns.shape[1])] < 0, -1, 1)
    values = np.where(values > 64 * np.finfo(float).eps * length * trace, values, 0.0)
    real = columns[:, values > 0]
    error = 0.0
    if real.shape[1]:
        spread = np.sqrt(values[values > 0])
        error = float(np.abs(real.T @ product(real) / np.outer(spread, spread) - np.eye(real.shape[1])).max())
    return Fit(n, sums, trace, values, columns, error)


def _deviations(x: np.ndarray, own: Fit) -> pa.Array:
    """Exact sums of (n * x - sums)**2 for every row."""
    largest = own.n * max(int(x.max()), -int(x.min())) + max(map(abs, own.sums))
    kind = np.int64 if largest**2 * x.shape[1] < 1 << 62 else object
    y = x.astype(kind) * own.n - np.array(own.sums, kind)
    total = (y * y).sum(1)
    exact = pa.decimal128(38, 0)
    return pa.array(total).cast(exact) if kind is np.int64 else pa.array([Decimal(t) if t < 10**38 else None for t in total], exact)


def whitened(rows: DataFrame, vector_col: str, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Every row that takes part, once for each of the leading components: its number from 1, how many vectors the fit has,
    the exact deviation of the row, its whitened coordinate, the share of the variance that the component explains, and the largest
    absolute entry of the whitened vectors' covariance minus the identity."""
    own = rows.drop(*[c for c in ("x", *RESULTS) if c != vector_col])
    taken = store(rounded(own, vector_col, scale))
    distinct = store(taken.select("x").distinct())
    sizes = {r["length"]: r["count"] for r in distinct.groupBy(F.size("x").alias("length")).count().collect()}
    fits = {length: fit(distinct.filter(F.size("x") == length), n, length, components) for length, n in sorted(sizes.items())}
    drop_stored(distinct)
    kept = [c for c in own.columns if c not in ("x", *RESULTS)]
    types = ["int", "long", "decimal(38,0)", "double", "double", "double"]
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {own.schema[c].dataType.simpleString()}" for c in kept), *map(" ".join, zip(RESULTS, types, strict=True))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4000):
            lengths = np.diff(np.asarray(batch.column("x").offsets))
            for length in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == length)))
                x, own_fit = _matrix(part), fits[length]
                spread = np.sqrt(np.where(own_fit.values > 0, own_fit.values, np.inf))
                k, m = len(spread), part.num_rows
                y = (x - own_fit.mean) @ (own_fit.components / spread)
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in kept), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, own_fit.n)),
                     _deviations(x, own_fit).take(at), pa.array(y.ravel()),
                     pa.array(np.tile(own_fit.values / own_fit.trace if own_fit.trace else np.zeros(k), m)), pa.array(np.full(m * k, own_fit.identity_error))],
                    [*kept, *RESULTS])

    return taken.select(*kept, "x").mapInArrow(project, schema)
