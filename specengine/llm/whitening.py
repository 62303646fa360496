"""Whitening of embeddings by a Jacobi-Davidson eigensolver whose products run on Spark.

Entries become whole numbers floor(256 * c).  The covariance of the distinct
vectors is never formed: every product of it with a block of trial vectors is a
pass over the stored vectors, centred before it multiplies, and added up over
the tasks.  The driver holds blocks of (dimension x a few dozen) numbers only.

The solver keeps an orthonormal search space.  Each turn makes the
Rayleigh-Ritz approximations in it and locks the pairs whose residual has
reached double precision.  For the others of the leading pairs it solves the
correction equation, projected off the current approximations, by a few steps
of MINRES, and widens the space by the solutions.  The inner solvers of all
open pairs run in step, so that a pass serves all of them.  The space is thick:
it starts from more vectors than are wanted and keeps more at a restart, so
that none of the leading pairs is missed.

Defined cases: rows whose vector is null, empty or has null or non-finite
entries are dropped, and those whose length isn't the most common one (the
longer one in a tie).  Entries beyond 2^63 / 256 are held at the ends of LONG.
A component whose variance is zero (fewer distinct vectors than components) is
left out, so one distinct vector or an empty table gives no rows.  Repeated
rows come back each; in the fit a vector counts once.  A null id stays null.
`deviation` beyond LONG is null.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specengine.llm.common import stored
from specengine.llm.vectors import matrix, total, usable

COMPONENTS = 4
#: Entries per unit.
SCALE = 256
#: Vectors the search begins with and keeps at a restart, and the most it holds.
START, MOST = 16, 48
#: Steps of an inner solver, and the share of its residual at which it ends.
INNER_STEPS, INNER_SHARE = 6, 0.05
#: Residuals, relative to the largest eigenvalue: the goal, and what is accepted when rounding stops the descent.
GOAL, ACCEPTED = 2e-15, 1e-12
TURNS = 200

Product = Callable[[np.ndarray], np.ndarray]


def minres(shift: float, space: np.ndarray, right: np.ndarray, steps: int,
           share: float) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Solve P (A - shift) P t = right, P projecting off `space`: yields v, is sent A v, returns t."""
    def off(v: np.ndarray) -> np.ndarray:
        v = v - space @ (space.T @ v)
        return v - space @ (space.T @ v)

    right = off(right)
    size = np.linalg.norm(right)
    t = np.zeros_like(right)
    if size == 0:
        return t
    before, v, beta = np.zeros_like(right), right / size, 0.0
    c, s, c_old, s_old = 1.0, 0.0, 1.0, 0.0
    w, w_old, left = np.zeros_like(right), np.zeros_like(right), size
    for _ in range(steps):
        made = off((yield v) - shift * v) - beta * before
        alpha = v @ made
        made = off(made - alpha * v)
        after = np.linalg.norm(made)
        # Rotate the new column of the tridiagonal matrix and extend the solution along one direction.
        far, mid = s_old * beta, c_old * beta
        near, mid = c * alpha - s * mid, s * alpha + c * mid
        length = np.hypot(near, after)
        if length <= 1e-300:
            break
        c_old, s_old, c, s = c, s, near / length, after / length
        direction = (v - mid * w - far * w_old) / length
        t = t + left * c * direction
        left = -s * left
        w_old, w = w, direction
        if abs(left) <= share * size or after <= 1e-14 * abs(length):
            break
        before, v, beta = v, made / after, after
    return off(t)


def _together(solvers: list[Generator], product: Product) -> list[np.ndarray]:
    """Run the solvers in step: one product for the vectors that all of them ask for."""
    asked = {i: next_or(s) for i, s in enumerate(solvers)}
    done = {i: a[1] for i, a in asked.items() if a[0]}
    open_ = {i: a[1] for i, a in asked.items() if not a[0]}
    while open_:
        keys = list(open_)
        made = product(np.stack([open_[i] for i in keys], 1))
        for j, i in enumerate(keys):
            ended, value = next_or(solvers[i], made[:, j])
            if ended:
                done[i] = value
                del open_[i]
            else:
                open_[i] = value
    return [done[i] for i in range(len(solvers))]


def next_or(solver: Generator, value: np.ndarray | None = None) -> tuple[bool, np.ndarray]:
    """(False, what the solver asks for) or (True, its solution)."""
    try:
        return False, solver.send(value)
    except StopIteration as end:
        return True, end.value


def _orthonormal(new: np.ndarray, space: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `new` has beyond `space`."""
    kept = []
    for t in new.T:
        size = np.linalg.norm(t)
        if size == 0:
            continue
        t = t / size
        for _ in range(3):
            t = t - space @ (space.T @ t)
            for u in kept:
                t = t - u * (u @ t)
            size = np.linalg.norm(t)
            if size < 1e-10:
                break
            t = t / size
        else:
            kept.append(t)
    return np.stack(kept, 1) if kept else np.zeros((len(new), 0))


def leading_pairs(product: Product, d: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors of a symmetric positive matrix known by its products."""
    wanted = min(wanted, d)
    random = np.random.default_rng(seed)
    space = _orthonormal(random.standard_normal((d, min(d, max(START, 2 * wanted)))), np.zeros((d, 0)))
    made = product(space)
    best, idle = np.inf, 0
    for _ in range(TURNS):
        small = space.T @ made
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = space @ turn, made @ turn
        residual = image[:, :wanted] - ritz[:, :wanted] * values[:wanted]
        size = np.linalg.norm(residual, axis=0) / max(values[0], 1e-300)
        idle = 0 if size.max() < best / 2 else idle + 1
        best = min(best, size.max())
        if size.max() <= GOAL or space.shape[1] == d or (size.max() <= ACCEPTED and idle >= 3):
            return values[:wanted], ritz[:, :wanted] / np.linalg.norm(ritz[:, :wanted], axis=0)
        if space.shape[1] + wanted > min(MOST, d) and space.shape[1] > START and d > MOST:
            space, made = ritz[:, :START], image[:, :START]
            space, triangle = np.linalg.qr(space)
            made = np.linalg.solve(triangle.T, made.T).T
        open_ = [j for j in range(wanted) if size[j] > GOAL]  # the others are locked
        solvers = [minres(values[j], ritz[:, :wanted], -residual[:, j], INNER_STEPS, INNER_SHARE) for j in open_]
        new = _orthonormal(np.stack(_together(solvers, product), 1), space)
        if not new.shape[1]:
            new = _orthonormal(random.standard_normal((d, 1)), space)
        space, made = np.hstack((space, new)), np.hstack((made, product(new)))
    raise ArithmeticError(f"residuals still at {size.max():.1e} after {TURNS} turns")


def _exact_sum(x: np.ndarray) -> tuple[int, np.ndarray]:
    most = int(max(abs(int(x.max())), abs(int(x.min()))))
    sums = x.sum(0).astype(object) if most * len(x) < 1 << 62 else x.astype(object).sum(0)
    return len(x), sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n in double precision, the numerator n x - S exact while it fits."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums.tolist()))
    if most < 1 << 62:
        return (x * n - sums.astype(np.int64)) / n
    return x - (sums / n).astype(float)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums.tolist()))
    if most * most * x.shape[1] < 1 << 62:
        return ((x * n - sums.astype(np.int64)) ** 2).sum(1).tolist()
    found = ((x.astype(object) * n - sums) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in found]


def whole_numbers(df: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x): the rows that take part, their entries as whole numbers."""
    return usable(df, id_column, column).select("id", F.transform(
        "vector", lambda c: F.floor(c.cast("double") * F.lit(float(SCALE)))).alias("x"))


def whiten(df: DataFrame, id_column: str = "vec_id", column: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component; the docstring of the module has the defined cases.

    Columns: the id, component, n, deviation, whitened, explained, identity_error.
    """
    rows = whole_numbers(df, id_column, column)
    schema = T.StructType([
        T.StructField(id_column, rows.schema["id"].dataType), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType())])
    fit = stored(rows.select("x").distinct(), "whitening-fit").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = total(fit, _exact_sum)
        if found is None:
            return df.sparkSession.createDataFrame([], schema)
        n, sums = found
        d = len(sums)

        def product(block: np.ndarray) -> np.ndarray:
            def part(x: np.ndarray) -> tuple[np.ndarray]:
                c = _centred(x, n, sums)
                return (c.T @ (c @ block),)
            return total(fit, part)[0] / n

        def squares(x: np.ndarray) -> tuple[np.ndarray]:
            return ((_centred(x, n, sums) ** 2).sum(0),)

        trace = float(total(fit, squares)[0].sum()) / n
        if trace == 0:
            return df.sparkSession.createDataFrame([], schema)
        values, vectors = leading_pairs(product, d, components)
        keep = values > d * np.finfo(float).eps * trace
        values, vectors = values[keep], vectors[:, keep]
        onto = vectors / np.sqrt(values)

        def means(x: np.ndarray) -> tuple[np.ndarray]:
            return ((_centred(x, n, sums) @ onto).sum(0),)

        middle = total(fit, means)[0] / n

        def moments(x: np.ndarray) -> tuple[np.ndarray]:
            w = _centred(x, n, sums) @ onto - middle
            return (w.T @ w,)

        error = float(np.abs(total(fit, moments)[0] / n - np.eye(len(values))).max())
    finally:
        fit.unpersist()
    k, explained = len(values), values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            m = len(x)
            every = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n), pa.int64()), pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(every)),
                pa.array((_centred(x, n, sums) @ onto).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error))], names=schema.names)

    return rows.mapInArrow(project, schema)
