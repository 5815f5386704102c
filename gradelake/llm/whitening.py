"""Whitening of vectors by their leading covariance eigenvectors, found by contour integration (FEAST).

Entries are scaled to integers, so sums and products are exact and don't depend on how rows are dealt to tasks. The
driver and each solving task hold matrices of the vectors' dimension; nothing else leaves the tasks but sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Entries beyond this, times the scale, don't fit a long.
LARGEST = 2.0**62
#: Eigenvalues that one contour should enclose at most, quadrature nodes on its upper half, rounds before the subspace grows.
ENCLOSED, NODES, ROUNDS = 8, 8, 12
_LIMB = 1 << 62


@dataclass(frozen=True)
class Fit:
    """What the fit list tells: its size, integer sums, eigenvectors (a column each) and eigenvalues, and the trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)


def usable(vector: Column) -> Column:
    """True for vectors without null, infinite, NaN or immense entries; false for null."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) * SCALE < LARGEST))
    return F.coalesce(fine, F.lit(False))


def remaining(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``key, vector`` of the usable rows that have the commonest length (of equally common ones the larger), and that length."""
    rows = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    return rows.where(F.size("vector") == size), size


def _integers(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
    return np.floor(flat * SCALE).astype(np.int64) + OFFSET


def _exact(a: np.ndarray, limit: int) -> np.ndarray:
    """``a`` as it is if sums bounded by ``limit`` fit 62 bits, else as Python's integers."""
    return a if limit < _LIMB else a.astype(object)


def _largest(a: np.ndarray) -> int:
    return max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))


def _products(y: np.ndarray) -> np.ndarray:
    """Exact ``y.T @ y`` of integers."""
    bound = _largest(y) ** 2 * max(len(y), 1)
    if bound < 1 << 53:
        real = y.astype(np.float64)
        return (real.T @ real).astype(np.int64)
    y = _exact(y, bound)
    return y.T @ y


def _limbs(value: int) -> tuple[Decimal, Decimal]:
    high, low = divmod(int(value), _LIMB)
    return Decimal(high), Decimal(low)


_SUMS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def _summed(rows: DataFrame, size: int, collect) -> tuple[int, dict[tuple[int, int], int]]:
    """Rows, and sums over all of them of the integer table that ``collect`` makes of a block; one partial table leaves a task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                table = collect(_integers(batch.column(0), size)).astype(object)
                total, n = (table if total is None else total + table), n + batch.num_rows
        if total is not None:
            cells = [(-1, -1, *_limbs(n))] + [(i, j, *_limbs(v)) for (i, j), v in np.ndenumerate(total) if i <= j or total.shape[0] == 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*cells), (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0)))], ["i", "j", "high", "low"]
            )

    sums = rows.select("vector").mapInArrow(partial, _SUMS).groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = {(r["i"], r["j"]): int(r["high"]) * _LIMB + int(r["low"]) for r in sums.toLocalIterator()}
    return found.pop((-1, -1), 0), found


def covariance(rows: DataFrame, size: int) -> tuple[int, list[int], np.ndarray]:
    """Size, integer sums and covariance (divisor n) of :func:`remaining`'s vectors.

    Products are taken of entries less the mean's nearest integer, and the rest of the mean is taken off in exact integers:
    every entry of the covariance is the true value, rounded once.
    """
    n, found = _summed(rows, size, lambda x: _exact(x, _largest(x) * len(x)).sum(0)[None, :])
    sums = [found[0, i] for i in range(size)] if n else [0] * size
    near = [(2 * s + n) // (2 * n) if n else 0 for s in sums]
    centre = np.array(near, np.int64)
    _, products = _summed(rows, size, lambda x: _products(x - centre))
    v = np.zeros((size, size))
    rest = [s - n * m for s, m in zip(sums, near)]
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    return n, sums, v


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix that is orthogonally similar to the symmetric ``a`` (Householder)."""
    a = np.array(a, np.float64)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        block = a[k + 1 :, k + 1 :]
        p = block @ x
        w = p - (x @ p) * x
        block -= 2 * (np.outer(x, w) + np.outer(w, x))
        column = a[k + 1 :, k] - 2 * x * (x @ a[k + 1 :, k])
        a[k + 1 :, k] = column
        a[k, k + 1 :] = column
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: the positive pivots of the shifted matrix (Sylvester's law of inertia)."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), np.finfo(float).tiny)
    least, count, pivot = float(np.finfo(float).eps * scale * 1e-3), 0, 1.0
    squares = (off * off).tolist()
    for i, d in enumerate(diagonal.tolist()):
        pivot = d - shift - (squares[i - 1] / pivot if i else 0.0)
        if abs(pivot) < least:
            pivot = -least
        count += pivot > 0
    return count


def intervals(diagonal: np.ndarray, off: np.ndarray, wanted: int, norm: float) -> list[tuple[float, float, int]]:
    """Intervals that together hold the ``wanted`` largest eigenvalues (and what is tied with the last), with the number in each.

    Edges lie where no eigenvalue is near; an interval holds more than :data:`ENCLOSED` only if its eigenvalues cluster.
    """
    fine = 1e-12 * norm
    low, high = -norm * 1e-3, norm * 1.001
    while high - low > fine and above(diagonal, off, low) != wanted:
        middle = (low + high) / 2
        low, high = (middle, high) if above(diagonal, off, middle) >= wanted else (low, middle)
    gap = lambda s: above(diagonal, off, s - fine) == above(diagonal, off, s + fine)
    while not gap(low):
        low -= 4 * fine
    high, done, todo = norm * 1.001, [], []
    todo.append((low, above(diagonal, off, low), high, 0))
    while todo:
        a, n_a, b, n_b = todo.pop()
        if n_a == n_b:
            continue
        cuts = [a + (b - a) * part for part in (0.5, 0.47, 0.53, 0.43, 0.57, 0.39, 0.61)]
        cut = next((c for c in cuts if gap(c)), None) if n_a - n_b > ENCLOSED and b - a > 1e4 * fine else None
        if cut is None:
            done.append((a, b, n_a - n_b))
        else:
            n_cut = above(diagonal, off, cut)
            todo += [(a, n_a, cut, n_cut), (cut, n_cut, b, n_b)]
    return done


def enclosed(v: np.ndarray, a: float, b: float, count: int) -> np.ndarray:
    """Orthonormal eigenvectors of the ``count`` eigenvalues within ``a`` to ``b``, by FEAST.

    Quadrature of the resolvent on a circle projects a random subspace onto the wanted eigenspace, Rayleigh-Ritz finds the
    vectors in it, and they start the next round. The subspace grows until all that inertia counts are found to double precision.
    """
    d, norm = len(v), max(np.abs(v).sum(1).max(), np.finfo(float).tiny)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (a + b) / 2, (b - a) / 2
    turns = np.exp(0.5j * np.pi * (1 + nodes))
    inverses = [np.linalg.inv((centre + radius * t) * np.eye(d) - v) for t in turns]
    random, width = np.random.default_rng(count), min(d, count + max(4, count // 2))
    while True:
        y, last = random.standard_normal((d, width)), np.inf
        for _ in range(ROUNDS):
            q = sum(w / 2 * (radius * t * (inverse @ y)).real for w, t, inverse in zip(weights, turns, inverses))
            q, _ = np.linalg.qr(q if width < d else y)
            values, small = np.linalg.eigh(q.T @ v @ q)
            y = q @ small
            inside = (values > a) & (values <= b)
            worst = np.abs(v @ y[:, inside] - y[:, inside] * values[inside]).max(initial=0)
            if inside.sum() == count and (worst <= 1e-15 * norm or (worst <= 1e-12 * norm and worst >= last / 2)):
                return y[:, inside]
            last = worst
        if width == d:
            if count < d and inside.sum() != count:
                raise ArithmeticError(f"{inside.sum()} eigenvalues found between {a} and {b}, inertia tells {count}")
            return y[:, inside]
        width = min(d, 2 * width)


def leading(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the ``wanted`` largest; each interval is solved in a task of its own.

    Inertia counts give each interval's number of eigenvalues, so none is missed. A last Rayleigh-Ritz step over all
    that were found makes vectors of neighbouring intervals orthogonal. Eigenvalues that are zero to double precision
    are left out. Of each vector the entry that is largest in size is positive.
    """
    size = len(v)
    norm = float(np.abs(v).sum(1).max(initial=0))
    if not norm or not wanted:
        return np.zeros(0), np.zeros((size, 0))
    shifted = v / norm
    diagonal, off = tridiagonal(shifted)
    cuts = intervals(diagonal, off, min(wanted, size), 1.0)
    matrix = spark.sparkContext.broadcast(shifted)  # square of the dimension

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = enclosed(matrix.value, row["a"], row["b"], row["n"])
                yield pa.RecordBatch.from_arrays([pa.array([row["a"]]), pa.array([found.T.tobytes()], pa.binary())], ["a", "found"])

    todo = spark.createDataFrame(cuts, "a double, b double, n int").repartition(len(cuts), "a")
    found = sorted(todo.mapInArrow(solve, "a double, found binary").collect())  # at most the matrix again
    q = np.vstack([np.frombuffer(f["found"]).reshape(-1, size) for f in found]).T
    matrix.unpersist()
    q, _ = np.linalg.qr(q)
    values, small = np.linalg.eigh(q.T @ shifted @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], (q @ small)[:, order]
    kept = values > size * np.finfo(float).eps * max(values.max(initial=0), 0)
    values, vectors = values[kept], vectors[:, kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if vectors.size else 1.0
    return values * norm, vectors * signs


def fit(rows: DataFrame, size: int, wanted: int = COMPONENTS) -> Fit:
    """Mean, eigenvectors and eigenvalues of :func:`remaining`'s vectors."""
    n, sums, v = covariance(rows, size)
    values, vectors = leading(rows.sparkSession, v, wanted)
    return Fit(n, tuple(sums), vectors, values, float(np.trace(v)))


def _centred(x: np.ndarray, found: Fit) -> np.ndarray:
    """Exact ``n * x - sums``."""
    near = [(2 * s + found.n) // (2 * found.n) for s in found.sums]
    y = x - np.array(near, np.int64)
    rest = [found.n * m - s for m, s in zip(near, found.sums)]
    limit = found.n * (_largest(y) + 1)
    return _exact(y, limit) * found.n + np.array(rest, np.int64 if limit < _LIMB else object)


def _whitened(centred: np.ndarray, found: Fit) -> np.ndarray:
    return (centred / found.n).astype(np.float64) @ found.vectors / np.sqrt(found.values)


def identity_error(rows: DataFrame, found: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over all of them."""
    k = len(found.values)
    if not k or not found.n:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = _whitened(_centred(_integers(batch.column(0), found.dimension), found), found)
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        i, j = np.divmod(np.arange(total.size), k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "total"])

    sums = rows.select("vector").mapInArrow(partial, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    total = np.zeros((k + 1, k))
    for row in sums.collect():
        total[row["i"], row["j"]] = row["total"] / found.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per remaining vector and component.

    Vectors that are null or hold null, infinite, NaN or immense entries (beyond a long when scaled) go, and so do those whose
    length is not the commonest (of equally common ones the larger). Repeated and null keys are rows like any other. There are
    as many components as the dimension and :data:`COMPONENTS` allow, less those whose eigenvalue is zero to double
    precision: equal vectors, a single one or an empty table give no rows. ``deviation`` is exact; null where it exceeds a long.
    Other columns are not looked at.
    """
    kind = rows.schema[key].dataType.simpleString()
    rows, size = remaining(rows, key, vector)
    found = fit(rows, size, wanted)
    error, k = identity_error(rows, found), len(found.values)
    explained = found.values / found.trace if k else found.values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if k else ():
            centred = _centred(_integers(batch.column(1), found.dimension), found)
            whitened = _whitened(centred, found)
            square = _exact(centred, _largest(centred) ** 2 * found.dimension)
            deviation = [int(s) if s < 1 << 63 else None for s in (square * square).sum(1)]
            rows = len(whitened)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, found.n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(whitened.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(project, schema)
