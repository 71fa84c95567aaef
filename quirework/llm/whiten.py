"""Embedding whitening: a distributed centred scatter, cyclic Jacobi on the driver, and a matrix sent to all tasks.

1. Entries become integers; sums by dimension give the mean. All sums of integers are exact, so they don't depend on
   how rows are dealt to tasks.
2. Each task adds up the scatter of its rows around the rounded mean, as integers again; what rounding left of the mean
   is taken off at the end. A task emits one row for each pair of dimensions, whatever its rows.
3. The driver holds one number for each pair of dimensions. Symmetric Jacobi rotations go over all pairs in order until
   every off-diagonal entry is negligible against its own diagonal ones, which keeps small eigenvalues accurate.
4. Components are sorted by eigenvalue; the matrix of unit vectors is broadcast (dimensions times components doubles).

Edge cases: vectors that are null, empty, or hold a null or non-finite entry are dropped. Vectors of another length than
the most frequent one (of equally frequent ones the longest) are dropped too. Entries are held within ENTRY_LIMIT. A
component without variance, to double precision, gives a null `whitened` and doesn't count for the identity error. A
deviation beyond a long is null. Null and repeated ids are rows like others. An empty table, or one without such vectors,
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Largest size of an integer entry.
ENTRY_LIMIT = 1 << 40
#: Rows that a task multiplies at once.
BLOCK_ROWS = 1 << 12
_EXACT = 1 << 53


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key and x (integers) of the vectors that count, of one length."""
    v = F.col(column)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = table.where(fine).select(F.col(key).alias("key"), v.cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.struct("n", "d")).alias("b")).first()["b"]
    d = best["d"] if best else 0
    limit = float(ENTRY_LIMIT)
    x = F.transform("v", lambda e: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), e * SCALE))).cast("long") + SHIFT)
    return rows.where(F.size("v") == d).select("key", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            yield part, _matrix(part.column(column))


def products(y: np.ndarray) -> np.ndarray:
    """y^T y of integers, exact: by floating point where nothing can be rounded, else by whole numbers of any size."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < _EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    big = y.astype(object)
    return big.T @ big


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension: one row a task and dimension is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in _blocks(batches, 0):
            s = x.sum(0) if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object).sum(0)
            total = s.astype(object) if total is None else total + s
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(s) for s in total])], ["i", "n", "s"])

    parts = rows.select("x").mapInArrow(add, "i int, n long, s string")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    found.sort(key=lambda r: r.i)
    return (found[0].n if found else 0), [int(r.s) for r in found]


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of x (divisor n): integer scatter around the rounded mean, less what rounding left of it."""
    d = len(sums)
    middle = [round_half(s, n) for s in sums]
    centre = np.array(middle, np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0):
            if len(x):
                s = products(x - centre).astype(object)
                total = s if total is None else total + s
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in total[i, j]])], ["i", "j", "s"])

    parts = rows.select("x").mapInArrow(scatter, "i int, j int, s string")
    out = np.zeros((d, d))
    left = [s - n * m for s, m in zip(sums, middle, strict=True)]
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect():
        # Whole numbers up to the last division.
        out[r.i, r.j] = out[r.j, r.i] = (int(r.s) * n - left[r.i] * left[r.j]) / (n * n)
    return out


def round_half(s: int, n: int) -> int:
    return (2 * s + n) // (2 * n)


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic rotations.

    A rotation is due while an off-diagonal entry exceeds 2^-52 of the geometric mean of its diagonal ones.
    """
    a = np.array(matrix, np.float64)
    d = len(a)
    v = np.eye(d)
    floor = np.abs(a).max(initial=0.0) * 1e-300
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= max(floor, 2.0**-52 * np.sqrt(abs(a[p, p]) * abs(a[q, q]))) or abs(off) <= 2.0**-1000:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = np.copysign(1.0, theta) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                diagonal = a[p, p] - t * off, a[q, q] + t * off
                row_p, row_q = a[p].copy(), a[q].copy()
                a[p], a[q] = c * row_p - s * row_q, s * row_p + c * row_q
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q] = diagonal
                a[p, q] = a[q, p] = 0.0
                v_p = v[:, p].copy()
                v[:, p], v[:, q] = c * v_p - s * v[:, q], s * v_p + c * v[:, q]
        if not turned:
            break
    else:
        raise ArithmeticError("Jacobi rotations have not converged")
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order] / np.linalg.norm(v[:, order], axis=0)


class Whitening:
    """n, sums, and of each component the unit vector over the root of its eigenvalue, and its share of the trace."""

    def __init__(self, n: int, sums: list[int], matrix: np.ndarray, components: int):
        values, basis = jacobi(matrix)
        k = min(components, len(sums))
        self.n, self.sums = n, sums
        trace = float(np.trace(matrix))
        self.explained = (values[:k] / trace if trace > 0 else np.zeros(k)).clip(0.0, 1.0)
        usable = values[:k] > max(len(sums) * 2.0**-52 * max(float(values.max(initial=0.0)), 0.0), 0.0)
        self.usable = usable
        self.matrix = np.where(usable, basis[:, :k] / np.sqrt(np.where(usable, values[:k], 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part is exact, the rest is one division."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.matrix

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        y = x - whole
        # n * x - S = n * y - rest, with rest below n.
        most = (np.abs(y).astype(np.float64).max(initial=0.0) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 2.0**62:
            z = y * self.n - rest.astype(np.int64)
            return (z * z).sum(1).tolist()
        z = y.astype(object) * self.n - rest
        return [int(v) if v < 1 << 63 else None for v in (z * z).sum(1)]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (key, x); None without rows. The driver gets numbers for pairs of dimensions only."""
    n, sums = _sums(rows)
    return Whitening(n, sums, covariance(rows, n, sums), components) if n else None


def identity_error(rows: DataFrame, sent) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, from the rows themselves."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0):
            if len(x):
                w = sent.value.whitened(x)
                s = np.concatenate([w.sum(0)[None], w.T @ w])
                total = s if total is None else total + s
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    w = sent.value
    k = len(w.usable)
    total = np.zeros((k + 1, k))
    for r in rows.select("x").mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    mean = total[0] / w.n
    error = np.abs(total[1:] / w.n - np.outer(mean, mean) - np.eye(k))[np.ix_(w.usable, w.usable)]
    return float(error.max(initial=0.0))


def whiten(table: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error of each vector and component."""
    kind = table.schema[key].dataType
    fields = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, t) for n, t in fields)])
    rows = vectors(table, key, column)
    found = fit(rows, components)
    if found is None:
        return table.sparkSession.createDataFrame([], schema)
    # As many doubles as dimensions times components.
    sent = table.sparkSession.sparkContext.broadcast(found)
    error = identity_error(rows, sent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        k = len(w.usable)
        for part, x in _blocks(batches, 1):
            n = len(x)
            if not n:
                continue
            out = w.whitened(x)
            again = np.repeat(np.arange(n), k)
            columns = [
                part.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, w.n), pa.int64()), pa.array(w.deviation(x), pa.int64()).take(pa.array(again)),
                pa.array(out.ravel(), mask=np.tile(~w.usable, n)), pa.array(np.tile(w.explained, n)), pa.array(np.full(n * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(emit, schema)
