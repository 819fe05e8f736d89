"""Embedding whitening by cyclic Jacobi rotations.

Vectors become integers, so sums, the centred scatter and deviations are exact
and do not depend on how rows are dealt: each task adds up its own part in whole
numbers and Spark adds the parts. The covariance matrix, of as many rows as a
vector has components, is diagonalised on the driver by cyclic sweeps of Jacobi
rotations until nothing is left off the diagonal, which also keeps small
eigenvalues accurate. The whitening matrix goes to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SCALE, OFFSET = 1024, 100_000
# Components count as whole numbers of at most so many; larger ones count as this.
MOST = 1 << 45
SWEEPS = 60
EXACT = 1 << 53


def vectors(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows that take part, as ``k`` and ``x``, an array of longs.

    Rows whose vector is null or empty, or has a null or non-finite component,
    are left out, and so are those whose vector has not the number of components
    that most rows have (the greater one where two are as frequent). Keys may
    repeat or be null. A component c becomes floor(1024 c) + 100000; beyond
    2**45 either way it counts as that.
    """
    whole = embeddings.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    whole = whole.where(F.forall("v", finite))
    counts = whole.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    near = lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("long") + OFFSET
    return whole.where(F.size("v") == (counts[0].d if counts else 0)).select("k", F.transform("v", near).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        if len(column):
            yield column.flatten().to_numpy().reshape(len(column), -1)


def _add_up(x: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], number: pa.DataType) -> dict[tuple[int, int], object]:
    """The sums of ``of_block``'s table over all rows, by place on and above its diagonal.

    Each task sends one row for each row of its table; Spark adds them up by
    place, so the driver gets one table whatever the number of tasks.
    """
    as_number = int if pa.types.is_decimal(number) else float

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks(batches):
            here = of_block(block)
            total = here if total is None else total + here
        if total is not None:
            values = pa.array([[as_number(v) for v in row[i:]] for i, row in enumerate(total)], pa.list_(number))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], ["i", "parts"])

    kind = "decimal(38,0)" if as_number is int else "double"
    parts = x.mapInArrow(run, f"i int, parts array<{kind}>").select("i", F.posexplode("parts").alias("j", "part"))
    sums = parts.groupBy("i", "j").agg(F.sum("part").alias("total")).collect()  # one row for each two components
    return {(r.i, r.i + r.j): as_number(r.total) for r in sums}


WHOLE = pa.decimal128(38, 0)


def exact_product(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` in whole numbers, by products of doubles as long as those are exact."""
    most = int(np.abs(y).max(initial=0))
    rows = EXACT // max(1, most * most)
    if rows < 1:
        wide = y.astype(object)
        return wide.T.dot(wide)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def turn(m: np.ndarray, p: np.ndarray, q: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
    """Rotates rows ``p`` against rows ``q``."""
    up, low = m[p], m[q]
    m[p] = c * up - s * low
    m[q] = s * up + c * low


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    A sweep meets every pair once, in rounds of disjoint pairs, whose rotations
    are applied together. A pair is left alone once its entry is below the
    rounding of its two diagonal entries' geometric mean.
    """
    a = np.array(matrix, np.float64)
    n = len(a)
    v = np.eye(n)  # eigenvectors in rows until the end
    ring = list(range(n + n % 2))
    for _ in range(SWEEPS):
        turned = 0
        for _ in range(len(ring) - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if max(p, q) < n]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            off = a[p, q]
            far = np.abs(off) > np.finfo(float).eps * np.sqrt(np.abs(a[p, p] * a[q, q]))
            p, q, off = p[far], q[far], off[far]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not len(p):
                continue
            turned += len(p)
            with np.errstate(over="ignore"):
                slope = (a[q, q] - a[p, p]) / (2 * off)
                t = np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.hypot(slope, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            shift = t * off
            dp, dq = a[p, p] - shift, a[q, q] + shift
            turn(v, p, q, c[:, None], s[:, None])
            turn(a, p, q, c[:, None], s[:, None])
            a = a.T.copy()
            turn(a, p, q, c[:, None], s[:, None])
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = dp, dq
        if not turned:
            break
    else:
        raise ArithmeticError(f"entries are left off the diagonal after {SWEEPS} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], (v[order] / np.linalg.norm(v[order], axis=1, keepdims=True)).T


@dataclass(frozen=True)
class Whitening:
    """What was fitted: sums, eigenvalues with their vectors (columns), and how many of them have variance."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float
    rank: int

    def project(self, x: np.ndarray, n_components: int) -> np.ndarray:
        """Whitened coordinates of rows of longs; those without variance are not a number."""
        k = min(n_components, len(self.values))
        has = np.arange(k) < self.rank
        scale = np.where(has, 1 / np.sqrt(np.where(has, self.values[:k], 1.0)), np.nan)
        return ((x - self.centre).astype(np.float64) - self.rest) @ self.axes[:, :k] * scale


def fit(x: DataFrame) -> Whitening:
    """Fits to all rows of ``x`` (see :func:`vectors`), in two passes: sums, then the scatter about the mean.

    The mean's nearest integers are taken off before multiplying, what then is
    left of the mean is put right in whole numbers. Eigenvalues not above the
    rounding of the largest have no variance: fewer rows than components, or
    components that depend on each other.
    """
    size = x.select(F.size("x").alias("d")).limit(1).collect()
    if not size:
        return Whitening(0, [], np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros((0, 0)), 0.0, 0)
    d = size[0].d
    # MOST times the rows of a block stays below 2**63.
    told = _add_up(x, lambda b: np.array([[*b.sum(0).tolist(), len(b)]], object), WHOLE)
    sums, n = [told[0, i] for i in range(d)], told[0, d]
    nearest = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(nearest, np.int64)
    rest = [s - n * c for s, c in zip(sums, nearest, strict=True)]
    scatter = _add_up(x, lambda b: exact_product(b - centre), WHOLE)
    covariance = np.zeros((d, d))
    for (i, j), total in scatter.items():
        covariance[i, j] = covariance[j, i] = float(Fraction(n * total - rest[i] * rest[j], n * n))
    values, axes = jacobi(covariance)
    rank = int((values > d * np.finfo(float).eps * max(values[0], 0.0)).sum())
    return Whitening(n, sums, centre, np.array([float(Fraction(r, n)) for r in rest]), values, axes, float(np.trace(covariance)), rank)


def whiten(x: DataFrame, model: Whitening, n_components: int = 8, *, key: str = "vec_id") -> DataFrame:
    """One row per row of ``x``: ``key``, deviation, whitened (an array of ``n_components`` doubles at most).

    ``deviation`` is the sum over components of (n x - S)**2, exact, or null
    where a long does not hold it. Coordinates without variance are null.
    """
    told = x.sparkSession.sparkContext.broadcast(model)  # of the size of the matrix
    schema = T.StructType([T.StructField(key, x.schema["k"].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    columns = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        s = np.array([s % (1 << 64) for s in m.sums], np.uint64).view(np.int64)
        for batch in batches:
            if not len(batch):
                continue
            b = next(_blocks([batch]))
            far = m.n * b - s  # whole numbers modulo 2**64: right wherever the sum fits
            about = (((b - m.centre).astype(np.float64) - m.rest) ** 2).sum(1) * float(m.n) ** 2
            w = m.project(b, n_components)
            k = w.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * k), pa.array(w.ravel(), mask=np.isnan(w.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((far * far).sum(1), mask=about > 9.2e18), lists], schema=columns)

    return x.mapInArrow(run, schema)


def identity_error(x: DataFrame, model: Whitening, n_components: int = 8) -> float | None:
    """The largest entry, in absolute value, of the whitened rows' covariance less the identity.

    In two passes, the mean first. Coordinates without variance do not count;
    without any there is nothing to tell.
    """
    k = min(n_components, model.rank)
    if not k:
        return None
    told = x.sparkSession.sparkContext.broadcast(model)
    sums = _add_up(x, lambda b: told.value.project(b, k).sum(0, keepdims=True), pa.float64())
    mean = np.array([sums[0, i] for i in range(k)]) / model.n

    def scatter(b: np.ndarray) -> np.ndarray:
        w = told.value.project(b, k) - mean
        return w.T @ w

    return max(abs(total / model.n - (i == j)) for (i, j), total in _add_up(x, scatter, pa.float64()).items())


def report(embeddings: DataFrame, n_components: int = 8, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row that takes part and component: ``key``, component, n, deviation, whitened, explained, identity_error.

    Components are numbered from 1 by falling eigenvalue. ``explained`` is the
    eigenvalue over the trace, null where all rows are equal. A component
    without variance has a null ``whitened``. See :func:`vectors` for the rows
    that are left out; an empty table gives no rows.
    """
    x = vectors(embeddings, key=key, vector=vector)
    model = fit(x)
    error = identity_error(x, model, n_components) if model.n else None
    shares = [max(float(v), 0.0) / model.trace if model.trace > 0 else None for v in model.values[:n_components]]
    long = whiten(x, model, n_components, key=key).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share: Column = F.get(F.lit(shares).cast("array<double>") if shares else F.array().cast("array<double>"), F.col("at"))
    return long.select(key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
