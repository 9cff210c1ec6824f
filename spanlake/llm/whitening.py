"""PCA whitening of integer vectors: distributed covariance, own symmetric eigensolver, broadcast projection.

1. The fit list, each distinct vector once, is written; its size and sums per dimension are exact integers.
2. Every task centres its vectors (n x - S is an integer, divided once by n) before it multiplies, and
   gives the rows of its d x d matrix; the rows of one number are added up in one place.
3. The covariance, whose size depends on the dimension alone, is made tridiagonal by Householder
   reflections; Sturm counts bisect the leading eigenvalues; inverse iteration gives their vectors, made
   orthogonal inside clusters of close eigenvalues.
4. The components are broadcast and every row is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.scratch import stored
from spanlake.llm.vectors import integer_rows, unpacked
from spanlake.runtime import shuffle_partitions

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: components whose share of the variance is smaller are rounding noise and left out
LEAST_SHARE = 1e-12
#: eigenvalues closer than this share of the norm form a cluster
CLUSTER = 1e-3
#: rows multiplied at a time
_ROWS = 8192


# eigenvalues and eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Householder vectors (rows, unit or zero) of a symmetric matrix."""
    a = np.array(a, float)
    d = len(a)
    mirrors = np.zeros((max(d - 2, 0), d))
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0 or norm == abs(v[0]):
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        mirrors[k, k + 1 :] = v
        # two-sided reflection as one symmetric update of rank two
        p = a[:, k + 1 :] @ v
        p[k + 1 :] -= (v @ p[k + 1 :]) * v
        full = mirrors[k]
        a -= 2 * (np.outer(p, full) + np.outer(full, p))
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def sturm_counts(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are smaller than each of ``at``: negative pivots of T - at."""
    floor = np.finfo(float).tiny * 4
    square = np.concatenate([[0.0], off * off])
    below, pivot = np.zeros(len(at), int), np.ones(len(at))
    for i in range(len(diag)):
        pivot = diag[i] - at - square[i] / pivot
        pivot = np.where(np.abs(pivot) < floor, -floor, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected to the last bit of the matrix norm."""
    d = len(diag)
    reach = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    low, high = float((diag - reach).min()), float((diag + reach).max())
    lo, hi = np.full(k, low), np.full(k, high)
    ranks = d - 1 - np.arange(k)  # ascending number of each wanted eigenvalue
    for _ in range(128):
        mid = (lo + hi) / 2
        less = sturm_counts(diag, off, mid) <= ranks  # the eigenvalue is at or above mid
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
        if np.all(hi - lo <= 2 * np.finfo(float).eps * max(abs(low), abs(high))):
            break
    return (lo + hi) / 2


def _solved(diag: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) y = right by elimination with row exchanges; vanishing pivots become ``tiny``."""
    d = len(diag)
    upper = np.zeros((d, 3))
    b = right.copy()
    here = [diag[0] - shift, off[0] if d > 1 else 0.0, 0.0]
    for i in range(d - 1):
        below = [off[i], diag[i + 1] - shift, off[i + 1] if i + 2 < d else 0.0]
        if abs(below[0]) > abs(here[0]):
            here, below = below, here
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(here[0]) < tiny:
            here[0] = tiny
        factor = below[0] / here[0]
        upper[i] = here
        b[i + 1] -= factor * b[i]
        here = [below[1] - factor * here[1], below[2] - factor * here[2], 0.0]
    upper[d - 1] = here if abs(here[0]) >= tiny else [tiny, 0.0, 0.0]
    y = np.zeros(d + 2)
    for i in range(d - 1, -1, -1):
        y[i] = (b[i] - upper[i, 1] * y[i + 1] - upper[i, 2] * y[i + 2]) / upper[i, 0]
    return y[:d]


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of falling ``values``; those of a cluster are made orthogonal to one another."""
    d = len(diag)
    norm = float(np.abs(diag).max() + 2 * (np.abs(off).max() if d > 1 else 0.0)) or 1.0
    eps = np.finfo(float).eps * norm
    rng = np.random.default_rng(0)
    rows = np.zeros((len(values), d))
    start = 0
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            start = j
        # equal eigenvalues need shifts that differ a little
        shift = min(float(value), shift - 2 * eps) if j > start else float(value)
        y = rng.standard_normal(d)
        for _ in range(6):
            y /= np.linalg.norm(y)
            before = y
            y = _solved(diag, off, shift, y, eps)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= rows[start:j].T @ (rows[start:j] @ y)
            y /= np.linalg.norm(y)
            if min(np.linalg.norm(y - before), np.linalg.norm(y + before)) < 1e-14:
                break
        rows[j] = y
    return rows


def leading_components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the ``k`` largest eigenvalues, falling.

    The sign is such that the entry of largest size, the first of equals, is positive.
    """
    k = min(k, len(cov))
    diag, off, mirrors = tridiagonal(cov)
    values = leading_eigenvalues(diag, off, k)
    rows = inverse_iteration(diag, off, values)
    for v in mirrors[::-1]:
        rows -= 2 * np.outer(rows @ v, v)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    largest = np.abs(rows).argmax(axis=1)
    return values, rows * np.sign(rows[np.arange(k), largest])[:, None]


# distributed sums


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            x = unpacked(batch.column("x"))
            total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
            n += len(x)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), n)), pa.array(total)], ["dim", "n", "total"])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n with one rounding: n x - S is an exact integer."""
    if int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0)) < 1 << 62:
        return (n * x - sums) / n
    return ((n * x.astype(object) - sums.astype(object)) / n).astype(float)


def _matrix_rows(n: int, sums: np.ndarray, project: np.ndarray | None):
    """Rows (i, bytes) of the sum of outer products of a task's centred, or projected, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                y = centred(unpacked(batch.column("x").slice(lo, _ROWS)), n, sums)
                y = y if project is None else y @ project
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist()):
            row = np.frombuffer(row)
            total[i] = total[i] + row if i in total else row
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], ["i", "row"])


def covariance(fit: DataFrame, n: int, sums: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance, divisor n, of the centred vectors or of their projections; d x d numbers reach the driver.

    A projection of centred vectors has mean zero, so both are centred before they are multiplied.
    """
    parts = fit.mapInArrow(_matrix_rows(n, sums, project), "i int, row binary")
    d = len(sums) if project is None else project.shape[1]
    rows = parts.repartition(min(d, shuffle_partitions(fit.sparkSession)), "i").mapInArrow(_added, "i int, row binary").toArrow()
    out = np.zeros((d, d))
    for i, row in zip(rows.column("i").to_pylist(), rows.column("row").to_pylist()):
        out[i] = np.frombuffer(row)
    return (out + out.T) / (2 * n)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exact sums over the dimensions of (n x - S)^2."""
    y = n * x.astype(object) - sums.astype(object) if int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0)) >= 1 << 62 else n * x - sums
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) >= 1 << 62:
        y = y.astype(object)
    return (y * y).sum(axis=1).tolist()


def _projected(n: int, sums: np.ndarray, project: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                x = unpacked(part.column("x"))
                if not len(x):
                    continue
                w = centred(x, n, sums) @ project
                dev = pa.array([str(v) for v in _deviations(x, n, sums)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), dev, lists], ["vec_id", "deviation", "w"])

    return run


def whitened(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, vec: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row per usable row and component.

    Null vectors, those with null, NaN or infinite entries, and those that are empty or not of the
    commonest length are left out; rows with null or repeated ids stay, each with its own rows. Each vector
    counts once in the fit, however many rows have it. Components without variance, so all of them if
    there are fewer than two different vectors, are left out: none can be scaled to variance one. An
    empty table gives no rows. ``deviation`` is exact up to 38 digits and null beyond.
    """
    spark = df.sparkSession
    rows, dim = integer_rows(df, vec, {"vec_id": "long"}, scale, offset)
    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not dim:
        return spark.createDataFrame([], out)
    rows = stored(rows, "vectors")
    fit = stored(rows.select("x").distinct(), "fit")
    got = fit.mapInArrow(_partial_sums, "dim int, n long, total long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    if not got.num_rows:
        return spark.createDataFrame([], out)
    n, sums = int(got.column("n")[0].as_py()), np.zeros(dim, np.int64)
    sums[np.asarray(got.column("dim"))] = np.asarray(got.column("total"))
    cov = covariance(fit, n, sums)
    trace = float(np.trace(cov))
    values, parts = leading_components(cov, components)
    live = values > LEAST_SHARE * trace
    if not live.any():
        return spark.createDataFrame([], out)
    values, parts = values[live], parts[live]
    project = parts.T / np.sqrt(values)
    error = float(np.abs(covariance(fit, n, sums, project) - np.eye(len(values))).max())
    shares = F.array(*(F.lit(float(v / trace)) for v in values))
    wide = rows.mapInArrow(_projected(n, sums, project), "vec_id long, deviation string, w array<double>")
    return wide.select("vec_id", F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), F.posexplode("w").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"),
    )
