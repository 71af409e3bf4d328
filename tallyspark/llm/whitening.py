"""Embedding whitening: principal components by TSQR and a one-sided Jacobi SVD of the triangle.

``fitted`` makes two passes. The first sums the vectors (exact integers). The second centres each row, takes the QR of
blocks of ``BLOCK`` rows stacked under the triangle so far, and so gives one triangle R a task; triangles then meet
``FAN`` at a time until one is left. R of d x d numbers has the singular values and right singular vectors of all
centred rows, so no covariance is formed and small deviations keep their digits. Only that last R comes to the driver
(d is the vectors' length), where plane rotations make its columns orthogonal; the accumulated rotations are the
components, the columns' lengths the standard deviations times the root of n.

``whitened`` is one more pass by broadcast of mean and components, and ``identity_error`` another, whose d x d sums
are folded by task before they are added up. Nothing is shuffled but triangles and sums.

Rows whose vector is null or holds null, non-finite or too large entries (``64 * c`` of 2 to the 40 or more) are left
out of everything; so are vectors of another length than the most frequent (the longer one in a tie). Repeated rows
and null ids count row by row. Components without variance (beyond the rank, or a deviation under ``RANK`` of the
largest) can't be whitened and are left out, so that equal rows, one row or none give no rows. A ``deviation`` beyond
64 bits is null. Signs: the largest entry of each component is positive. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK, FAN, COMPONENTS = 1024, 16, 32
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 40)
SWEEPS, STOP, RANK = 60, 1e-15, 1e-12


class Fit(NamedTuple):
    n: int
    sums: np.ndarray  #: exact, by dimension
    components: np.ndarray  #: a column each, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows with a finite vector of any length but 0."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * SCALE >= LARGEST))
    return rows.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)))


def integers(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of exact integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat) + SHIFT).astype(np.int64).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, total) of a task, as its vectors are of one length."""
    total = None
    for batch in batches:
        if batch.num_rows:
            part = integers(batch.column(0)).sum(axis=0)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.int64())], ["place", "total"])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n from the exact n*x - S; whatever of it is beyond 53 bits is rounded once."""
    return (n * x - sums).astype(np.float64) / n if n < 1 << 21 else (x - sums // n).astype(np.float64) - (sums % n) / n


def triangle(parts: list[np.ndarray]) -> np.ndarray:
    """R of the stacked parts, square even where rows are few."""
    d = parts[0].shape[1]
    r = np.linalg.qr(np.vstack(parts), mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def _triangles(n: int, sums: np.ndarray):
    def run(batches):
        r = None
        for batch in batches:
            x = centred(integers(batch.column(0)), n, sums)
            for a in range(0, len(x), BLOCK):
                r = triangle([x[a : a + BLOCK]] if r is None else [r, x[a : a + BLOCK]])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    return run


def _joined(d: int):
    def run(key, table):
        """One triangle of at most FAN of them, in the order of their parts."""
        rows = sorted(zip(table["part"].to_pylist(), table["r"].to_pylist()))
        r = triangle([np.frombuffer(b).reshape(d, d) for _, b in rows])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    return run


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Jacobi: (V, lengths of the columns of r V), V orthogonal, by falling length.

    Each round rotates disjoint pairs of columns, as in a tournament, until every pair is orthogonal to ``STOP``.
    """
    d = r.shape[1]
    m = d + d % 2
    a, v = np.zeros((len(r), m)), np.eye(m)
    a[:, :d] = r
    seats = np.arange(m)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(m - 1):
            p, q = seats[: m // 2], seats[m // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            off = np.where(size > 0, np.abs(xy) / np.where(size > 0, size, 1), 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > STOP
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= STOP * 10:
            break
    a, v = a[:, :d], v[:d, :d]
    long = np.sqrt((a * a).sum(0))
    order = np.argsort(-long, kind="stable")
    v = v[:, order]
    return v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1, 1), long[order]


def fitted(rows: DataFrame, most: int = COMPONENTS) -> tuple[DataFrame, Fit] | None:
    """The usable rows of the chosen length, and their components; None where there is no variance."""
    common.prepare(rows.sparkSession)
    rows = usable(rows)
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    best = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    d, n = best
    rows = rows.filter(F.size("embedding") == d)
    vectors = rows.select("embedding")
    told = vectors.mapInArrow(_sums, "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()
    sums = np.array([r.total for r in told], np.int64)
    level = common.cut(vectors.mapInArrow(_triangles(n, sums), "part int, r binary"))
    while level.count() > 1:
        level = common.cut(level.groupBy(F.expr(f"part div {FAN}").cast("int").alias("to")).applyInArrow(_joined(d), "part int, r binary"))
    r = np.frombuffer(level.first().r).reshape(d, d)
    v, long = jacobi(r)
    stay = min(most, int((long > RANK * long[0]).sum()) if long[0] > 0 else 0)
    return (rows, Fit(n, sums, v[:, :stay], long[:stay] ** 2 / n, float((long**2).sum() / n))) if stay else None


def _projected(batches, fit: Fit):
    to = fit.components / np.sqrt(fit.eigenvalues)
    for batch in batches:
        if batch.num_rows:
            x = integers(batch.column("embedding"))
            yield batch, x, centred(x, fit.n, fit.sums) @ to


def identity_error(rows: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(fit.eigenvalues)

    def run(batches):
        total = np.zeros((k + 1, k))
        for _, _, w in _projected(batches, fit):
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) * k), pa.int32()), pa.array(total.ravel())], ["place", "total"])

    told = rows.mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()
    total = np.array([r.total for r in told]).reshape(k + 1, k) / fit.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums of (n*x - S)^2, exact; null beyond 64 bits."""
    rough = ((n * x.astype(np.float64) - sums) ** 2).sum(axis=1)
    if rough.max(initial=0.0) < 2.0**62:
        off = n * x - sums
        return pa.array((off * off).sum(axis=1), pa.int64())
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def whitened(rows: DataFrame, fit: Fit) -> DataFrame:
    """A row for each vector and component."""
    k = len(fit.eigenvalues)

    def run(batches):
        for batch, x, w in _projected(batches, fit):
            each = np.repeat(np.arange(len(x)), k)
            numbers = np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))
            explained = np.tile(fit.eigenvalues / fit.trace, len(x))
            columns = [batch.column("vec_id").take(pa.array(each)), pa.array(numbers), pa.array(np.full(len(each), fit.n)), deviations(x, fit.n, fit.sums).take(pa.array(each)), pa.array(w.ravel()), pa.array(explained)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fitted(common.table(spark, sf_dir, "embeddings"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whitened(*found).withColumn("identity_error", F.lit(identity_error(*found)))
