"""Embedding whitening by eigenvectors refined in mixed precision.

The covariance of all vectors is summed where the vectors lie and added up by
Spark; what reaches the driver is one d x d matrix, whatever the number of
vectors. Its eigenvectors are first computed in float32 and then corrected in
extended precision by the matrix-multiplication iteration of Ogita and
Aishima. Where eigenvalues are too close for that iteration to tell their
vectors apart, the small problem of the cluster alone is solved on the refined
basis, and the iteration goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT = 1_000_000
SCALE = 64.0
#: Components of a vector are kept within this before the shift, so that sums of parts stay exact.
LARGEST = float(1 << 62)
ROWS = 4096
HALF = 32


def refined(v: np.ndarray, rounds: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, falling, both to double precision."""
    d, high = len(v), np.longdouble
    scale = np.abs(v).max() if d else 0
    if not scale:
        return np.zeros(d), np.eye(d)
    a = np.asarray(v, dtype=high) / high(scale)
    _, start = np.linalg.eigh(a.astype(np.float32))
    x, one = start[:, ::-1].astype(high), np.eye(d, dtype=high)
    size, change = np.sqrt((a * a).sum()), np.inf
    floor = 1e8 * np.finfo(high).eps * size
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        # symmetric, so that what rounding adds is a rotation and leaves the vectors at right angles
        r, s = (r + r.T) / 2, (s + s.T) / 2
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(value)
        near = max(2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())), floor)
        gap = value[None, :] - value[:, None]
        close = np.abs(gap) <= near
        e = np.where(close, r / 2, (s + value[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        turned = _sub_solves(a, x, value, near)
        last, change = change, max(float(np.abs(e).max()), turned)
        # steps shrink by their square until rounding stops them
        if change < 1e-18 or (change < 1e-6 and change > last / 4):
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    value = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    return (value[order] * high(scale)).astype(np.float64), x[:, order].astype(np.float64)


def _sub_solves(a: np.ndarray, x: np.ndarray, value: np.ndarray, near: np.longdouble) -> float:
    """Turn the vectors of each cluster of eigenvalues within their own space; returns the largest turn."""
    order, largest = np.argsort(-value, kind="stable"), 0.0
    cuts = np.flatnonzero(-np.diff(value[order]) > near) + 1
    for own in np.split(order, cuts):
        if len(own) < 2:
            continue
        basis = x[:, own]
        inner = basis.T @ (a @ basis) - value[own].mean() * (basis.T @ basis)
        inner = (inner + inner.T) / 2
        off = np.abs(inner - np.diag(np.diag(inner))).max()
        # what rounding leaves of equal eigenvalues has no direction of its own
        if off <= 64 * np.finfo(np.longdouble).eps:
            continue
        top = np.abs(inner).max()
        _, turn = np.linalg.eigh((inner / top).astype(np.float64))
        x[:, own] = basis @ turn.astype(np.longdouble)
        largest = max(largest, float(off / top))
    return largest


def _finite(vector: Column) -> Column:
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The whole numbers x of a batch, one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64).reshape(-1, d) + SHIFT


def _slices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, _matrix(part.column(batch.num_columns - 1), d)


def _sums(own: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _slices(batches, d):
            n += len(x)
            low += (x & ((1 << HALF) - 1)).sum(axis=0)
            high += (x >> HALF).sum(axis=0)
        if n:
            yield pa.record_batch([np.arange(d), np.full(d, n), low, high], names=["i", "n", "low", "high"])

    found = own.mapInArrow(part, "i long, n long, low long, high long")
    rows = sorted(map(tuple, found.groupBy("i").agg(F.sum("n"), F.sum("low"), F.sum("high")).collect()))
    return (rows[0][1] if rows else 0), [(high << HALF) + low for _, _, low, high in rows]


def _products(rows: DataFrame, make, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a k-vector and of its products with itself over all rows; ``make`` gives the vectors of some batches."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares, seen = np.zeros(k), np.zeros((k, k)), False
        for y in make(batches):
            sums += y.sum(axis=0)
            squares += y.T @ y
            seen = True
        if seen:
            i, j = np.triu_indices(k)
            i, j, value = np.r_[i, np.full(k, -1)], np.r_[j, np.arange(k)], np.r_[squares[i, j], sums]
            yield pa.record_batch([i, j, value], names=["i", "j", "value"])

    found = rows.mapInArrow(part, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value"))
    sums, squares = np.zeros(k), np.zeros((k, k))
    for i, j, value in found.collect():
        if i < 0:
            sums[j] = value
        else:
            squares[i, j] = squares[j, i] = value
    return sums, squares


def _deviation(y: np.ndarray, n: int, rest: list[int]) -> pa.Array:
    """Exact sum over the dimensions of (n y - rest)^2; null beyond a long."""
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
    if most * most * max(1, y.shape[1]) < 1 << 63:
        z = n * y - np.array(rest, dtype=np.int64)
        return pa.array((z * z).sum(axis=1), pa.int64())
    found = [sum((n * c - r) ** 2 for c, r in zip(row, rest)) for row in y.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in found], pa.int64())


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable vector.

    Vectors that are null or hold null, NaN or infinite entries are left out,
    and so are those whose length is not the most frequent one (ties: the
    longest). Entries become x = floor(64 c) + 1000000, c kept within 2^62.
    ``component`` numbers the eigenvectors of the covariance (divisor n) from 1
    by falling eigenvalue, up to ``components``; ``deviation`` is the exact sum
    of (n x - S)^2, null beyond a long; ``explained`` the component's share of
    the variance; ``identity_error`` the largest absolute entry of the whitened
    covariance minus the identity. A component whose eigenvalue is zero up to
    rounding has whitened null and is no part of that covariance; if all are
    zero (a single vector, or copies of one) the last two are null. Repeated
    rows count as often as they stand, null keys stay null, an empty table
    gives an empty one; other columns are not used. Four passes over the
    table; the driver sees matrices of the dimension only.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v"))
    own = own.filter(_finite(F.col("v")) & (F.size("v") > 0))
    kind = own.schema["key"].dataType
    schema = (
        f"key {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    length = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length["d"]
    own = own.filter(F.size("v") == d)
    n, s = _sums(own.select("v"), d)
    middle = [(2 * total + n) // (2 * n) for total in s]
    rest = [total - n * m for total, m in zip(s, middle)]
    centre, delta = np.array(middle, dtype=np.int64), np.array([r / n for r in rest])

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        # whole numbers near zero: their products add up without rounding unless vectors are enormous
        for _, x in _slices(batches, d):
            yield (x - centre).astype(np.float64)

    _, squares = _products(own.select("v"), centred, d)
    exact = np.array(rest, dtype=np.longdouble) / n
    covariance = squares.astype(np.longdouble) / n - np.outer(exact, exact)
    value, vector_of = refined(covariance)
    k = min(components, d)
    trace = float(np.trace(covariance))
    real = value[:k] > value[0] * d * 2.0**-50
    project = vector_of[:, :k] / np.sqrt(np.where(real, value[:k], 1))
    explained = value[:k] / trace if trace > 0 else np.full(k, np.nan)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, x in _slices(batches, d):
            yield ((x - centre) - delta) @ project[:, real]

    error = None
    if real.any():
        sums, squares = _products(own.select("v"), projected, int(real.sum()))
        error = float(np.abs(squares / n - np.outer(sums / n, sums / n) - np.eye(len(sums))).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _slices(batches, d):
            y = x - centre
            values = ((y - delta) @ project).ravel()
            at = np.repeat(np.arange(len(x)), k)
            missing = np.tile(~real, len(x))
            share = np.tile(explained, len(x))
            columns = [
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), n)),
                _deviation(y, n, rest).take(pa.array(at)),
                pa.array(values, mask=missing),
                pa.array(share, mask=np.isnan(share)),
                pa.array(np.full(len(at), np.nan if error is None else error), mask=np.full(len(at), error is None)),
            ]
            yield pa.record_batch(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(rows, schema)
