"""Embedding whitening: a centred scatter summed where the rows are, its eigenvectors by cyclic Jacobi rotations on the driver, the whitening
matrix sent back to the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch
from .vectors import common_length, matrix, packed, total, unpacked

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Entries beyond it are no whole numbers that a double holds.
EXACT = 1 << 53
#: Sums of whole numbers are taken apart, those of the low bits and those of the others, so that neither leaves a long.
LOW_BITS = 26
_EPS = float(np.finfo(np.float64).eps)


def jacobi(v: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns. Rotations in rows of pairs (p, q), sweep after sweep, until every off-diagonal
    entry is lost beside the root of its two diagonal ones; small eigenvalues of scaled matrices keep their digits that way."""
    a, n = np.array(v, np.float64), len(v)
    u = np.eye(n)
    for _ in range(sweeps):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                x = a[p, q]
                if x == 0 or abs(x) <= _EPS * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * x)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                pp, qq = a[p, p] - t * x, a[q, q] + t * x
                rp, rq = a[p].copy(), a[q].copy()
                a[p], a[q] = c * rp - s * rq, s * rp + c * rq
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = pp, qq, 0.0, 0.0
                up = u[:, p].copy()
                u[:, p], u[:, q] = c * up - s * u[:, q], s * up + c * u[:, q]
        if not turned:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    return e[order], u[:, order]


def squared(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int | None]:
    """For each row the exact sum of (n * x - S)**2 with S = n * whole + rest; None where no long holds it."""
    y, dim = x - whole, x.shape[1]
    most = n * (int(np.abs(y).max(initial=0)) + 1)
    if dim * most * most < 1 << 63:
        d = n * y - rest
        return (d * d).sum(axis=1).tolist()
    sums = ((n * y.astype(object) - rest.astype(object)) ** 2).sum(axis=1) if dim else []
    return [s if s < 1 << 63 else None for s in sums]


def whiten(df: DataFrame, components: int = 16, scale: float = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: for each row of df (vec_id, embedding) one row a component.

    An entry c becomes x = floor(scale * c) + shift. Everything is learnt from the list of different x vectors (n of them, sums S), however often
    each occurs: their covariance, centred before multiplying, and its unit eigenvectors by falling eigenvalue e. `deviation` is the sum of (n * x - S)**2, exact, null where a
    long can't hold it; `whitened` the centred vector's projection over sqrt(e); `explained` e over all variance; `identity_error` the largest
    absolute entry of whitened's covariance minus the identity, measured in one more pass over that list.

    Rows whose vector is null, holds an entry that is null, not finite or beyond 2**53 / scale, or has not the length that most have, take no part. Rows
    that repeat, also their ids, and rows without an id are each returned. A component without variance (to rounding: e of at most entries * 2**-52 of
    all) has `whitened` null and `explained` 0 and is left out of `identity_error`, which is 0 where none has any. Vectors of fewer entries than `components` have as many components as
    entries. An empty table gives an empty one. Other columns are not looked at.

    One shuffle, of vectors reduced to different ones a task before it, so a vector that very many rows have is no one's burden; sums of scatters are dim**2
    numbers a task. The driver holds one matrix of dim x dim.
    """
    spark, rows = df.sparkSession, df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    dim = common_length(rows, "v")
    if not dim:
        return spark.createDataFrame([], SCHEMA)
    below = (EXACT - abs(shift) - 1) / scale

    def lattice(batch: pa.RecordBatch, column: str = "v") -> tuple[np.ndarray, np.ndarray]:
        at, m = matrix(batch.column(column), dim, below)
        return at, np.floor(scale * m).astype(np.int64) + shift

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = lattice(batch)
            yield pa.RecordBatch.from_arrays([packed(np.unique(x, axis=0))], ["x"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, dim), np.int64)
        n = 0
        for batch in batches:
            x = unpacked(batch.column(0), dim)
            out += np.stack([(x & ((1 << LOW_BITS) - 1)).sum(axis=0), (x >> LOW_BITS).sum(axis=0)])
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([[n, *out.ravel().tolist()]], pa.list_(pa.int64()))], ["sums"])

    with scratch(spark) as s:
        fit = s.keep(rows.select("v").mapInArrow(points, "x binary").distinct(), "fit")
        first = total(fit.mapInArrow(sums, "sums array<long>"), "sums", 2 * dim + 1, object)
        n = int(first[0])
        if not n:
            return spark.createDataFrame([], SCHEMA)
        s_all = [int(lo) + (int(hi) << LOW_BITS) for lo, hi in zip(first[1 : dim + 1], first[dim + 1 :])]
        whole, rest = (np.array([f(t) for t in s_all], np.int64) for f in (lambda t: t // n, lambda t: t % n))
        centre = rest / n
        centred = lambda x: (x - whole) - centre

        def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((dim, dim))
            for batch in batches:
                d = centred(unpacked(batch.column(0), dim))
                out += d.T @ d
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        v = total(fit.mapInArrow(scatter, "sums array<double>"), "sums", dim * dim, np.float64).reshape(dim, dim) / n
        e, u = jacobi((v + v.T) / 2)
        trace = float(np.trace(v))
        k = min(components, dim)
        has = e[:k] > dim * _EPS * trace
        w = np.where(has, u[:, :k] / np.sqrt(np.where(has, e[:k], 1.0)), 0.0)
        explained = np.where(has, e[:k] / (trace or 1.0), 0.0)

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k + 1, k))
            for batch in batches:
                z = centred(unpacked(batch.column(0), dim)) @ w
                out += np.concatenate([z.T @ z, z.sum(axis=0)[None]])
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        moments = total(fit.mapInArrow(second, "sums array<double>"), "sums", (k + 1) * k, np.float64).reshape(k + 1, k) / n
        off = np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k))[np.ix_(has, has)]
        error = float(off.max(initial=0.0))

        def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = lattice(batch)
                z = centred(x) @ w
                m = len(at)
                tile = lambda a: pa.array(np.tile(a, m))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))), tile(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(m * k, n, np.int64)),
                        pa.array(squared(x, n, whole, rest), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel(), mask=np.tile(~has, m)), tile(explained), pa.array(np.full(m * k, error)),
                    ],
                    SCHEMA.replace(",", "").split()[::2],
                )

        return rows.mapInArrow(out, SCHEMA)
