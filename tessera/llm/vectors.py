"""Vectors on their way from Arrow to numpy, and sums of arrays over all tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_length(df: DataFrame, column: str) -> int | None:
    """The length that most of the column's arrays have, the longer of two as frequent; None where there is none."""
    most = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return most.n if most else None


def matrix(column: pa.Array, dim: int, below: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows whose arrays have dim entries, none of them null, not finite or as large as `below`; and those rows as doubles."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    values = column.take(pa.array(at)).flatten()
    m = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    with np.errstate(invalid="ignore"):
        fine = (np.abs(m) < below).all(axis=1)  # not so for a NaN
    return at[fine], m[fine]


def packed(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if rows.ndim == 2 else 0
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of long, as packed() took them."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dim)


def total(df: DataFrame, column: str, n: int, kind: type) -> np.ndarray:
    """The sum over all rows of an array column of n entries. n numbers come to the driver."""
    out = np.zeros(n, kind)
    for at, value in df.select(F.posexplode(column).alias("at", "value")).groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out
