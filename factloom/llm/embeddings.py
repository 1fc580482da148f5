"""Embeddings as exact integers, and rows of numbers as binary columns: what the operators on vectors share.

A vector is kept unless it is null or holds a null or non-finite component. Shorter vectors are filled with zeros to the
width of the longest. floor(1024 x) is held within plus and minus ``BOUND``, so that squared distances of parts of up to
512 components fit a long: components beyond 65,536 count as that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, BOUND = 1024, 2**26


def kept(rows: DataFrame, *others: str, column: str = "embedding") -> DataFrame:
    """(vec_id, ``others``, vector array<double>) of the rows whose vector is whole."""
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), *others, F.col(column).cast("array<double>").alias("vector"))
    return vectors.where(F.col("vector").isNotNull()).where(F.forall("vector", fine))


def width_of(vectors: DataFrame, multiple: int = 1) -> int:
    """The longest vector's length, rounded up to a multiple."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
    return -(-longest // multiple) * multiple


def integers(column: pa.ListArray, width: int) -> np.ndarray:
    """floor(1024 x) of each vector, as rows of int64."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(flat * SCALE), -BOUND, BOUND).astype(np.int64)
    if (sizes == width).all():
        return whole.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = whole
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    size = rows.dtype.itemsize * int(np.prod(rows.shape[1:]))
    ends = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    """The rows of ``packed`` with the shape of each, or all values in a row without one."""
    data = b"".join(x for x in column.to_pylist() if x)
    flat = np.frombuffer(data, kind)
    return flat.reshape(len(column), *shape) if shape else flat
