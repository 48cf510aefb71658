"""Vectors between Arrow batches and matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecpack.errors import DimensionMismatch, InvalidVector


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows x dim in double precision; raises where a row isn't a finite vector of ``dim`` components."""
    if column.null_count:
        raise InvalidVector("null vector")
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != dim).any():
        raise DimensionMismatch(dim, int(sizes[sizes != dim][0]))
    flat = column.flatten()
    if flat.null_count:
        raise InvalidVector("null component")
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if not np.isfinite(x).all():
        raise InvalidVector("non-finite component")
    return x


def vectors(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as lists."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(x.ravel(), kind))


def binary(x: np.ndarray) -> pa.Array:
    """Rows of a byte matrix as binary values."""
    n, d = x.shape
    offsets = pa.py_buffer((np.arange(n + 1) * d).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(x, np.uint8).tobytes())])


def bytes_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as a byte matrix."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(column), width)


def invalid_reason(vector: Column, dim: int) -> Column:
    """Null for a good vector; else the wrong length as text, or ``value``."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNull(), "value").when(F.size(vector) != dim, F.size(vector).cast("string")).when(~finite, "value")


def raise_invalid(reason: str | None, dim: int) -> None:
    """Raise what the greatest :func:`invalid_reason` of some vectors stands for."""
    if reason is not None:
        raise InvalidVector("null vector, or null or non-finite component") if reason == "value" else DimensionMismatch(dim, int(reason))
