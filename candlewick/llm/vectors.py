"""Vectors of a table as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components beyond this are taken as this, so that each fits a long.
LARGEST = float(2**62)


def dimensions(df: DataFrame, vector: str) -> int:
    """Length of the longest vector; 0 where there is none."""
    return max(0, df.agg(F.max(F.size(vector)).alias("d")).first()["d"] or 0)


def whole_numbers(column: pa.Array, dims: int, scale: float, offset: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of finite components, and floor(scale * component) + offset of those rows.

    Components count as doubles. A vector shorter than ``dims`` goes on with zeros.
    """
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), int)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null becomes NaN
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    held = np.asarray(column.is_valid()) & (bad[ends] == bad[ends - lengths])
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(values)) - np.repeat(ends - lengths, lengths)] = values
    return held, np.clip(np.floor(out[held] * scale), -LARGEST, LARGEST).astype(np.int64) + offset


def packed(x: np.ndarray) -> pa.Array:
    """Rows of longs as binary values."""
    width = x.shape[1] * 8
    flat = np.ascontiguousarray(x, "<i8")
    offsets = pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(x), [None, offsets, pa.py_buffer(flat)]).cast(pa.binary())


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dims)
