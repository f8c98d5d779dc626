"""Vectors as numpy matrices, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(rows: DataFrame, column: str) -> int:
    """The length of the longest vector, 0 without any."""
    return rows.agg(F.max(F.size(column))).first()[0] or 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors as rows of ``d`` doubles; a shorter one ends in zeros, a null vector or component is not a number."""
    lengths = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    flat = pc.list_flatten(column).cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    found = np.zeros((len(column), d))
    if len(column) and (lengths == d).all():
        found[:] = values.reshape(-1, d)
    else:
        at = 0
        for row, n in zip(found, lengths.tolist(), strict=True):
            if n < 0:
                row[:] = np.nan
            else:
                row[:n] = values[at : at + n]
                at += n
    return found


def packed(matrix_: np.ndarray) -> pa.Array:
    """One binary value per row."""
    return pa.array([x.tobytes() for x in np.ascontiguousarray(matrix_)], pa.binary())


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The matrix that ``packed`` was given."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)
