"""Vectors as integers, batch by batch, for operators whose sums have to be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squared norms stay below this, so that products and squared distances of two vectors fit 63 bits.
NORM_LIMIT = 2.0**60


def floors(column: pa.ListArray, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """floor(scale * x) of the vectors of a batch, by their size: (places in the batch, int64 matrix).

    Vectors that are null or hold a null or non-finite component are left out. A vector whose integers
    have a squared norm of 2^60 or more raises ArithmeticError, as a long can't hold its results.
    """
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = column.flatten()
    x = np.asarray(flat.fill_null(float("nan")), np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    fine = np.asarray(column.is_valid()) & (bad[starts[1:]] == bad[starts[:-1]])
    out = {}
    for size in np.unique(sizes[fine]).tolist():
        rows = np.flatnonzero(fine & (sizes == size))
        with np.errstate(over="ignore"):
            whole = np.floor(x[starts[rows][:, None] + np.arange(size)] * scale)
            large = ((whole * whole).sum(1) >= NORM_LIMIT).any()
        if large:
            raise ArithmeticError(f"a vector's components are too large for sums of {scale} times their value in a long")
        out[size] = rows, whole.astype(np.int64)
    return out


def usable(embedding: Column) -> Column:
    """Whether floors() keeps a vector of doubles."""
    return embedding.isNotNull() & F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
