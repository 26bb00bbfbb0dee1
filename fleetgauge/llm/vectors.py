"""Whole vectors of Arrow batches as integers, and exact sums over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled entries beyond this, of either sign, count as this: a long holds them with room for an offset.
FAR = 1 << 62


def entries(column: str) -> Column:
    """A vector of any numeric type as doubles."""
    return F.col(f"`{column}`").cast("array<double>")


def whole(col: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column and floor(scale * entry) of their entries, for each width that occurs.

    Rows that are null, or hold null or non-finite entries, are left out."""
    n = len(col)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_list(col.type) else np.int32
    at = np.frombuffer(col.buffers()[1], dtype=kind, count=n + 1, offset=col.offset * np.dtype(kind).itemsize).astype(np.int64)
    inner = col.values.slice(at[0], at[-1] - at[0])
    at = at - at[0]
    value = inner.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
    fit = (bad[at[1:]] == bad[at[:-1]]) & col.is_valid().to_numpy(zero_copy_only=False)
    widths = np.diff(at)
    for width in np.unique(widths[fit]):
        rows = np.flatnonzero(fit & (widths == width))
        with np.errstate(over="ignore"):
            scaled = np.floor(value[at[rows][:, None] + np.arange(width)] * scale)
        yield rows, np.where(np.abs(scaled) < FAR, np.clip(scaled, -FAR, FAR), np.sign(scaled) * FAR).astype(np.int64)


def largest(matrix: np.ndarray) -> int:
    """The largest absolute entry."""
    return max(abs(int(matrix.max())), abs(int(matrix.min()))) if matrix.size else 0


def column_sums(matrix: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python integers, exact."""
    wide = largest(matrix) * max(len(matrix), 1) >= 1 << 62
    return (matrix.astype(object) if wide else matrix).sum(axis=0).astype(object)
