"""Helpers of the document operators: tables, byte views of Arrow batches, runs of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, at least one row each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = offsets(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, one more than its rows."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    raw = np.frombuffer(col.buffers()[1], dtype=kind, count=len(col) + 1, offset=col.offset * kind.itemsize)
    return raw.astype(np.int64)


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without nulls as one array, with the offset of each row in it."""
    at = offsets(col)
    data = col.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8, count=int(at[-1] - at[0]), offset=int(at[0])), at - at[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges start..start+length, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
