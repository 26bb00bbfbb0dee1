"""Micro-batch tables: what each batch wrote, in one folder per batch.

A batch that is run again after a failure overwrites its own folder, so every batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all available input through ``handle(batch, batch_id)`` and stop."""
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all available input to a Parquet table, each row exactly once."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def added_up(spark: SparkSession, path: str, keys: list[str], totals: dict) -> DataFrame:
    """A table of partial aggregates, one part per batch, aggregated again."""
    return spark.read.parquet(path).groupBy(*keys).agg(*[e.alias(c) for c, e in totals.items()])
