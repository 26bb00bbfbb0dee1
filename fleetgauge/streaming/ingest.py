"""Continuous ingest of metric files and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.constants import DAY, MINUTE
from fleetgauge.functions.text import stat_key, whole_div
from fleetgauge.sources.exposition import parse_samples
from fleetgauge.sources.logs import log_times, parse_access_log
from fleetgauge.streaming.folds import MISSING, SnapshotProcessor
from fleetgauge.streaming.tail import follow


def metric_stream(spark: SparkSession, path: str, file_part: str = "(.*)", files_per_batch: int = 10_000) -> DataFrame:
    """Samples of every new metric file under ``path``."""
    lines = (
        spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).text(path)
        .select(F.regexp_extract("_metadata.file_path", file_part, 1).alias("file"), "value")
    )
    return parse_samples(lines)


def line_stream(spark: SparkSession, path: str, job: str, growing: bool = True) -> DataFrame:
    """Log lines with the static job label: of files that grow and are rotated (see ``tail``), or, unless
    ``growing``, of every new file in any store that Spark reads."""
    if growing:
        return follow(spark, path).select(F.lit(job).alias("job"), "line")
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path)
    return lines.select(F.lit(job).alias("job"), F.col("value").alias("line"))


def requests_per_minute(lines: DataFrame) -> DataFrame:
    """Requests per minute, method and status of one batch of lines; parts of several batches add up.

    Lines without a usable time count under a NULL minute, so no line is lost, however late it comes.
    """
    logs = log_times(parse_access_log(lines))
    minute = F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(MINUTE))
    return logs.groupBy(minute.alias("minute_us"), "method", "status").agg(F.count(F.lit(1)).alias("n"))


def first_of_snapshot(stats: DataFrame, snapshot_us: int = DAY, delay_us: int = 0) -> DataFrame:
    """instance, snapshot, key, event_id and value_milli of the first row, n rows: given once a snapshot is closed, when
    the stream's newest row is ``delay_us`` past its end. Until then its names are state, afterwards nothing is. Rows
    that come to a closed snapshot are given as they come, ``late``. Rows without a name count nothing, but tell the time.
    """
    timed = stats.withColumn("_time", F.timestamp_micros("ts_us")).withWatermark("_time", f"{int(delay_us)} microseconds")
    named = F.col("facility").isNotNull() & F.col("stat").isNotNull()
    rows = timed.select(
        "instance", whole_div(F.col("ts_us"), snapshot_us).alias("snapshot"), F.when(named, stat_key()).alias("key"),
        *[F.coalesce(F.col(c).cast("bigint"), F.lit(MISSING)).alias(c) for c in ("event_id", "value_milli")], F.lit(1).cast("bigint").alias("n"))
    closes = SnapshotProcessor(["instance", "snapshot"], lambda snapshot: (snapshot + 1) * snapshot_us // 1000)
    schema = "instance string, snapshot bigint, key string, event_id bigint, value_milli bigint, n bigint, late boolean"
    return rows.groupBy("instance", "snapshot").transformWithStateInPandas(closes, schema, "Append", "EventTime")


def firsts(spark: SparkSession, path: str) -> DataFrame:
    """instance, snapshot, key, value of the first row and the number of rows after it, late rows included."""
    rows = spark.read.parquet(path).groupBy("instance", "snapshot", "key").agg(
        F.min(F.struct("event_id", "value_milli")).alias("first"), F.sum("n").alias("n"))
    return rows.select("instance", "snapshot", "key", F.nullif("first.value_milli", F.lit(MISSING)).alias("value"), (F.col("n") - 1).alias("n_dup"))
