"""Publishing, retention and latest-state tables."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgauge.constants import METRIC_RETENTION_BYTES, METRIC_RETENTION_DAYS


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions under ``path`` (those Spark's committer has marked)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [n for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def _claimed(spark: SparkSession, name: str) -> bool:
    """Whether the file could be made: of several writers one succeeds."""
    file = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(file):
        return False
    try:
        fs.create(file, False).close()
    except Py4JJavaError:
        return False
    return True


def publish(df: DataFrame, path: str) -> int:
    """Write a complete snapshot as the next version; readers never see half of one.

    A version counts once its commit marker exists, which Spark writes last. A writer claims its number
    first, so two of them never write to one folder; the number of a failed write is not used again.
    """
    spark = df.sparkSession
    version = max(_versions(spark, path), default=0) + 1
    while not _claimed(spark, f"{path}/_claims/v={version}"):  # another writer took it
        version += 1
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete snapshot."""
    done = _versions(spark, path)
    if not done:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.parquet(f"{path}/v={done[-1]}")


def retention(
    sizes: DataFrame, today: int, max_age_days: int = METRIC_RETENTION_DAYS, max_bytes: int = METRIC_RETENTION_BYTES
) -> DataFrame:
    """Which day partitions to keep: young enough, and the newest that fit into ``max_bytes``.

    ``sizes`` is (day, bytes) per file or partition; the running total sees one row per day.
    """
    days = sizes.groupBy("day").agg(F.sum("bytes").alias("bytes"))
    newest_first = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.sum("bytes").over(newest_first) <= F.lit(int(max_bytes))
    young = F.col("day") >= F.lit(int(today - max_age_days))
    return days.withColumn("keep", young & fits)


KEY = ("package", "name")


def last_updates(updates: DataFrame) -> DataFrame:
    """The last update of each (package, name) as ``u`` (ts_us, event_id, value); a NULL value is kept, as a delete."""
    return updates.groupBy(*KEY).agg(F.max(F.struct("ts_us", "event_id", "value")).alias("u"))


def current(state: DataFrame, deletes: DataFrame) -> DataFrame:
    """package, name, value as they stand: a NULL value deletes the name, and a package delete (package, ts_us,
    event_id) removes everything the package got up to then."""
    wiped = deletes.groupBy("package").agg(F.max(F.struct("ts_us", "event_id")).alias("d"))
    rows = state.join(wiped, "package", "left")
    alive = F.col("d").isNull() | (F.struct("u.ts_us", "u.event_id") > F.col("d"))
    return rows.where(alive & F.col("u.value").isNotNull()).select(*KEY, "u.value")


def latest_state(updates: DataFrame, deletes: DataFrame) -> DataFrame:
    """Current value per (package, name) from all updates (package, name, value, ts_us, event_id) and package deletes."""
    return current(last_updates(updates), deletes)


def _bucketed(rows: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """The rows as a table in buckets of their key ``k``, which is never NULL (a null-safe join would not keep them)."""
    if "k" not in rows.columns:
        rows = rows.withColumn("k", F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}))
    rows.write.bucketBy(buckets, "k").sortBy("k").option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def start_state(updates: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """The state after a first batch of updates, as a table bucketed by its key under ``path``."""
    return _bucketed(last_updates(updates), table, path, buckets)


def merged(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State and last updates of a batch, both in buckets: the later update of each key."""
    rows = state.alias("a").join(batch.alias("b"), "k", "full")
    here = F.col("a.u").isNotNull()
    return rows.select("k", *[F.when(here, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in KEY], F.greatest("a.u", "b.u").alias("u"))


def upsert(state: DataFrame, updates: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """The state after one more batch, as a new table. Only the batch is shuffled, to the buckets of the state; the two
    meet bucket by bucket, and the result is in its buckets already. Updates may come late: the later one stays."""
    batch = _bucketed(last_updates(updates), f"{table}_batch", f"{path}_batch", buckets)
    return _bucketed(merged(state, batch), table, path, buckets)
