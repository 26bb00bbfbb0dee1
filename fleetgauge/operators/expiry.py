"""Retention that frees space: day partitions leave a table in two steps, both through Spark's catalogue.

    verdicts = store.retention(partition_sizes(spark, "logs"), today)
    retire(spark, "logs", verdicts, now)         # they are gone from the table, their files are not
    purge(spark, "logs", now - grace)            # an hour or a day later: the files go

``retire`` drops the partitions of an external table, which leaves files alone, and hangs their folders into a managed
table beside it, ``<table>_retired``, under the moment of it. Queries that began before go on reading. ``purge`` drops
from that table what was retired up to a moment; as it is managed, Spark removes the folders. Each step can be run
again after a crash: a folder is hung up before it leaves the table, and ``purge`` leaves alone what the table lists.

Days without rows have no partition; rows without a day (NULL) have no age and stay. A day that is written again after it was
retired is a partition of the table again, with what its folder holds, until it is retired again. The catalogue must
be one that outlives the session where the steps run in different ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AT_ONCE = 500  # partitions of one statement


def create(rows: DataFrame, table: str, path: str) -> DataFrame:
    """The rows as an external table with a partition for each ``day``, and the table of its retired partitions."""
    spark = rows.sparkSession
    rows.repartition("day", F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.partitionBy("day").option("path", path).saveAsTable(table)
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    spark.sql(f"CREATE TABLE {table}_retired (n BIGINT, day BIGINT, since BIGINT) USING parquet PARTITIONED BY (day, since)")
    return spark.table(table)


def partition_sizes(spark: SparkSession, table: str) -> DataFrame:
    """day and bytes of each file of the table; no column is read."""
    files = spark.table(table).select("day", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return files.groupBy("day", "file").agg(F.max("bytes").alias("bytes")).select("day", "bytes")


def listed(spark: SparkSession, table: str) -> list[dict[str, int]]:
    """The partitions a table lists (one row a day), without that of rows without a day."""
    names = [r["partition"] for r in spark.sql(f"SHOW PARTITIONS {table}").toLocalIterator()]
    parts = [dict(p.split("=", 1) for p in n.split("/")) for n in names]
    return [{k: int(x) for k, x in p.items()} for p in parts if p["day"] not in ("null", "__HIVE_DEFAULT_PARTITION__")]


def _location(spark: SparkSession, table: str, day: int) -> str:
    rows = spark.sql(f"DESCRIBE FORMATTED {table} PARTITION (day = {day})").where("col_name = 'Location'")
    return rows.first()["data_type"]


def _drop(spark: SparkSession, table: str, parts: list[dict[str, int]]) -> None:
    for i in range(0, len(parts), AT_ONCE):
        specs = ", ".join("PARTITION (" + ", ".join(f"{k} = {x}" for k, x in p.items()) + ")" for p in parts[i:i + AT_ONCE])
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")


def retire(spark: SparkSession, table: str, verdicts: DataFrame, now: int) -> list[int]:
    """Take the days whose ``keep`` is false out of the table, as of ``now``; those days, in order.

    ``verdicts`` is (day, keep), one row a day, as ``store.retention`` gives it."""
    out = {r["day"] for r in verdicts.where("NOT keep").select("day").toLocalIterator()}
    days = sorted(p["day"] for p in listed(spark, table) if p["day"] in out)
    for day in days:
        where = _location(spark, table, day).replace("'", "\\'")
        spark.sql(f"ALTER TABLE {table}_retired ADD IF NOT EXISTS PARTITION (day = {day}, since = {now}) LOCATION '{where}'")
    _drop(spark, table, [{"day": d} for d in days])
    return days


def purge(spark: SparkSession, table: str, until: int) -> list[int]:
    """Remove the files of what was retired up to ``until``; its days, in order."""
    alive = {p["day"] for p in listed(spark, table)}
    old = [p for p in listed(spark, f"{table}_retired") if p["since"] <= until and p["day"] not in alive]
    _drop(spark, f"{table}_retired", old)
    return sorted({p["day"] for p in old})
