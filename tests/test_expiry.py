"""Retention: partitions leave the table first, their files after a grace."""

import os
import uuid

from fleetgauge.operators import expiry, store


def days_of(spark, table):
    return sorted((str(r["day"]), r["n"]) for r in spark.table(table).groupBy("day").count().withColumnRenamed("count", "n").collect())


def test_two_steps_and_a_reader_between(spark, tmp_path):
    name, path = f"t{uuid.uuid4().hex}", str(tmp_path / "it's data")
    rows = spark.createDataFrame([(d, f"{d}-{i}") for d in (1, 2, 3, 4, None) for i in range(5)], "day long, line string")
    expiry.create(rows, name, path)
    assert days_of(spark, name) == [(str(d), 5) for d in (1, 2, 3, 4)] + [("None", 5)]
    sizes = expiry.partition_sizes(spark, name)
    on_disk = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-"))
    assert sizes.agg({"bytes": "sum"}).first()[0] == on_disk

    reader = spark.table(name)
    reader.collect()
    began = reader.selectExpr("line").toLocalIterator()  # a query that began before
    next(began)
    verdicts = store.retention(sizes.where("day IS NOT NULL"), 5, max_age_days=2, max_bytes=10**9)
    assert expiry.retire(spark, name, verdicts, 100) == [1, 2]
    assert days_of(spark, name) == [("3", 5), ("4", 5), ("None", 5)]
    assert len(list(began)) == 24 and os.path.isdir(f"{path}/day=1")
    assert expiry.retire(spark, name, verdicts, 101) == []  # nothing twice

    assert expiry.purge(spark, name, 99) == [] and os.path.isdir(f"{path}/day=1")
    assert expiry.purge(spark, name, 100) == [1, 2]
    assert not os.path.exists(f"{path}/day=1") and not os.path.exists(f"{path}/day=2") and os.path.isdir(f"{path}/day=3")
    assert days_of(spark, name) == [("3", 5), ("4", 5), ("None", 5)] and expiry.purge(spark, name, 10**6) == []


def test_a_crash_between_and_a_day_that_comes_back(spark, tmp_path):
    name, path = f"t{uuid.uuid4().hex}", str(tmp_path / "data")
    rows = spark.createDataFrame([(d, "x") for d in (1, 2)], "day long, line string")
    expiry.create(rows, name, path)
    where = expiry._location(spark, name, 1)
    spark.sql(f"ALTER TABLE {name}_retired ADD PARTITION (day = 1, since = 5) LOCATION '{where}'")  # hung up, not yet dropped
    assert expiry.purge(spark, name, 10) == [] and days_of(spark, name) == [("1", 1), ("2", 1)]
    verdicts = spark.createDataFrame([(1, False), (2, True), (7, False)], "day long, keep boolean")
    assert expiry.retire(spark, name, verdicts, 20) == [1]
    rows.where("day = 1").select("line", "day").write.insertInto(name)  # written again
    assert dict(days_of(spark, name))["1"] == 2
    assert expiry.purge(spark, name, 30) == [] and os.path.isdir(f"{path}/day=1")
    assert expiry.retire(spark, name, verdicts, 40) == [1] and expiry.purge(spark, name, 40) == [1]
    assert days_of(spark, name) == [("2", 1)] and not os.path.exists(f"{path}/day=1")


def test_an_empty_table(spark, tmp_path):
    name = f"t{uuid.uuid4().hex}"
    expiry.create(spark.createDataFrame([], "day long, line string"), name, str(tmp_path / "data"))
    assert expiry.retire(spark, name, store.retention(expiry.partition_sizes(spark, name), 5), 1) == []
    assert expiry.purge(spark, name, 1) == []
