"""Jobs over the range of the events, on tables of other times than the test tables'."""

import os

import pytest
from check import compare, duck
from pyspark.sql import functions as F

from fleetgauge.constants import DAY
from fleetgauge.plans import views as v
from fleetgauge.plans.jobs import CHECKS, JOBS

SF = "/root/testdata/sf0.001"
KEYS = (("li_max_points", "step_us"), ("wn_alert_nodata", "step_us"), ("ag_mail_age_buckets", "scan_us"))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def beside(path, events):
    """A folder of test tables with other events."""
    events.write.parquet(f"{path}/events.parquet")
    for name in os.listdir(SF):
        if name != "events.parquet":
            os.symlink(f"{SF}/{name}", f"{path}/{name}")
    return str(path)


def test_a_longer_table(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    late = rows.withColumn("ts", F.expr("ts + INTERVAL 40 DAYS")).withColumn("event_id", F.col("event_id") + 10_000_000)
    early = rows.withColumn("ts", F.expr("ts - INTERVAL 5 DAYS")).withColumn("event_id", F.col("event_id") + 20_000_000)
    rows.unionByName(late).unionByName(early).write.parquet(f"{tmp_path}/events.parquet")
    low, high = v.extent(spark, str(tmp_path))
    assert v.extent(spark, SF) == (v.FROM_US, v.TO_US) and (low, high) == (v.FROM_US - 5 * DAY, v.TO_US + 40 * DAY)
    for key, column in KEYS:
        first, last, n = JOBS[key](spark, str(tmp_path)).agg(F.min(column), F.max(column), F.countDistinct(column)).first()
        assert low <= first < v.FROM_US and v.TO_US < last <= high, key
        assert key != "li_max_points" or n <= 481


def test_a_year_later_and_a_few_days_only(spark, tmp_path):
    """Job and twin take the same range from the events, and nothing comes of other times."""
    rows = spark.read.parquet(f"{SF}/events.parquet").where("ts < TIMESTAMP_NTZ'2024-01-09'")
    sf = beside(tmp_path, rows.withColumn("ts", F.expr("ts + INTERVAL 1 YEAR")))
    con = duck_of(sf)
    for key, column in KEYS:
        ok, note = compare(spark, con, sf, key, JOBS[key], CHECKS[key])
        assert ok, note
        assert JOBS[key](spark, sf).agg(F.min(column)).first()[0] >= v.FROM_US + 366 * DAY


def duck_of(sf):
    con = duck(SF)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    return con


def test_no_events(spark, tmp_path):
    sf = beside(tmp_path, spark.read.parquet(f"{SF}/events.parquet").limit(0))
    assert all(JOBS[key](spark, sf).count() == 0 for key, _ in KEYS)
