"""Every named job against its SQL twin on the small tables, and its plan."""

import os

import pytest
from check import compare, duck

import __spark_entry__ as entry
from fleetgauge.plans.jobs import CHECKS, JOBS

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = dict(JOBS), dict(CHECKS)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_as_sql(spark, con, key):
    ok, note = compare(spark, con, SF, key, QUERIES[key], ORACLE.get(key))
    assert ok, note


def test_every_job_has_a_twin():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 1137


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if not k.startswith("st_")))
def test_no_pairwise_join(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("key, columns", [
    ("flt_value_types", {"event_id"}),
    ("wn_alert_for", {"event_id", "ts", "user_id", "event_type"}),
    ("ag_txn_extents", {"l_orderkey", "l_suppkey", "l_linenumber"}),
])
def test_scan_reads_only_what_it_needs(spark, key, columns):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = {c.split(":")[0] for part in plan.split("ReadSchema: struct<")[1:] for c in part.split(">")[0].split(",")}
    assert read == columns


@pytest.mark.parametrize("key, pushed", [
    ("flt_time_range", ["GreaterThanOrEqual(ts,", "LessThanOrEqual(ts,"]), ("ag_last_reducer", ["GreaterThanOrEqual(ts,", "LessThanOrEqual(ts,"]),
    ("flt_label_match", ["EqualTo(event_type,click)"]),
])
def test_filters_reach_the_scan(spark, key, pushed):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert all(p in filters for p in pushed), filters
