"""Range vectors, instants and label jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.constants import DAY, HOUR, MAX_POINTS, MINUTE
from fleetgauge.functions.text import rounded
from fleetgauge.operators import rangevec as rv
from fleetgauge.plans import views as v
from fleetgauge.plans.registry import job

RANGE, STEP = DAY, 6 * HOUR


def windows_sql(range_us: int, step_us: int | str, beside: str = "") -> dict[str, str]:
    """``step_us`` may be a column of the view ``beside``."""
    order = "PARTITION BY instance, op ORDER BY ts_us, event_id"
    return {
        "pairs": f"""SELECT *, lag(count_total) OVER w AS pc, lag(ms_total) OVER w AS pm, lag(ts_us) OVER w AS pt
                     FROM counters WINDOW w AS ({order})""",
        "deltas": """SELECT *, CASE WHEN pc IS NULL THEN 0 WHEN count_total < pc THEN count_total ELSE count_total - pc END AS dc,
                       CASE WHEN pm IS NULL THEN 0 WHEN ms_total < pm THEN ms_total ELSE ms_total - pm END AS dm FROM pairs""",
        "placed": f"""SELECT deltas.*, unnest(range(((ts_us + {step_us} - 1) // {step_us}) * {step_us}, ts_us + {range_us}, {step_us})) AS step_us
                      FROM deltas{beside}""",
        "w": """SELECT instance, op, step_us, CAST(sum(dc) - min_by(dc, ts_us) AS BIGINT) AS inc,
                  CAST(sum(dm) - min_by(dm, ts_us) AS BIGINT) AS inc_ms, count(*) AS n,
                  min(ts_us) AS first_ts, max(ts_us) AS last_ts, min_by(count_total, ts_us) AS first_v,
                  max_by(dc, ts_us) AS last_d, max_by(ts_us - pt, ts_us) AS last_gap
                FROM placed GROUP BY instance, op, step_us HAVING count(*) >= 2""",
    }


WINDOWS = windows_sql(RANGE, STEP)


@job("wn_increase", "SELECT instance, op, step_us, inc, n FROM w", "counters", WINDOWS)
def wn_increase(spark, sf):
    return rv.increase(v.counters(spark, sf), RANGE, STEP)


@job("wn_increase_extrapolated", f"""
    SELECT instance, op, step_us, floor(inc * (covered + l2 + r2) / covered * 1000 + 0.5) / 1000 AS inc_x FROM (
      SELECT *, least(l1, CASE WHEN inc > 0 AND first_v >= 0 THEN covered * first_v / inc END) AS l2, r1 AS r2 FROM (
        SELECT *, CASE WHEN lft <= gap * 1.1::DOUBLE THEN lft ELSE gap / 2 END AS l1,
               CASE WHEN rgt <= gap * 1.1::DOUBLE THEN rgt ELSE gap / 2 END AS r1 FROM (
          SELECT instance, op, step_us, CAST(inc AS DOUBLE) AS inc, CAST(first_v AS DOUBLE) AS first_v,
            CAST(last_ts - first_ts AS DOUBLE) AS covered, CAST(last_ts - first_ts AS DOUBLE) / (CAST(n AS DOUBLE) - 1) AS gap,
            CAST(first_ts - (step_us - {RANGE}) AS DOUBLE) AS lft, CAST(step_us - last_ts AS DOUBLE) AS rgt
          FROM w WHERE last_ts > first_ts)))""", "counters", WINDOWS)
def wn_increase_extrapolated(spark, sf):
    out = rv.increase_extrapolated(v.counters(spark, sf), RANGE, STEP)
    return out.withColumn("inc_x", rounded(F.col("inc_x"), 3))


@job("wn_rate", f"SELECT instance, op, step_us, CAST(inc AS DOUBLE) / {RANGE / 1e6!r}::DOUBLE AS rate FROM w", "counters", WINDOWS)
def wn_rate(spark, sf):
    return rv.rate(v.counters(spark, sf), RANGE, STEP)


@job("wn_irate", """SELECT instance, op, step_us, CAST(last_d AS DOUBLE) * 1000000.0::DOUBLE / CAST(last_gap AS DOUBLE) AS irate
    FROM w WHERE last_gap > 0""", "counters", WINDOWS)
def wn_irate(spark, sf):
    return rv.irate(v.counters(spark, sf), RANGE, STEP)


@job("wn_counter_resets", "SELECT instance, op, ts_us, pc AS before, count_total AS after FROM pairs WHERE count_total < pc",
     "counters", {"pairs": WINDOWS["pairs"]})
def wn_counter_resets(spark, sf):
    return rv.counter_resets(v.counters(spark, sf))


@job("jn_vector_match", """SELECT instance, op, step_us, CASE WHEN inc = 0 THEN NULL ELSE
      (CAST(inc_ms AS DOUBLE) / 86400.0::DOUBLE) / (CAST(inc AS DOUBLE) / 86400.0::DOUBLE) END AS value FROM w""", "counters", WINDOWS)
def jn_vector_match(spark, sf):
    return rv.rates_matched(v.counters(spark, sf), RANGE, STEP, "/", "ms_total", "count_total")


@job("ag_avg_response", """SELECT instance, op, step_us, CASE WHEN inc = 0 THEN NULL
      ELSE CAST(inc_ms AS DOUBLE) / CAST(inc AS DOUBLE) END AS avg_ms FROM w""", "counters", WINDOWS)
def ag_avg_response(spark, sf):
    return rv.average_ratio(v.counters(spark, sf), RANGE, STEP)


ASKED_STEP = 1 * MINUTE
LIMIT = 480
assert rv.bounded_step(0, 30 * DAY, ASKED_STEP, LIMIT) == 90 * MINUTE and rv.bounded_step(0, 30 * DAY, ASKED_STEP, MAX_POINTS) == MINUTE
LIMITED = {"grid": f"SELECT greatest({ASKED_STEP}, (high - low + {LIMIT - 1}) // {LIMIT}) AS step FROM extent"}


@job("li_max_points", "SELECT instance, op, step_us, inc, n FROM w WHERE step_us BETWEEN (SELECT low FROM extent) AND (SELECT high FROM extent)",
     "counters extent", LIMITED | windows_sql(9 * HOUR, "step", ", grid"))
def li_max_points(spark, sf):
    low, high = v.extent(spark, sf)
    out = rv.increase(v.counters(spark, sf), 9 * HOUR, rv.bounded_step(low, high, ASKED_STEP, LIMIT))
    return out.where(F.col("step_us").between(low, high))


LOOKBACK = 30 * MINUTE
GRID = 15 * MINUTE
INSTANT = {"spread": f"""
    SELECT instance, op, ts_us, event_id, value,
      unnest([((ts_us + {GRID} - 1) // {GRID}) * {GRID} + i * {GRID} FOR i IN range({LOOKBACK // GRID})]) AS step_us FROM gauges""",
    "covered": "SELECT instance, op, step_us, max_by(value, ts_us) AS value FROM spread GROUP BY ALL"}


@job("jn_instant_asof", "SELECT * FROM covered", "gauges", INSTANT)
def jn_instant_asof(spark, sf):
    return rv.instant(v.gauges(spark, sf), GRID, LOOKBACK)


@job("wn_alert_nodata", f"""
    SELECT s.instance, s.op, g.step_us FROM (SELECT DISTINCT instance, op FROM gauges) s
    CROSS JOIN (SELECT unnest(range(low, high + 1, {GRID})) AS step_us FROM extent) g
    ANTI JOIN covered c ON c.instance = s.instance AND c.op = s.op AND c.step_us = g.step_us""", "gauges extent", INSTANT)
def wn_alert_nodata(spark, sf):
    return rv.no_data(v.gauges(spark, sf), *v.extent(spark, sf), GRID, LOOKBACK)


@job("ag_last_reducer", f"""SELECT instance, op, max_by(value, ts_us) AS value FROM gauges
    WHERE ts_us BETWEEN {v.AT_US - 10 * DAY} AND {v.AT_US} GROUP BY ALL""", "gauges")
def ag_last_reducer(spark, sf):
    low, high = v.AT_US - 10 * DAY, v.AT_US
    return rv.last_value(v.gauges(spark, sf, low, high), low, high)
