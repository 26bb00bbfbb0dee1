"""Range-vector functions over counters and gauges.

The window of step ``t`` is ``(t - range, t]``. Samples are first reduced to panes (one row per
series and pane, cut where windows begin and end), with running sums over the panes of a series.
A window is then told by its first and its last pane: each pane gives the steps whose window it
begins and those whose window it ends, and the difference of the two running sums is the window's.
So a step takes two rows, however many panes its window holds. A reset is a value below its
predecessor; its delta is the value itself. Windows with fewer than two samples give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.constants import CHUNK_US, MAX_POINTS, SECOND
from fleetgauge.functions.scan import lag, ordered_scan
from fleetgauge.functions.text import ceil_to

KEYS = ["instance", "op"]


def reset_aware(previous: Column, value: Column) -> Column:
    """Counter delta; NULL when there is no previous value."""
    return F.when(value < previous, value).otherwise(value - previous)


def pane_end(ts: Column, range_us: int, step_us: int, chunk_us: int | None = None) -> Column:
    """End of the pane of an instant. Panes are cut where windows begin and end, two cuts a step whatever
    the range, and at chunk edges if asked for; so a window holds a pane as a whole or not at all."""
    ends = [ceil_to(ts, step_us)]
    if range_us % step_us:
        ends.append(ceil_to(ts + F.lit(int(range_us)), step_us) - F.lit(int(range_us)))
    if chunk_us and step_us % chunk_us == 0 and range_us % chunk_us == 0:
        return ceil_to(ts, chunk_us)
    if chunk_us and step_us > chunk_us:
        ends.append(ceil_to(ts, chunk_us))
    return F.least(*ends) if len(ends) > 1 else ends[0]


def _from_to(low: Column, high: Column, step_us: int) -> Column:
    """The first step from ``low`` on, and ``high``."""
    return F.struct(ceil_to(low, step_us).alias("low"), high.alias("high"))


def ended_by(end: str, after: Column, range_us: int, step_us: int) -> Column:
    """The steps whose window has the pane that ends at ``end`` as its last; ``after`` is the end of the next pane."""
    return _from_to(F.col(end), F.least(F.col(end) + F.lit(int(range_us) - 1), after - 1), step_us)


def begun_by(end: str, before: Column, range_us: int, step_us: int) -> Column:
    """The steps whose window has the pane that ends at ``end`` as its first; ``before`` is the end of the pane before."""
    return _from_to(F.greatest(F.col(end), before + F.lit(int(range_us))), F.col(end) + F.lit(int(range_us) - 1), step_us)


def _steps(rows: DataFrame, steps: str, step_us: int) -> DataFrame:
    """A row for each step of the struct ``steps``, as ``step_us``."""
    low, high = F.col(f"{steps}.low"), F.col(f"{steps}.high")
    return rows.where(low <= high).withColumn("step_us", F.explode(F.sequence(low, high, F.lit(int(step_us)))))


def counter_panes(samples: DataFrame, keys, values, range_us, step_us, ts="ts_us", tie="event_id") -> DataFrame:
    """Per series and pane: observed delta of every value, sample count, first and last sample."""
    n = range(len(values))
    rows = samples.select(
        *keys, F.col(ts).alias("ts"), F.col(tie).alias("tie"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]
    ).withColumn("pane_us", pane_end(F.col("ts"), range_us, step_us, CHUNK_US))
    order = Window.partitionBy(*keys, "pane_us").orderBy("ts", "tie")
    rows = rows.withColumns({
        **{f"d{i}": reset_aware(F.lag(f"v{i}").over(order), F.col(f"v{i}")) for i in n},
        "gap": F.col("ts") - F.lag("ts").over(order),
    })
    vs, ds = [f"v{i}" for i in n], [f"d{i}" for i in n]
    panes = rows.groupBy(*keys, "pane_us").agg(
        *[F.coalesce(F.sum(d), F.lit(0)).alias(f"inc{i}") for i, d in enumerate(ds)],
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("ts", "tie", *vs)).alias("first"),
        F.max(F.struct("ts", "tie", *vs, *ds, "gap")).alias("last"),
    )
    # One row per pane from here on: add the step from the previous pane's last sample.
    series = Window.partitionBy(*keys).orderBy("pane_us")
    panes = panes.withColumn("before", F.lag("last").over(series))
    edges = [reset_aware(F.col(f"before.v{i}"), F.col(f"first.v{i}")) for i in n]
    return panes.select(
        *keys, "pane_us", "n",
        *[f"inc{i}" for i in n],
        *[F.coalesce(edges[i], F.lit(0)).alias(f"edge{i}") for i in n],
        F.col("first.ts").alias("first_ts"),
        F.col("first.v0").alias("first_v"),
        F.col("last.ts").alias("last_ts"),
        F.when(F.col("n") > 1, F.col("last.d0")).otherwise(edges[0]).alias("last_d"),
        F.when(F.col("n") > 1, F.col("last.gap")).otherwise(F.col("first.ts") - F.col("before.ts")).alias("last_gap"),
    )


def windows_of(panes: DataFrame, range_us: int, step_us: int, keys, count: int = 1, firsts=(), lasts=()) -> DataFrame:
    """Per series and step the increases and the sample count of the window, from panes with ``count`` increases
    (``inc0`` within, ``edge0`` from the pane before, ...); of the columns ``firsts`` the first pane's value, of
    ``lasts`` the last one's."""
    n = range(count)
    series = Window.partitionBy(*keys).orderBy("pane_us")
    panes = panes.withColumns({
        "before_us": F.lag("pane_us").over(series), "after_us": F.lead("pane_us").over(series), "upto_n": F.sum("n").over(series),
        **{f"upto{i}": F.sum(F.col(f"inc{i}") + F.col(f"edge{i}")).over(series) for i in n},
    })
    sides = [F.struct(steps.alias("steps"), F.lit(is_last).alias("last")) for steps, is_last in (
        (ended_by("pane_us", F.col("after_us"), range_us, step_us), True), (begun_by("pane_us", F.col("before_us"), range_us, step_us), False))]
    placed = _steps(panes.withColumn("at", F.explode(F.array(*sides))), "at.steps", step_us)
    last = F.col("at.last")
    # what runs up to the last pane, less what runs up to the first sample of the first one
    placed = placed.select(
        *keys, "step_us", F.when(last, F.col("upto_n")).otherwise(F.col("n") - F.col("upto_n")).alias("n"),
        *[F.when(last, F.col(f"upto{i}")).otherwise(F.col(f"inc{i}") - F.col(f"upto{i}")).alias(f"inc{i}") for i in n],
        *[F.when(~last, F.col(c)).alias(c) for c in firsts], *[F.when(last, F.col(c)).alias(c) for c in lasts],
    )
    return placed.groupBy(*keys, "step_us").agg(
        *[F.sum(c).alias(c) for c in ("n", *[f"inc{i}" for i in n])], *[F.max(c).alias(c) for c in (*firsts, *lasts)],
    ).where("n >= 2")


def counter_windows(samples, range_us, step_us, value="count_total", keys=KEYS, ts="ts_us", tie="event_id") -> DataFrame:
    """Per series and step: increase, sample count and the edge samples of the window.

    ``value`` may be a list; then ``inc0``, ``inc1``, ... hold the increases.
    """
    values = [value] if isinstance(value, str) else list(value)
    panes = counter_panes(samples, keys, values, int(range_us), int(step_us), ts, tie)
    out = windows_of(panes, int(range_us), int(step_us), keys, len(values), ("first_ts", "first_v"), ("last_ts", "last_d", "last_gap"))
    return out.withColumnRenamed("inc0", "inc") if isinstance(value, str) else out


def increase(samples, range_us, step_us, value="count_total", keys=KEYS, per_minute=False, **names) -> DataFrame:
    """Observed reset-aware increase; ``per_minute`` scales it to one minute."""
    out = counter_windows(samples, range_us, step_us, value, keys, **names)
    inc = F.col("inc")
    if per_minute:
        inc = inc.cast("double") * F.lit(60.0 * SECOND) / F.lit(float(range_us))
    return out.select(*keys, "step_us", inc.alias("inc"), "n")


def increase_extrapolated(samples, range_us, step_us, value="count_total", keys=KEYS, **names) -> DataFrame:
    """Increase scaled from the covered span to the whole window."""
    w = counter_windows(samples, range_us, step_us, value, keys, **names).where("last_ts > first_ts")
    dbl = {c: F.col(c).cast("double") for c in ("inc", "first_v", "n", "step_us", "first_ts", "last_ts")}
    covered = (F.col("last_ts") - F.col("first_ts")).cast("double")
    gap = covered / (dbl["n"] - 1)
    left = (F.col("first_ts") - (F.col("step_us") - F.lit(int(range_us)))).cast("double")
    right = (F.col("step_us") - F.col("last_ts")).cast("double")
    left = F.when(left <= gap * F.lit(1.1), left).otherwise(gap / 2)
    right = F.when(right <= gap * F.lit(1.1), right).otherwise(gap / 2)
    to_zero = F.when((F.col("inc") > 0) & (F.col("first_v") >= 0), covered * dbl["first_v"] / dbl["inc"])
    left = F.least(left, to_zero)
    return w.select(*keys, "step_us", (dbl["inc"] * (covered + left + right) / covered).alias("inc_x"))


def rate(samples, range_us, step_us, value="count_total", keys=KEYS, **names) -> DataFrame:
    """Increase per second of range."""
    inc = increase(samples, range_us, step_us, value, keys, **names)
    return inc.select(*keys, "step_us", (F.col("inc").cast("double") / F.lit(range_us / SECOND)).alias("rate"))


def irate(samples, range_us, step_us, value="count_total", keys=KEYS, per_minute=False, **names) -> DataFrame:
    """Per-second delta of the last two samples in the window."""
    w = counter_windows(samples, range_us, step_us, value, keys, **names).where("last_gap > 0")
    out = F.col("last_d").cast("double") * F.lit(float(SECOND)) / F.col("last_gap")
    return w.select(*keys, "step_us", (out * 60 if per_minute else out).alias("irate"))


def counter_resets(samples, value="count_total", keys=KEYS, ts="ts_us", tie="event_id") -> DataFrame:
    """One row per reset: the value before and after."""
    rows = samples.select(*keys, ts, tie, F.col(value).alias("after"))
    return (
        ordered_scan(rows, list(keys), [ts, tie], [lag("after", "before")])
        .where("after < before")
        .select(*keys, ts, "before", "after")
    )


def vector_match(left: DataFrame, right: DataFrame, op: str, on, left_value="value", right_value="value") -> DataFrame:
    """Binary operator between two range results matched on all labels and the step; x/0 is NULL."""
    lhs = left.select(*on, F.col(left_value).alias("_l"))
    rhs = right.select(*on, F.col(right_value).alias("_r"))
    return lhs.join(rhs, list(on)).select(*on, _applied(op, F.col("_l"), F.col("_r")).alias("value"))


def _applied(op: str, a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op]


def rates_matched(samples, range_us, step_us, op: str, left: str, right: str, keys=KEYS, **names) -> DataFrame:
    """The operator between the rates of two values of the same samples: both come from one pass, so that
    they are matched already."""
    both = counter_windows(samples, range_us, step_us, [left, right], keys, **names)
    a, b = (F.col(c).cast("double") / F.lit(range_us / SECOND) for c in ("inc0", "inc1"))
    return both.select(*keys, "step_us", _applied(op, a, b).alias("value"))


def average_ratio(samples, range_us, step_us, total="ms_total", count="count_total", keys=KEYS, **names) -> DataFrame:
    """Mean of ``total`` per ``count`` over the range: quotient of the two increases, from one pass."""
    both = counter_windows(samples, range_us, step_us, [total, count], keys, **names)
    mean = F.try_divide(F.col("inc0").cast("double"), F.col("inc1").cast("double"))
    return both.select(*keys, "step_us", mean.alias("avg_ms"))


def instant_panes(samples, keys, value, range_us, step_us, ts="ts_us", tie="event_id") -> DataFrame:
    """Latest sample per series and pane."""
    return (
        samples.withColumn("pane_us", pane_end(F.col(ts), range_us, step_us))
        .groupBy(*keys, "pane_us")
        .agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(value).alias("v"))).alias("s"))
    )


def instant(samples, step_us, lookback_us, value="value", keys=KEYS, ts="ts_us", tie="event_id") -> DataFrame:
    """Value of each series at each step: latest sample in ``(t - lookback, t]``."""
    panes = instant_panes(samples, keys, value, int(lookback_us), int(step_us), ts, tie)
    after = F.lead("pane_us").over(Window.partitionBy(*keys).orderBy("pane_us"))
    steps = ended_by("pane_us", F.col("after_us"), int(lookback_us), int(step_us))
    placed = _steps(panes.withColumn("after_us", after).withColumn("at", steps), "at", int(step_us))
    return placed.select(*keys, "step_us", F.col("s.v").alias("value"))


def no_data(samples, from_us, to_us, step_us, lookback_us, keys=KEYS, ts="ts_us") -> DataFrame:
    """Steps of the grid at which a known series has no sample in its lookback.

    Only the holes between consecutive covered panes are generated, not the whole grid.
    """
    reach = int(lookback_us) - 1
    first_step = from_us + (-from_us) % step_us
    panes = samples.select(*keys, pane_end(F.col(ts), int(lookback_us), int(step_us)).alias("pane_us")).distinct()
    series = Window.partitionBy(*keys).orderBy("pane_us")
    before = F.lag("pane_us").over(series)
    after = F.lead("pane_us").over(series)
    holes = panes.select(
        *keys, "pane_us",
        # the hole before the first pane, and the one after every pane
        F.when(before.isNull(), F.array(F.struct(
            F.lit(int(first_step)).alias("a"), (F.col("pane_us") - 1).alias("b")))).otherwise(F.array()).alias("lead_hole"),
        F.struct(
            F.greatest(F.col("pane_us") + F.lit(reach + 1), F.lit(int(first_step))).alias("a"),
            F.least(F.coalesce(after - 1, F.lit(int(to_us))), F.lit(int(to_us))).alias("b"),
        ).alias("hole"),
    )
    holes = holes.select(*keys, F.explode(F.concat("lead_hole", F.array("hole"))).alias("h"))
    start = ceil_to(F.col("h.a"), step_us)
    stop = F.least(F.col("h.b"), F.lit(int(to_us)))
    return holes.select(*keys, F.explode(F.when(start <= stop, F.sequence(start, stop, F.lit(int(step_us))))).alias("step_us"))


def last_value(samples, from_us, to_us, value="value", keys=KEYS, ts="ts_us", tie="event_id") -> DataFrame:
    """Reduce each series to its last value in the range."""
    return (
        samples.where(F.col(ts).between(from_us, to_us))
        .groupBy(*keys)
        .agg(F.max_by(value, F.struct(ts, tie)).alias("value"))
    )


def bounded_step(from_us: int, to_us: int, step_us: int, limit: int = MAX_POINTS) -> int:
    """The asked step, widened so that the range has at most ``limit`` points."""
    return max(int(step_us), -(-(to_us - from_us) // limit))
