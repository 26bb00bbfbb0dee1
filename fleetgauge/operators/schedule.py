"""Business calendars and maintenance windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.constants import (
    DEFAULT_BUSINESS_DAYS, DEFAULT_BUSINESS_HOURS, MAINT_MANUAL, MAINT_NONE, MAINT_OFF_WORDS, MAINT_PREFIXES, MAINT_WINDOW, SECOND, SINCE,
    WILL_END, WILL_START,
)
from fleetgauge.functions.scan import last_seen, ordered_scan, running_max
from fleetgauge.operators.intervals import FOREVER
from fleetgauge.functions.text import duration_text, epoch_us, matched_number, once, whole_div

# --- business calendar -------------------------------------------------------------------

_INT = r"\s*([+-]?\d+)"
_HMS = rf"^{_INT}:{_INT}:{_INT}-{_INT}:{_INT}:{_INT}"
_HM = rf"^{_INT}:{_INT}-{_INT}:{_INT}"
_H = rf"^{_INT}-{_INT}"


def _number(text: Column, pattern: str, group: int) -> Column:
    return matched_number(text, pattern, group, "int")


def hours_seconds(spec: Column) -> tuple[Column, Column, Column]:
    """``6-18``, ``06:00-18:00`` or ``06:00:00-18:00:00`` as (start, end, valid) in seconds of the day."""

    def total(pattern, h, m=None, s=None):
        out = _number(spec, pattern, h) * 3600
        out = out + _number(spec, pattern, m) * 60 if m else out
        return out + _number(spec, pattern, s) if s else out

    hms, hm, h = spec.rlike(_HMS), spec.rlike(_HM), spec.rlike(_H)
    start = (
        F.when(hms, total(_HMS, 1, 2, 3)).when(hm, total(_HM, 1, 2)).when(h, total(_H, 1))
        .otherwise(F.coalesce(_number(spec, "^" + _INT, 1), F.lit(0)) * 3600)
    )
    end = F.when(hms, total(_HMS, 4, 5, 6)).when(hm, total(_HM, 3, 4)).when(h, total(_H, 2)).otherwise(F.lit(0))
    return start, end, hms | hm | h


def weekdays(spec: Column) -> Column:
    """``1-5,0`` as one array of weekdays per token. Ranges wrap; a bad token is NULL."""
    day = lambda c: c.isNotNull() & c.between(0, 6)

    def numbers(t):
        second = F.when(F.contains(t, F.lit("-")), _number(t, rf"^{_INT}-{_INT}", 2)).otherwise(_number(t, f"^{_INT}", 1))
        return F.named_struct(F.lit("a"), _number(t, f"^{_INT}", 1), F.lit("b"), second)

    def span(t):
        ahead = F.pmod(t["b"] - t["a"], F.lit(7))
        return F.when(day(t["a"]) & day(t["b"]), F.transform(F.sequence(t["a"], t["a"] + ahead), lambda d: d % 7))

    tokens = F.transform(F.filter(F.split(spec, ","), lambda t: t != ""), numbers)
    return F.transform(tokens, span)


def calendar_from_spec(config: DataFrame, overrides: DataFrame) -> DataFrame:
    """Seven rows per server with the calendar switched on (a day spec, or ``calendar_on``)."""
    rows = config.where(F.col("days").isNotNull() | F.col("calendar_on")).select(
        "instance", _hours(F.coalesce("hours", F.lit(DEFAULT_BUSINESS_HOURS))).alias("_usual"),
        weekdays(F.coalesce("days", F.lit(DEFAULT_BUSINESS_DAYS))).alias("_tokens"),
    )
    rows = rows.select(
        "instance", "_usual", F.flatten(F.array_compact("_tokens")).alias("_days"),
        F.forall("_tokens", lambda t: t.isNotNull()).alias("_days_ok"),
    )
    rows = rows.withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    special = overrides.select("instance", "weekday", _hours(F.col("hours")).alias("_special"))
    rows = rows.join(special, ["instance", "weekday"], "left").withColumn("_h", F.coalesce("_special", "_usual"))
    return rows.select(
        "instance", "weekday", F.array_contains("_days", F.col("weekday")).alias("is_business_day"),
        F.col("_h.a").alias("start_s"), F.col("_h.b").alias("end_s"), (F.col("_days_ok") & F.col("_h.ok")).alias("valid"),
    )


def _hours(spec: Column) -> Column:
    start, end, ok = hours_seconds(spec)
    return F.when(spec.isNotNull(), F.named_struct(F.lit("a"), start, F.lit("b"), end, F.lit("ok"), ok))


def business_time(samples: DataFrame, calendar: DataFrame, ts="ts_us") -> DataFrame:
    """Add ``business_day`` and ``business_hours`` (0/1); servers without a calendar are always in.

    The calendar is folded to one row per server (seven days), so this is a single equi-join on the server; Spark broadcasts it when it is small enough and splits hot servers
    of a sort-merge join otherwise.
    """
    rows = samples.join(_per_server(calendar), "instance", "left")
    local = whole_div(F.col(ts), SECOND) + (F.col("_dst") - F.col("_zone")) * 3600
    rows = once(rows, {"_local": local})
    # 1970-01-01 was a Thursday; weekday 0 is Sunday.
    weekday = F.pmod(whole_div(F.col("_local"), 86400) + 4, F.lit(7))
    rows = once(rows, {"_day": F.col("_days")[weekday], "_s": F.pmod(F.col("_local"), F.lit(86400))})
    a, b, s = F.col("_day.start_s"), F.col("_day.end_s"), F.col("_s")
    in_hours = F.when(a <= b, s.between(a, b)).otherwise((s >= a) | (s <= b))
    on_day = F.coalesce(F.col("_day.is_business_day"), F.lit(False))
    off = F.col("_days").isNull()
    return rows.withColumns({
        "business_day": F.when(off | on_day, 1).otherwise(0),
        "business_hours": F.when(off | (on_day & in_hours), 1).otherwise(0),
    }).drop("_days", "_zone", "_dst", "_local", "_day", "_s")


def _per_server(calendar: DataFrame) -> DataFrame:
    """One row per server with its week. Of two rows for one weekday the greater in (business day, start, end) counts."""
    day = F.struct("is_business_day", "start_s", "end_s")
    days = calendar.groupBy("instance", F.col("weekday").cast("bigint").alias("k")).agg(
        F.max(day).alias("v"), F.max("zone").alias("zone"), F.max("dst").alias("dst"))
    return days.groupBy("instance").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_days"),  # seven at most
        F.max("zone").alias("_zone"), F.max("dst").alias("_dst"))


def business_parts(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    """What lies in business time of each interval (instance, s, e and more), cut at the calendar's midnights.

    The hours' last second counts whole. Servers without a calendar are always in."""
    rows = intervals.join(_per_server(calendar), "instance", "left")
    shift = (F.col("_dst") - F.col("_zone")) * 3600

    def day_of(us):
        return whole_div(whole_div(us, SECOND) + shift, 86400)

    days = F.when(F.col("_days").isNotNull(), F.sequence(day_of(F.col("s")), day_of(F.col("e") - 1)))
    rows = rows.withColumn("_d", F.explode_outer(days))
    rows = once(rows, {"_day": F.col("_days")[F.pmod(F.col("_d") + 4, F.lit(7))]})
    a, b = F.col("_day.start_s"), F.col("_day.end_s")

    def span(low, high):
        at = lambda second: (F.col("_d") * 86400 + second - shift) * SECOND
        return F.struct(F.greatest(F.col("s"), at(low)).alias("a"), F.least(F.col("e"), at(high)).alias("b"))

    whole = F.array(F.struct(F.col("s").alias("a"), F.col("e").alias("b")))
    zero, end = F.lit(0), F.lit(86400)
    inside = F.when(a <= b, F.array(span(a, b + 1))).otherwise(F.array(span(zero, b + 1), span(a, end)))
    parts = F.when(F.col("_days").isNull(), whole).when(F.col("_day.is_business_day"), inside)
    rows = rows.withColumn("_p", F.explode(parts)).where("_p.b > _p.a")
    return rows.withColumns({"s": F.col("_p.a"), "e": F.col("_p.b")}).select(*intervals.columns)


def business_uptime(up: DataFrame, calendar: DataFrame, ts="ts_us") -> DataFrame:
    """Share of answered probes inside business time per server and UTC day."""
    inside = business_time(up, calendar, ts).where("business_hours = 1")
    return (
        inside.groupBy("instance", whole_div(F.col(ts), 86400 * SECOND).alias("day"))
        .agg(F.sum("value").alias("n_up"), F.count(F.lit(1)).alias("n_all"))
        .withColumn("ratio", F.col("n_up").cast("double") / F.col("n_all"))
    )


# --- maintenance -------------------------------------------------------------------------


def maintenance_status(samples: DataFrame, maint: DataFrame, manual: DataFrame | None = None, ts="ts_us") -> DataFrame:
    """Add ``maintenance_status``: 1 switched on by hand, 3 inside a window (ends inclusive), else 0.

    A sample is inside a window if the latest end among the windows that start no later is not before
    it: one running maximum over windows and samples, whatever the length of a window.
    """
    windows = maint.where("start_us IS NOT NULL AND (end_us IS NULL OR end_us >= start_us)").groupBy(
        "instance", F.col("start_us").alias("_at")).agg(F.max(F.coalesce("end_us", F.lit(FOREVER))).alias("_end"))
    rows = samples.withColumns({"_at": F.col(ts), "_rank": F.lit(1), "_end": F.lit(None).cast("bigint")})
    both = rows.unionByName(windows.withColumn("_rank", F.lit(0)), allowMissingColumns=True)
    rows = ordered_scan(both, ["instance"], ["_at", "_rank"], [running_max("_end", "_until")]).where("_rank = 1")
    status = F.when(F.col("_until") >= F.col(ts), MAINT_WINDOW).otherwise(MAINT_NONE)
    if manual is not None:
        flags = manual.select("instance").distinct().withColumn("_manual", F.lit(True))
        rows = rows.join(flags, "instance", "left")
        status = F.when(F.col("_manual"), MAINT_MANUAL).otherwise(status)
    return rows.withColumn("maintenance_status", status).select(*samples.columns, "maintenance_status")


def maintenance_commands(commands: DataFrame) -> DataFrame:
    """Command text as an action with the start and end it sets.

    ``off``/``clear``, ``on`` (until restart), ``on N``, ``start +N``, ``start <time>``,
    ``end +N``, ``end <time>``; N in minutes, anything else is invalid.
    """
    cmd, now = F.col("cmd"), F.col("ts_us")
    stamp = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?$"

    def minutes(prefix):
        rest = F.expr(f"substring(cmd, {len(prefix) + 1})")
        return F.coalesce(matched_number(rest, r"^\s*([+-]?\d+)", 1), F.lit(0))

    def moment(prefix):
        text = F.expr(f"substring(cmd, {len(prefix) + 1})")
        return F.when(text.rlike(stamp), text.try_cast("timestamp_ntz"))

    after = lambda prefix: now + minutes(prefix) * F.lit(60 * SECOND)
    rows = commands.withColumns({"_start": moment("start "), "_end": moment("end ")})
    rows = rows.withColumns({"_start_us": epoch_us("_start"), "_end_us": epoch_us("_end")})
    off = F.lower(cmd).isin(*MAINT_OFF_WORDS)
    on, start_in, start, end_in, end = (cmd.startswith(p) for p in MAINT_PREFIXES)
    action = (
        F.when(off, "clear")
        .when(on, F.when(minutes("on") == 0, "manual").otherwise("window"))
        .when(start_in, F.when(minutes("start +") == 0, "invalid").otherwise("start"))
        .when(start, F.when(F.col("_start_us").isNull(), "invalid").otherwise("start"))
        .when(end_in, F.when(minutes("end +") == 0, "invalid").otherwise("end"))
        .when(end, F.when(F.col("_end_us").isNull(), "invalid").otherwise("end"))
        .otherwise("invalid")
    )
    rows = rows.withColumn("action", action)
    a = F.col("action")
    return rows.select(
        "instance", "seq", "ts_us", "action",
        F.when(a == "window", now).when(a == "start", F.when(start_in, after("start +")).otherwise(F.col("_start_us"))).alias("start_us"),
        F.when(a == "window", after("on")).when(a == "end", F.when(end_in, after("end +")).otherwise(F.col("_end_us"))).alias("end_us"),
    )


def maintenance_fold(commands: DataFrame) -> DataFrame:
    """State in force after each command: manual flag, start, end.

    The end in force is the one set last, unless a start set since then lies at least a second
    after it; that start clears it. So the fold is a last-value scan and a running maximum of
    starts since the end was set.
    """
    rows = maintenance_commands(commands)
    a = F.col("action")
    order = ["ts_us", "seq"]
    switched = F.when(a == "clear", 0).when(a == "manual", 1)
    start_set = F.when(a.isin("clear", "window", "start"), F.struct("start_us"))
    end_set = F.when(a.isin("clear", "window", "end"), F.struct("ts_us", "seq", "end_us"))
    rows = ordered_scan(rows, ["instance"], order, [
        last_seen(switched, "_manual"), last_seen(start_set, "_start"), last_seen(end_set, "_end"),
    ])
    rows = rows.withColumn("_since", F.coalesce(F.col("_end.seq"), F.lit(-1)))
    moved = F.when(a == "start", F.col("start_us"))
    rows = ordered_scan(rows, ["instance", "_since"], order, [running_max(moved, "_moved")])
    cleared = F.coalesce(F.col("_moved") >= F.col("_end.end_us") + F.lit(SECOND), F.lit(False))
    return rows.select(
        "instance", "seq", F.coalesce("_manual", F.lit(0)).alias("manual"),
        F.col("_start.start_us").alias("start_us"),
        F.when(~cleared, F.col("_end.end_us")).alias("end_us"),
    )


def maintenance_report(servers: DataFrame, maint: DataFrame, at_us: int) -> DataFrame:
    """Per server at an instant: status, time to or since the start, time to the end, bad-order warning.

    ``servers`` has ``instance`` and ``manual``; the latest window of each server counts.
    """
    at = F.struct("start_us", "window_id")
    latest = maint.groupBy("instance").agg(
        F.max_by("start_us", at).alias("start_us"), F.max_by("end_us", at).alias("end_us")
    )
    rows = servers.join(latest, "instance", "left")
    now, start, end = F.lit(int(at_us)), F.col("start_us"), F.col("end_us")
    in_window = (start <= now) & (end.isNull() | (now <= end))
    status = F.when(F.col("manual"), MAINT_MANUAL).when(in_window, MAINT_WINDOW).otherwise(MAINT_NONE)
    to_start, to_end = whole_div(F.abs(start - now), SECOND), whole_div(F.abs(end - now), SECOND)
    starts_later = whole_div(start - now, SECOND) > 0
    return rows.withColumn("status", status).select(
        "instance", "status",
        F.when(start.isNull(), "")
        .when(starts_later, F.concat(F.lit(WILL_START), duration_text(to_start)))
        .when(F.col("status") > 0, F.concat(F.lit(SINCE), duration_text(to_start)))
        .otherwise("").alias("start_text"),
        F.when((F.col("status") > 0) & (whole_div(end - now, SECOND) > 0), F.concat(F.lit(WILL_END), duration_text(to_end)))
        .otherwise("").alias("end_text"),
        F.coalesce(end - start <= F.lit(-SECOND), F.lit(False)).alias("warn"),
    )
