"""Alert rules over time: hold times, inhibition, suppression, grouping."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.constants import RESOLVE_TIMEOUT_US
from fleetgauge.functions.scan import lag, last_seen, ordered_scan, running_max, running_sum
from fleetgauge.operators.intervals import FOREVER, minus
from fleetgauge.workdir import settled


def alert_episodes(evals: DataFrame, for_us: int, keep_us: int = 0, keys=("instance",), ts="ts_us", tie="event_id") -> DataFrame:
    """Runs of true evaluations: when active, when firing (held ``for_us``), when resolved.

    ``keep_us`` keeps a firing alert up until the condition was false that long; a true
    evaluation before then continues the same alert.
    """
    keys, order = list(keys), [ts, tie]
    was = F.coalesce("_was", F.lit(False))
    marks = [
        last_seen(F.when(F.col("active") & ~was, F.struct(*order)), "_episode"),
        last_seen(F.when(~F.col("active") & was, F.col(ts)), "_fell"),
    ]
    rows = ordered_scan(
        evals.select(*keys, *order, "active"), keys, order, [lag("active", "_was")], marks if keep_us else marks[:1]
    ).where("_episode IS NOT NULL")
    held = F.col("active") & (F.col(ts) >= F.col(f"_episode.{ts}") + F.lit(int(for_us)))
    ends = [F.min(F.when(~F.col("active"), F.col(ts))).alias("resolved_at")]
    if keep_us:
        ends.append(F.min(F.when(~F.col("active") & (F.col(ts) >= F.col("_fell") + F.lit(int(keep_us))), F.col(ts))).alias("_kept"))
    episodes = rows.groupBy(*keys, "_episode").agg(F.min(F.when(held, F.col(ts))).alias("fires_at"), *ends)
    episodes = episodes.withColumn("active_at", F.col(f"_episode.{ts}"))
    if keep_us:
        episodes = _continued(episodes, keys)
    return episodes.select(*keys, "active_at", "fires_at", "resolved_at")


def _continued(episodes: DataFrame, keys: list[str]) -> DataFrame:
    """Join a firing episode with those that follow before its keep time has run out."""
    order = ["active_at"]
    chain = episodes.withColumn("_open", F.col("_kept").isNull())
    cut = F.when(F.coalesce("_prev_open", F.lit(False)), 0).otherwise(1)
    chain = ordered_scan(chain, keys, order, [lag(F.col("_open"), "_prev_open")], [running_sum(cut, "_chain")])
    fired = F.when(F.col("fires_at").isNotNull(), 1).otherwise(0)
    chain = ordered_scan(chain, [*keys, "_chain"], order, [running_max(fired, "_firing")])
    one = F.when(F.col("_firing") == 1, F.lit(-1)).otherwise(F.col("active_at"))
    return (
        chain.withColumn("_one", one)
        .groupBy(*keys, "_chain", "_one")
        .agg(
            F.min("active_at").alias("active_at"),
            F.min("fires_at").alias("fires_at"),
            F.max_by(F.when(F.col("_firing") == 1, F.col("_kept")).otherwise(F.col("resolved_at")), "active_at").alias("resolved_at"),
        )
    )


def _spans(alerts: DataFrame, until_us: int | None = None) -> DataFrame:
    """Alerts with their time as [s, e); an open one reaches ``until_us``, or has no end."""
    open_end = F.lit(FOREVER if until_us is None else int(until_us))
    return alerts.withColumns({"s": F.col("starts_us"), "e": F.coalesce("ends_us", open_end)})


def _parts(spans: DataFrame, columns: list[str]) -> DataFrame:
    """Back to alerts: an open alert's last part stays open."""
    last = F.col("ends_us").isNull() & (F.col("e") == F.col("_open"))
    return spans.withColumns({"starts_us": F.col("s"), "ends_us": F.when(~last, F.col("e"))}).select(*columns)


def alert_inhibit(alerts: DataFrame, source="critical", target="warning", equal=("alertname", "instance")) -> DataFrame:
    """Mute ``target`` alerts while a ``source`` alert with equal labels is active; other alerts stay as they are.

    A target comes out as the parts of its time that no source covers: none, one or several rows.
    """
    equal = list(equal)
    # alerts are few beside the evaluations they come from; written once, the rule is not evaluated for every use
    role = F.when(F.col("severity") == source, 1).when(F.col("severity") == target, 2).otherwise(0)
    spans = settled(_spans(alerts).withColumns({"_open": F.lit(FOREVER), "_role": role}))
    left = minus(spans.where("_role = 2").drop("_role"), spans.where("_role = 1").select(*equal, "s", "e"), equal)
    return _parts(left, alerts.columns).unionByName(spans.where("_role <> 2").select(*alerts.columns))


def alert_suppress(alerts: DataFrame, calendar: DataFrame, maint: DataFrame, until_us: int, manual: DataFrame | None = None) -> DataFrame:
    """Mute alerts outside business time and inside maintenance: the parts of each alert that are left.

    Open alerts are followed up to ``until_us``; parts are cut at the calendar's midnights. Servers
    switched to maintenance by hand have no alerts.
    """
    from fleetgauge.operators.schedule import business_parts

    spans = _spans(alerts, until_us).withColumn("_open", F.lit(int(until_us)))
    if manual is not None:
        spans = spans.join(manual.select("instance").distinct(), "instance", "left_anti")
    inside = business_parts(spans.where("e > s"), calendar)
    windows = maint.where("start_us IS NOT NULL").select(
        "instance", F.col("start_us").alias("s"), F.coalesce(F.col("end_us") + 1, F.lit(FOREVER)).alias("e"))
    return _parts(minus(inside, windows, ["instance"]), alerts.columns)


def alert_groups(alerts: DataFrame, at_us: int, by=("alertname", "cluster", "service"), updated: str | None = None) -> DataFrame:
    """Alerts active at an instant per group; a missing label counts as empty.

    With ``updated``, the column of an alert's last report, one without an end is over once the
    resolve timeout has passed since then.
    """
    known = with_resolve_timeout(alerts, updated=updated) if updated else alerts
    at = F.lit(int(at_us))
    active = known.where((F.col("starts_us") <= at) & (F.col("ends_us").isNull() | (F.col("ends_us") > at)))
    return active.groupBy(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n"), F.min("starts_us").alias("starts_us")
    )


def alert_text(alerts: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Fill ``{{ $labels.x }}`` in the given templates from the alert's columns."""

    def filled(template: str):
        parts = re.split(r"\{\{\s*\$labels\.(\w+)\s*\}\}", template)
        pieces = [
            F.coalesce(F.col(p), F.lit("")) if i % 2 else F.lit(p)
            for i, p in enumerate(parts)
        ]
        return F.concat(*pieces)

    return alerts.withColumns({name: filled(t) for name, t in templates.items()})


def with_resolve_timeout(alerts: DataFrame, timeout_us: int = RESOLVE_TIMEOUT_US, updated: str = "updated_us") -> DataFrame:
    """Alerts without an end are over ``timeout_us`` after they were last reported."""
    return alerts.withColumn("ends_us", F.coalesce("ends_us", F.col(updated) + F.lit(int(timeout_us))))
