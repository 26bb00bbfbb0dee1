"""A full collection: every family of one snapshot per server, ready to render.

Each function gives rows of (instance, name, labels, value_text); ``labels.union_families`` puts
them together. Metric names are fixed values; the prefix is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.constants import HEALTH_PREFIX, SECOND, STAT_PREFIX, TRANS_PREFIX
from fleetgauge.functions.text import milli_text, prefixed, whole_div
from fleetgauge.operators import filters, normalize

ARCHIVE_STYLE = 1


def _no_labels() -> Column:
    return F.create_map().cast("map<string,string>")


def emit(rows: DataFrame, prefix: str | None, rules: dict[str, tuple[Column, Column]], labels: Column | None = None) -> DataFrame:
    """One sample per metric whose guard holds; values are already text or whole numbers."""
    samples = F.array(*[
        F.when(guard, F.struct(prefixed(prefix, F.lit(name)).alias("name"), value.cast("string").alias("value_text")))
        for name, (guard, value) in rules.items()
    ])
    out = rows.select("instance", (_no_labels() if labels is None else labels).alias("labels"), F.explode(F.array_compact(samples)).alias("s"))
    return out.select("instance", "s.name", "labels", "s.value_text").where("value_text IS NOT NULL")


def _seconds(us: str) -> Column:
    return whole_div(F.col(us), SECOND)


def common(servers: DataFrame, at_us: int, build: int, prefix=HEALTH_PREFIX) -> DataFrame:
    """``servers``: instance, restricted, maintenance_status, start_us, end_us (NULL when not set)."""
    always = F.lit(True)
    return emit(servers, prefix, {
        "Exporter_Build": (always, F.lit(int(build))),
        "stat_update_timestamp": (always, F.lit(int(at_us) // SECOND)),
        "maintenance_start_timestamp": (F.col("start_us").isNotNull(), _seconds("start_us")),
        "maintenance_end_timestamp": (F.col("end_us").isNotNull(), _seconds("end_us")),
        "maintenance_status": (always, F.col("maintenance_status")),
        "server_restricted_status": (always, F.col("restricted")),
    })


def shutdown(servers: DataFrame, at_us: int, prefix=HEALTH_PREFIX) -> DataFrame:
    """The one sample a server's last file ends with, after the common ones."""
    return emit(servers, prefix, {"stat_shutdown_timestamp": (F.lit(True), F.lit(int(at_us) // SECOND))})


def state(states: DataFrame, prefix=HEALTH_PREFIX) -> DataFrame:
    """Server state and the latencies it allows (input of ``health.server_state``)."""
    return emit(states, prefix, {
        "state": (F.lit(True), F.col("state")),
        "ping_latency_seconds": (F.col("ping_ms").isNotNull(), milli_text(F.col("ping_ms").cast("bigint"))),
        "response_time_seconds": (F.col("response_ms").isNotNull(), milli_text(F.col("response_ms").cast("bigint"))),
    })


def plain(samples: DataFrame, prefix=HEALTH_PREFIX) -> DataFrame:
    """Samples given as (instance, metric, value)."""
    return samples.select(
        "instance", prefixed(prefix, F.col("metric")).alias("name"), _no_labels().alias("labels"),
        F.col("value").cast("string").alias("value_text"),
    )


def transaction_log(styles: DataFrame, extents: DataFrame, prefix=HEALTH_PREFIX) -> DataFrame:
    """Log style always; counts in archive style; lowest and highest only when there are files."""
    rows = styles.join(extents, "instance", "left")
    archive = F.col("log_style") == ARCHIVE_STYLE
    files = F.coalesce("n_files", F.lit(0))
    return emit(rows, prefix, {
        "translog_style": (F.lit(True), F.col("log_style")),
        "translog_file_count": (archive, files),
        "translog_file_min": (archive & (files > 0), F.col("min_no")),
        "translog_file_max": (archive & (files > 0), F.col("max_no")),
    })


def disks(sizes: DataFrame, prefix=HEALTH_PREFIX) -> DataFrame:
    """Total and free bytes per component and path; unreadable disks have no sizes."""
    named = sizes.where("path <> '' AND total_bytes IS NOT NULL")
    labels = F.create_map(F.lit("component"), F.col("component"), F.lit("path"), F.col("path"))
    return emit(named, prefix, {
        "disk_total_bytes": (F.lit(True), F.col("total_bytes")),
        "disk_free_bytes": (F.lit(True), F.col("free_bytes")),
    }, labels)


def mail(buckets: DataFrame, prefix=HEALTH_PREFIX) -> DataFrame:
    """Pending mail by age; documents under five minutes are counted but not written. ``scan_ms``, if there, is the
    time the check took."""
    always = F.lit(True)
    return emit(buckets, prefix, {
        "mail_pending_avg_age_seconds": (always, F.col("avg_s")),
        "mailbox_check_errors": (always, F.col("errors")),
        "mailbox_check_timestamp": (always, _seconds("scan_us")),
        **({"mailbox_check_time": (F.col("scan_ms").isNotNull(), milli_text(F.col("scan_ms")))} if "scan_ms" in buckets.columns else {}),
        "mail_pending_age_5m_15m": (always, F.col("m5_15")),
        "mail_pending_age_15m_60m": (always, F.col("m15_60")),
        "mail_pending_age_ge_60m": (always, F.col("ge_60m")),
    })


def transactions(report: DataFrame, servers: DataFrame, at_us: int, prefix=TRANS_PREFIX) -> DataFrame:
    """Count and seconds per operation (instance, op, n, total in ms), and when each server's were taken."""
    labels = F.create_map(F.lit("op"), F.col("op"))
    always = F.lit(True)
    return emit(report, prefix, {"count": (always, F.col("n")), "total_seconds": (always, milli_text(F.col("total")))}, labels).unionByName(
        emit(servers, prefix, {"stat_transactions_update_timestamp": (always, F.lit(int(at_us) // SECOND))}))


def business(timed: DataFrame, prefix=HEALTH_PREFIX) -> DataFrame:
    return emit(timed, prefix, {
        "business_day": (F.lit(True), F.col("business_day")), "business_hours": (F.lit(True), F.col("business_hours")),
    })


def statistics(
    stats: DataFrame, own_facility: str = HEALTH_PREFIX, include=None, exclude=None,
    types=normalize.NUMERIC, prefix: str | None = STAT_PREFIX,
) -> DataFrame:
    """The collection pass over one snapshot: own facility out, prefix rules, first wins, types."""
    rows = filters.drop_facility(stats.where("facility IS NOT NULL AND stat IS NOT NULL"), own_facility)
    rows = filters.prefix_rules(
        rows, filters.DEFAULT_INCLUDES if include is None else include, filters.DEFAULT_EXCLUDES if exclude is None else exclude
    )
    columns = ["facility", "stat", "vtype", "value_milli", "value_number", "value_text", "ts_us"]
    firsts = rows.groupBy("instance", normalize.stat_key().alias("key")).agg(
        F.min(F.struct("event_id", *columns)).alias("r")
    ).select("instance", "r.*")
    out = normalize.metric_samples(firsts, prefix, types)
    return out.select(
        "instance", F.col("metric").alias("name"), _no_labels().alias("labels"),
        F.col("value").alias("value_text"),
    )
