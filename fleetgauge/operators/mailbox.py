"""Pending mail per scan."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.constants import MAIL_LOOKBACK_US, MAIL_MIN_WAIT_US, MINUTE, SECOND
from fleetgauge.functions.text import ceil_to, whole_div


def deliverable(mail: DataFrame) -> DataFrame:
    """Documents that could be pending: not low priority, not held back for later."""
    return mail.where("delivery_priority <> 'L' AND NOT has_send_at")


def pending(mail: DataFrame, at_us: int) -> DataFrame:
    """Documents pending at one scan: waited 5 minutes to 72 hours. ``age_buckets`` follows a series of scans."""
    wait = F.lit(int(at_us)) - F.col("added_us")
    rows = deliverable(mail).where(wait.between(MAIL_MIN_WAIT_US, MAIL_LOOKBACK_US))
    return rows.select("instance", "mailbox", "note_id", whole_div(wait, SECOND).alias("wait_s"))


def age_buckets(
    mail: DataFrame, from_us: int, to_us: int, every_us: int, min_wait_us: int = MAIL_MIN_WAIT_US, servers: DataFrame | None = None
) -> DataFrame:
    """Per server and scan: pending documents by age, their number, mean wait and unreadable documents.

    Every server (of ``servers``, else of ``mail``) has a row for every scan, zeros when its queue is
    empty. Documents are first counted per pane (panes divide the scan distance and every age limit),
    so only panes are copied to the scans, however many documents there are. The longest wait is
    inclusive, so documents exactly on a pane's right edge are counted apart.
    """
    pane = gcd(int(every_us), 5 * MINUTE, MAIL_LOOKBACK_US, int(min_wait_us) or 5 * MINUTE)
    if int(from_us) % SECOND or int(every_us) % SECOND:
        raise ValueError("scans fall on whole seconds")
    offset, base = int(from_us) % pane, int(from_us) // SECOND
    rows = deliverable(mail).withColumns({
        "pane": ceil_to(F.col("added_us") - F.lit(offset), pane) + F.lit(offset),
        "sec": whole_div(F.col("added_us") + F.lit(SECOND - 1), SECOND) - F.lit(base),
    })
    panes = rows.groupBy("instance", "pane", (F.col("added_us") == F.col("pane")).alias("edge")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sec").alias("sec")
    )
    start, every = F.lit(int(from_us)), int(every_us)
    every_scan = F.sequence(start, F.lit(int(to_us)), F.lit(every))
    # A pane (p - pane, p] waits [scan - p, scan - p + pane); only its edge reaches the full look-back.
    first = F.greatest(F.col("pane") + F.lit(int(min_wait_us)), start)
    reach = F.when(F.col("edge"), F.lit(MAIL_LOOKBACK_US)).otherwise(F.lit(MAIL_LOOKBACK_US - pane))
    last = F.least(F.col("pane") + reach, F.lit(int(to_us)))
    first = start + ceil_to(first - start, every)
    unreadable = F.col("pane").isNull()
    seen = F.when(unreadable, every_scan).when(first <= last, F.sequence(first, last, F.lit(every)))
    placed = panes.withColumn("scan_us", F.explode(seen))
    checked = (mail if servers is None else servers).select("instance").distinct().withColumn("scan_us", F.explode(every_scan))
    placed = placed.unionByName(checked, allowMissingColumns=True)
    age = F.col("scan_us") - F.col("pane")
    n, known = F.col("n"), ~unreadable

    def between(low, high=None):
        hit = known & (age >= low * MINUTE) & (F.lit(True) if high is None else age < high * MINUTE)
        return F.sum(F.when(hit, n).otherwise(0))

    total = F.sum(F.when(known, n).otherwise(0))
    wait = F.sum(F.when(known, n * (whole_div(F.col("scan_us"), SECOND) - F.lit(base)) - F.col("sec")).otherwise(0))
    return (
        placed.groupBy("instance", "scan_us")
        .agg(
            between(0, 5).alias("lt_5m"), between(5, 15).alias("m5_15"), between(15, 60).alias("m15_60"),
            between(60).alias("ge_60m"), total.alias("n"), wait.alias("_wait"),
            F.sum(F.when(unreadable, F.coalesce(n, F.lit(0))).otherwise(0)).alias("errors"),
        )
        .withColumn("avg_s", F.coalesce(F.expr("_wait div nullif(n, 0)"), F.lit(0).cast("bigint")))
        .drop("_wait")
    )
