"""Labels: series keys, target labels, label values, set operations on samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.scan import positioned
from fleetgauge.constants import SECOND
from fleetgauge.functions.text import static_series_key, whole_div


def labelled(rows: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """Add ``name``, the ``labels`` map of the given columns and the ``series_key``."""
    pairs = F.create_map(*[x for c in labels for x in (F.lit(c), F.col(c))])
    out = rows.withColumns({"name": F.lit(name), "labels": F.map_filter(pairs, lambda _, v: v.isNotNull())})
    return out.withColumn("series_key", static_series_key(F.col("name"), {c: F.col(c) for c in labels}))


def target_labels(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Attach pod and namespace of the scrape target, empty for a target that is not listed; Spark broadcasts the
    targets when small enough."""
    known = targets.select("job", "instance", "pod", "namespace")
    return samples.join(known, ["job", "instance"], "left").fillna("", ["pod", "namespace"])


def label_values(samples: DataFrame, label: str) -> DataFrame:
    """Distinct values of a label, ascending."""
    value = F.col("labels")[label].alias("value")
    return samples.select(value).where("value IS NOT NULL").distinct().orderBy("value")


def numbered_label_values(samples: DataFrame, label: str) -> DataFrame:
    """Distinct values with their position in ascending order."""
    value = F.col("labels")[label].alias("value")
    return positioned(samples.select(value).where("value IS NOT NULL").distinct(), ["value"])


def instances_of_jobs(info: DataFrame, jobs: DataFrame) -> DataFrame:
    """Servers of the chosen jobs: the second of two chained variables."""
    return info.join(jobs, "job", "left_semi").select("instance").distinct()


def union_families(*families: DataFrame) -> DataFrame:
    """All families of one snapshot under one schema; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)


def union_distinct(*lines: DataFrame) -> DataFrame:
    """Each rendered line once."""
    return reduce(lambda a, b: a.unionByName(b), lines).distinct()


def staleness(updates: DataFrame, at_us: int) -> DataFrame:
    """Seconds since a server's last update sample; a shutdown marker as its last sample ends it."""
    rows = updates.groupBy("instance").agg(
        F.max("ts_us").alias("last_us"), F.max(F.when(F.col("shutdown"), F.col("ts_us"))).alias("_down")
    )
    return rows.select(
        "instance", "last_us", whole_div(F.lit(int(at_us)) - F.col("last_us"), SECOND).alias("age_s"),
        F.coalesce(F.col("_down") >= F.col("last_us"), F.lit(False)).alias("ended"),
    )
