"""From raw typed statistics to named, described, de-duplicated metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.constants import SECOND, STAT_PREFIX
from fleetgauge.functions.text import (
    epoch_us, first_token, from_epoch_us, help_text, milli_text, prefixed, sanitized, stat_key, to_milli, whole_div,
)

NUMERIC = ("LONG", "NUMBER")
TYPES = ("TEXT", "LONG", "NUMBER", "TIMEDATE")


def typed_stats(stats: DataFrame) -> DataFrame:
    """One row per value with a column per type; the columns of the other types are NULL."""
    kind = F.col("vtype")
    return stats.select(
        "event_id", "snapshot", "instance", "facility", "stat", "vtype",
        F.when(kind == "LONG", F.col("value_milli")).alias("long_value"),
        F.when(kind == "NUMBER", F.col("value_number")).alias("number_value"),
        F.when(kind == "TEXT", F.col("value_text")).alias("text_value"),
        F.when(kind == "TIMEDATE", F.col("ts_us")).alias("time_us"),
    )


def metric_names(stats: DataFrame, prefix: str | None = STAT_PREFIX) -> DataFrame:
    """Add the lower-cased dotted ``key`` and the sanitised ``metric``."""
    name = sanitized(F.concat_ws(".", "facility", "stat"))
    return stats.withColumns({"key": stat_key(), "metric": prefixed(prefix, name)})


def descriptions(catalog: DataFrame, form="Statistic") -> DataFrame:
    """Description rows as (key, help); the first note per lower-cased name wins."""
    text = F.when(
        F.col("units") != "", F.concat(F.col("description"), F.lit(" ["), F.col("units"), F.lit("]"))
    ).otherwise(F.col("description"))
    named = (F.col("stat_name") != "") & (text != "")
    return (
        catalog.where((F.col("form") == form) & named)
        .groupBy(F.lower("stat_name").alias("key"))
        .agg(F.min_by(help_text(text), "note_id").alias("help"))
    )


def described(stats: DataFrame, helps: DataFrame, fallback="Statistic - ") -> DataFrame:
    """Add ``help``: the description of the key, else a fallback with the dotted name."""
    rows = stats.withColumn("key", stat_key())
    default = F.concat(F.lit(fallback), F.concat_ws(".", "facility", "stat"))
    return rows.join(helps, "key", "left").withColumn("help", F.coalesce("help", default))


def type_counts(stats: DataFrame) -> DataFrame:
    """Per snapshot: rows in all, per type, invalid (no facility or name) and of unknown type."""
    valid = F.col("facility").isNotNull() & F.col("stat").isNotNull()
    kind = F.col("vtype")
    counts = {f"n_{t.lower()}": valid & (kind == t) for t in TYPES}
    counts["n_time"] = counts.pop("n_timedate")
    return stats.groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("n_all"),
        *[F.count_if(c).alias(n) for n, c in counts.items()],
        F.count_if(~valid).alias("n_invalid"),
        F.count_if(valid & ~kind.isin(*TYPES)).alias("n_unknown"),
    )


def first_wins(stats: DataFrame, value="value_milli", order="event_id", scope=("snapshot", "instance")) -> DataFrame:
    """One row per lower-cased name and snapshot, the first in ``order``.

    ``n_dup`` counts the dropped rows, ``n_collide`` the other names that sanitise to the same metric.
    """
    scope = list(scope)
    rows = stats.where("facility IS NOT NULL AND stat IS NOT NULL")
    name = F.concat_ws(".", "facility", "stat")
    kept = rows.groupBy(*scope, stat_key().alias("key")).agg(
        F.min_by(value, order).alias("value"),
        F.min_by(sanitized(name), order).alias("metric"),
        (F.count(F.lit(1)) - 1).alias("n_dup"),
    )
    same = kept.groupBy(*scope, "metric").agg((F.count(F.lit(1)) - 1).alias("n_collide"))
    return kept.join(same, [*scope, "metric"]).select(*scope, "key", "value", "n_dup", "n_collide")


def metric_samples(stats: DataFrame, prefix: str | None = STAT_PREFIX, types=NUMERIC) -> DataFrame:
    """Exported samples (metric, value text) of the switched-on types."""
    kind = F.col("vtype")
    text = (
        F.when(kind == "LONG", F.col("value_milli").cast("string"))
        .when(kind == "NUMBER", milli_text(to_milli(F.col("value_number"))))
        .when(kind == "TEXT", first_token(F.col("value_text")))
        .when(kind == "TIMEDATE", iso_text("ts_us"))
    )
    named = metric_names(stats.where("facility IS NOT NULL AND stat IS NOT NULL").where(kind.isin(*types)), prefix)
    return named.withColumn("value", text).where("value IS NOT NULL")


def iso_text(us: str):
    """``2024-01-01T10:20:30:45Z``: the last pair is hundredths of a second."""
    moment = F.date_format(from_epoch_us(us), "yyyy-MM-dd'T'HH:mm:ss")
    hundredths = whole_div(F.pmod(F.col(us), F.lit(SECOND)), 10_000)
    return F.concat(moment, F.lit(":"), F.lpad(hundredths.cast("string"), 2, "0"), F.lit("Z"))


def epoch_values(rows: DataFrame, ts="ts") -> DataFrame:
    """Instants as epoch seconds and ISO text; before 1900 and the epoch itself give no sample."""
    out = rows.withColumn("_us", epoch_us(ts)).withColumns({
        "epoch_s": whole_div(F.col("_us"), SECOND), "iso_text": iso_text("_us"),
    })
    return out.where((F.year(ts) >= 1900) & (F.col("epoch_s") != 0)).drop("_us")
