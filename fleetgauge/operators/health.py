"""Health families: server state, storage, disks, transaction log, backup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.constants import (
    SECOND, STATE_AVAILABLE, STATE_BUSY, STATE_RESTRICTED, STATE_UNREACHABLE,
)
from fleetgauge.functions.text import matched_number, sanitized, whole_div
from fleetgauge.operators.filters import conditional_emit


def server_state(probes: DataFrame) -> DataFrame:
    """State 0..3 with the latency samples that the state allows.

    A failed ping has no measured latency; where the state still allows the sample it is 0.
    """
    ping, opened = F.col("ping_err"), F.col("open_err")
    state = (
        F.when(ping == "RESTRICTED", STATE_RESTRICTED).when(ping == "UNAVAILABLE", STATE_BUSY)
        .when(ping.isNotNull() | opened.isNotNull(), STATE_UNREACHABLE).otherwise(STATE_AVAILABLE)
    )
    latency = F.when(ping.isNull(), F.col("ping_ms")).otherwise(F.lit(0))
    return probes.withColumn("state", state).withColumns({
        "ping_ms": F.when(F.col("state") < STATE_UNREACHABLE, latency),
        "response_ms": F.when(F.col("state") < STATE_RESTRICTED, F.col("open_ms")),
    })


def storage_status(config: DataFrame) -> DataFrame:
    """Object-store samples; the catalog ones only where the store is on."""
    on, status = F.col("store_on") != 0, F.col("store_catalog_status")
    return conditional_emit(config, {
        # Metric names.
        "daos_status": (F.lit(True), F.col("store_on")),
        "daos_catalog_status": (on, status),
        "daos_catalog_not_synced": (on, F.when(status == 1, 0).otherwise(1)),
    }, ["instance"])


def mega(size: Column) -> Column:
    """Bytes as megabytes rounded to three decimals, through whole thousandths."""
    milli = whole_div(size.cast("decimal(20,0)") * 2000 + 1048576, 2 * 1048576)  # no product of a real size overflows
    return milli.cast("double") / 1000.0


def disk_sizes(disks: DataFrame) -> DataFrame:
    """Total and free megabytes per component; unnamed paths are left out."""
    return disks.where("path <> ''").select(
        "instance", "component", "path", mega(F.col("total_bytes")).alias("total_mb"), mega(F.col("free_bytes")).alias("free_mb")
    )


def extent_listing(files: DataFrame, suffix: str = ".TXN") -> DataFrame:
    """Log extents of a file listing; the suffix is case-sensitive."""
    return files.where(F.col("filename").endswith(suffix)).select("instance", "filename")


def extent_number(name: Column) -> Column:
    """Number of ``S<digits>[.suffix]``; other names give NULL."""
    return matched_number(name, r"^S([0-9]+)([.].*)?$", 1)


def extent_summary(files: DataFrame, suffix: str = ".TXN") -> DataFrame:
    """Per server: number of extents, lowest and highest extent number."""
    no = extent_number(F.col("filename"))
    return extent_listing(files, suffix).groupBy("instance").agg(
        F.count(F.lit(1)).alias("n_files"), F.min(no).alias("min_no"), F.max(no).alias("max_no")
    )


def backup_status(stats: DataFrame, facility: str) -> DataFrame:
    """Backup and start-time samples from text and time statistics.

    A text status is 0 when it reads Successful, else 1; the last extent is its number.
    """
    name = F.lower(sanitized(F.concat_ws(".", "facility", "stat")))
    own = sanitized_prefix(facility)
    is_text, is_time = F.col("vtype") == "TEXT", F.col("vtype") == "TIMEDATE"
    failed = F.when(F.lower("value_text") == "successful", 0).otherwise(1)
    seconds = whole_div(F.col("value_us"), SECOND)
    number = extent_number(F.col("value_text"))
    rows = stats.withColumn("_name", name)

    def named(suffix):
        return F.col("_name") == own + suffix

    return conditional_emit(rows, {
        # Metric names.
        "LastBackup_DB_Status": (is_text & named("_lastbackup_db_status"), failed),
        "LastBackup_TL_Status": (is_text & named("_lastbackup_tl_status"), failed),
        "LastBackup_TL_LastLogExtendNumber": (
            is_text & named("_lastbackup_tl_lastlogextend") & number.isNotNull(), number),
        "LastBackup_DB_Time": (is_time & named("_lastbackup_db_time") & (seconds != 0), seconds),
        "LastBackup_TL_Time": (is_time & named("_lastbackup_tl_time") & (seconds != 0), seconds),
        "Server_Time_Start": (is_time & (F.col("_name") == "server_time_start") & (seconds != 0), seconds),
    }, ["event_id", "instance"])


def sanitized_prefix(facility: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else "C" if c == "/" else "_" for c in facility).lower()
