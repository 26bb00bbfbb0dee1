"""Streaming forms of the ordered operators, on keyed state (see ``folds``).

Input may come late and in any order, batches may be empty; the result is that of the batch operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.constants import DAY, HOUR
from fleetgauge.operators import rangevec as rv
from fleetgauge.streaming import folds


def range_increase(stream: DataFrame, out: str, checkpoint: str, range_us: int, step_us: int, value="count_total",
                   keys=("instance", "op"), ts="ts_us", tie="event_id", bucket_us: int = HOUR, keep_us: int = 60 * DAY,
                   partitions: int | None = None) -> None:
    """Changes of the panes of ``wn_increase`` under ``out`` as samples of whole numbers come in, up to ``keep_us`` late.

    A sample changes its own pane and what leads to the next one, however many windows hold them."""
    fold = folds.pane_fold(int(range_us), int(step_us), bucket_us, value, ts, tie)
    folds.follow_changes(folds.changes(stream, fold, list(keys), bucket_us, keep_us), f"{out}/changes", checkpoint, partitions)


def read_increase(spark: SparkSession, out: str, range_us: int, step_us: int, keys=("instance", "op")) -> DataFrame:
    """Windows from the panes as they stand."""
    panes = folds.standing(spark.read.parquet(f"{out}/changes"), list(keys), ("pane_us", "n", "inc0", "edge0"))
    return rv.windows_of(panes, int(range_us), int(step_us), list(keys)).select(*keys, "step_us", "inc0", "n").withColumnRenamed("inc0", "inc")


def alert_states(stream: DataFrame, out: str, checkpoint: str, for_us: int, keys=("instance",), ts="ts_us", tie="event_id",
                 bucket_us: int = HOUR, keep_us: int = 60 * DAY,
                   partitions: int | None = None) -> None:
    """Changes of alert episodes under ``out`` as evaluations come in, in any order, up to ``keep_us`` late."""
    found = folds.changes(stream, folds.alert_fold(for_us, ts, tie), list(keys), bucket_us, keep_us)
    folds.follow_changes(found, f"{out}/changes", checkpoint, partitions)


def read_episodes(spark: SparkSession, out: str, keys=("instance",)) -> DataFrame:
    return folds.episodes(spark.read.parquet(f"{out}/changes"), list(keys))


def sample_thinning(stream: DataFrame, out: str, checkpoint: str, interval_us: int, keys=("instance", "op"),
                    ts="ts_us", tie="event_id", bucket_us: int = 6 * HOUR, keep_us: int = 60 * DAY,
                   partitions: int | None = None) -> None:
    """Changes of the kept samples under ``out`` as samples come in, in any order, up to ``keep_us`` late."""
    found = folds.changes(stream, folds.thinning_fold(interval_us, ts, tie), list(keys), bucket_us, keep_us)
    folds.follow_changes(found, f"{out}/changes", checkpoint, partitions)


def read_kept(spark: SparkSession, out: str, keys=("instance", "op"), ts="ts_us", tie="event_id") -> DataFrame:
    return folds.standing(spark.read.parquet(f"{out}/changes"), list(keys), (ts, tie))
