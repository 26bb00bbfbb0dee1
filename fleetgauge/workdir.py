"""Shared scratch space for jobs that write: checkpoints, state tables, snapshots.

The cluster names a shared folder in ``spark.checkpoint.dir``; only when that is
unset (local runs, tests) is a folder made here.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, with Spark's checkpoint dir pointed at it."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        made = tempfile.mkdtemp(prefix="fleetgauge-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)  # the driver's own folder goes with it
        sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: what uses them more than once doesn't work them out again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder under the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
