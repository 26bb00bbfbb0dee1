"""Streaming jobs, run over all available input. Input tables arrive in several parts, so that
state is carried from batch to batch."""

from __future__ import annotations

import os

from pyspark import TaskContext
from pyspark.sql import functions as F

from fleetgauge.constants import DAY
from fleetgauge.plans import range_jobs as rj
from fleetgauge.plans import schedule_jobs as sj
from fleetgauge.plans import text_jobs as tj
from fleetgauge.plans import views as v
from fleetgauge.plans.registry import job
from fleetgauge.sources import exposition as ex
from fleetgauge.streaming import folds, ingest, stateful, tables
from fleetgauge.workdir import fresh_dir


SERIES = 8  # partitions of the state: the test tables have few series


def shuffled(rows, path: str):
    """The rows as a stream of files in no time order, so that every batch brings late ones."""
    rows.repartition(4).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


@job("st_prom_files", """
    SELECT concat('instance=', instance, '/d=', d) AS file, name, concat(name, '{op="', op, '"}') AS series_key, op,
      CAST(value_text AS DOUBLE) AS value FROM texts""", "trans_report", tj.SAMPLES)
def st_prom_files(spark, sf):
    src, out = fresh_dir(spark, "metrics"), fresh_dir(spark, "samples")
    ex.write_exposition(tj.trans_lines(spark, sf), src, tj.SCOPE)
    samples = ingest.metric_stream(spark, src, tj.FILE_PART).select("file", "name", "series_key", "op", "value")
    tables.append_available(samples, f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table")


@job("st_log_json", """
    SELECT CASE WHEN NOT corrupt THEN time_us // 60000000 * 60000000 END AS minute_us, CASE WHEN NOT corrupt THEN method END AS method,
      CASE WHEN NOT corrupt THEN status END AS status, count(*) AS n FROM logs GROUP BY ALL""", "logs")
def st_log_json(spark, sf):
    src, out = fresh_dir(spark, "log"), fresh_dir(spark, "minutes")
    v.loglines(spark, sf).select(F.col("line").alias("value")).repartition(4).write.text(src)  # in no time order
    lines = spark.readStream.option("maxFilesPerTrigger", 2).text(src).withColumnRenamed("value", "line")
    tables.run_available(lines, lambda df, i: tables.write_batch(ingest.requests_per_minute(df), f"{out}/table", i), f"{out}/checkpoint")
    return tables.added_up(spark, f"{out}/table", ["minute_us", "method", "status"], {"n": F.sum("n")})


def append(lines, folder: str) -> None:
    """Adds the lines to the files of the folder, or starts some. Each task has its own file and begins where that
    ended before, so a task that runs again leaves no line twice."""
    folder = folder.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    sizes = {name: os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder)}

    def run(rows):
        name = f"{TaskContext.get().partitionId()}.log"
        with open(f"{folder}/{name}", "r+b" if name in sizes else "wb") as out:
            out.seek(sizes.get(name, 0))
            out.truncate()
            for row in rows:
                out.write(row["line"].encode() + b"\n")

    lines.select("line").repartition(4).foreachPartition(run)


@job("st_log_positions", f"SELECT '{v.JOB}' AS job, line FROM loglines", "loglines")
def st_log_positions(spark, sf):
    src, out = fresh_dir(spark, "log"), fresh_dir(spark, "lines")
    lines = v.loglines(spark, sf)
    for late in (False, True):  # the second run resumes in the files of the first
        append(lines.where((F.col("event_id") % 2 == 1) == late), src)
        tables.append_available(ingest.line_stream(spark, src, v.JOB), f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table")


@job("st_snapshot_dedup", """
    SELECT instance, snapshot, key, min_by(value_milli, event_id) AS value, count(*) - 1 AS n_dup
    FROM (SELECT *, lower(concat_ws('.', facility, stat)) AS key FROM stats WHERE facility IS NOT NULL) GROUP BY ALL""", "stats")
def st_snapshot_dedup(spark, sf):
    src, out = fresh_dir(spark, "stats"), fresh_dir(spark, "firsts")
    rows = v.stats(spark, sf).select("event_id", "ts_us", "instance", "facility", "stat", "value_milli")
    stream = shuffled(rows, src)
    # a row without a name, two days on, closes the last snapshot
    beat = rows.agg((F.max("ts_us") + 2 * DAY).alias("ts_us")).select(*[F.col(c) if c == "ts_us" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    beat.write.mode("append").parquet(src)
    folds.follow_changes(ingest.first_of_snapshot(stream), f"{out}/table", f"{out}/checkpoint", SERIES)
    return ingest.firsts(spark, f"{out}/table")


@job("st_range_increase", "SELECT instance, op, step_us, inc, n FROM w", "counters", rj.WINDOWS)
def st_range_increase(spark, sf):
    src, out = fresh_dir(spark, "counters"), fresh_dir(spark, "increase")
    rows = v.counters(spark, sf).select("event_id", "instance", "op", "ts_us", "count_total")
    stateful.range_increase(shuffled(rows, src), out, f"{out}/checkpoint", rj.RANGE, rj.STEP, bucket_us=DAY, partitions=SERIES)
    return stateful.read_increase(spark, out, rj.RANGE, rj.STEP)


@job("st_alert_state", sj.EPISODES_SQL, "evals", sj.EPISODES)
def st_alert_state(spark, sf):
    src, out = fresh_dir(spark, "evals"), fresh_dir(spark, "episodes")
    stateful.alert_states(shuffled(v.evals(spark, sf), src), out, f"{out}/checkpoint", sj.FOR_US, bucket_us=DAY, partitions=SERIES)
    return stateful.read_episodes(spark, out)


@job("st_sample_thinning", "SELECT instance, op, ts_us, event_id FROM kept JOIN counters USING (instance, op, ts_us)", "counters", tj.THIN_SQL)
def st_sample_thinning(spark, sf):
    src, out = fresh_dir(spark, "gauges"), fresh_dir(spark, "thinned")
    rows = v.gauges(spark, sf).select("event_id", "instance", "op", "ts_us")
    stateful.sample_thinning(shuffled(rows, src), out, f"{out}/checkpoint", tj.THIN, bucket_us=DAY, partitions=SERIES)
    return stateful.read_kept(spark, out)
