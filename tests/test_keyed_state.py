"""Streams on keyed state: late rows, bounded state, and writes that follow the batch."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.constants import DAY, HOUR, MINUTE
from fleetgauge.operators import alerts, rangevec, thinning
from fleetgauge.streaming import folds, ingest, stateful

KIND = "instance string, event_id bigint, ts_us bigint, active boolean, count_total bigint"


def stream_of(spark, path, files):
    """The rows of each file as a batch of their own."""
    os.makedirs(path, exist_ok=True)
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("bucket", [7, 60, 100_000])
def test_folds_like_the_batch_operators(spark, bucket):
    """Any cut into buckets and any order of arrival give what one walk over all rows gives."""
    rng = random.Random(bucket)
    rows = [(rng.randrange(-200, 400), i, rng.choice([0, 0, 1, 1, folds.MISSING])) for i in range(150)] + [(5, 500 + i, i % 2) for i in range(6)]
    for fold in (folds.alert_fold(9), folds.thinning_fold(13), folds.pane_fold(50, 20, bucket, "v")):
        width = len(fold.rows)
        data = np.array(sorted(r[:width] for r in rows), dtype=np.int64)
        state, cut = fold.start, []
        for b in np.unique((data[:, 0] - 1) // bucket):
            state, out = fold.step(state, data[(data[:, 0] - 1) // bucket == b])
            cut += map(tuple, out.tolist())
        _, whole = fold.step(fold.start, data)
        assert sorted(cut) == sorted(map(tuple, whole.tolist()))


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(["hot", "hot", "b", None])
        rows.append((name, i, rng.randrange(3 * DAY // MINUTE) * MINUTE, rng.choice([True, True, False, None]), rng.randrange(50)))
    return rows


def test_any_order_gives_the_batch_result(spark, tmp_path):
    rows = random_rows(400, 3)
    whole, files = spark.createDataFrame(rows, KIND), [rows[:150], [], rows[150:390], rows[390:]]
    src, keys = str(tmp_path / "in"), ("instance",)
    stream = stream_of(spark, src, files)
    a, b, c = (str(tmp_path / n) for n in "abc")
    stateful.alert_states(stream, a, f"{a}/c", 8 * MINUTE)
    assert rows_of(stateful.read_episodes(spark, a)) == rows_of(alerts.alert_episodes(whole, 8 * MINUTE))
    stateful.sample_thinning(stream, b, f"{b}/c", 30 * MINUTE, keys)
    assert rows_of(stateful.read_kept(spark, b, keys)) == rows_of(thinning.due_thinning(whole, 30 * MINUTE, list(keys)))
    stateful.range_increase(stream, c, f"{c}/c", 50 * MINUTE, 20 * MINUTE, keys=keys)
    assert rows_of(stateful.read_increase(spark, c, 50 * MINUTE, 20 * MINUTE, keys)) == rows_of(rangevec.increase(whole, 50 * MINUTE, 20 * MINUTE, keys=list(keys)))


def test_rows_that_come_too_late_go_aside(spark, tmp_path):
    """What is let go is as it stood, later rows follow from it, and late ones and those without a time are told."""
    first = [("a", i, i * HOUR, i % 3 != 2, i) for i in range(200)]
    late = [("a", 900, 5 * HOUR, True, 1), ("new", 901, HOUR, True, 1), ("a", 902, None, True, 1)]
    last = [("a", 903, 201 * HOUR, True, 7)]
    out = str(tmp_path / "out")
    # the empty file lets the timers of the batch before run
    stateful.alert_states(stream_of(spark, f"{out}-in", [first, [], late + last]), out, f"{out}/c", 2 * HOUR, keep_us=24 * HOUR)
    want = alerts.alert_episodes(spark.createDataFrame([*first, *last, late[1]], KIND), 2 * HOUR)
    assert rows_of(stateful.read_episodes(spark, out)) == rows_of(want)
    aside = folds.late_rows(spark.read.parquet(f"{out}/changes"), ["instance"], ("ts_us", "event_id", "active"))
    assert sorted(map(tuple, aside.collect()), key=str) == [("a", 5 * HOUR, 900, 1), ("a", None, 902, 1)]


def written(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if not f.endswith(".crc")}


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """The same small batch after a short and after a tenfold history."""
    wrote = []
    for size in (300, 3000):
        out = str(tmp_path / f"s{size}")
        history = [(f"s{i % 3}", i, i * 20 * MINUTE, i % 5 != 0, i) for i in range(size)]
        stateful.sample_thinning(stream_of(spark, f"{out}-in", [history]), out, f"{out}/c", HOUR, ("instance",))
        before = written(f"{out}/c/state") | written(f"{out}/changes")
        end = size * 20 * MINUTE
        stateful.sample_thinning(stream_of(spark, f"{out}-in", [[(f"s{i}", size + i, end + i, True, 0) for i in range(3)]]), out, f"{out}/c", HOUR, ("instance",))
        after = written(f"{out}/c/state") | written(f"{out}/changes")
        wrote.append(sum(n for f, n in after.items() if f not in before and "_spark_metadata" not in f))
    assert wrote[1] <= 1.3 * wrote[0], wrote


def stats_rows(snapshots, per):
    rows, rng = [], random.Random(1)
    for s in snapshots:
        for i in range(per):
            name = rng.choice(["a", "b", "C", None])
            rows.append((s * 1000 + i, s * DAY + i * HOUR, rng.choice(["x", "y"]), "Disk" if name else None, name or "n", rng.randrange(9)))
    return rows


STATS = "event_id bigint, ts_us bigint, instance string, facility string, stat string, value_milli bigint"


def test_snapshot_state_stops_growing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = stats_rows(range(100), 20)
    for i in range(0, 100, 10):
        spark.createDataFrame([r for r in rows if i <= r[1] // DAY < i + 10], STATS).coalesce(1).write.mode("append").parquet(src)
    late = [(7, 3 * DAY, "x", "Disk", "a", 77), (99_999, 4 * DAY, "y", "Disk", "zz", 1)]
    spark.createDataFrame(late, STATS).coalesce(1).write.mode("append").parquet(src)
    beat = [(None, 103 * DAY, None, None, None, None)]
    spark.createDataFrame(beat, STATS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(STATS).option("maxFilesPerTrigger", 1).parquet(src)
    query = folds.follow_changes(ingest.first_of_snapshot(stream), f"{out}/table", f"{out}/c")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 10 and max(held[1:]) <= 4 * max(1, held[0]), held
    assert spark.read.parquet(f"{out}/table").where("late").count() == 2
    named = spark.createDataFrame([*rows, *late], STATS).where("facility IS NOT NULL")
    key = F.lower(F.concat_ws(".", "facility", "stat"))
    want = named.groupBy("instance", F.expr(f"ts_us div {DAY}").alias("snapshot"), key.alias("key")).agg(
        F.min_by("value_milli", "event_id").alias("value"), (F.count(F.lit(1)) - 1).alias("n_dup"))
    assert rows_of(ingest.firsts(spark, f"{out}/table")) == rows_of(want)
