"""Ordered operators against plain Python, with one series holding most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetgauge.constants import HOUR, MINUTE, SECOND
from fleetgauge.functions.scan import lag, last_seen, max_before, ordered_scan, positioned, running_max, running_sum
from fleetgauge.operators import alerts, rangevec, schedule, thinning
from fleetgauge.streaming import stateful


def series(seed, n=900, span=40 * HOUR):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice(["b", "c", "d"])
        rows.append((key, "x", i, rng.randrange(0, span, SECOND * 20), rng.randrange(0, 50)))
    return rows


COLS = "instance string, op string, event_id bigint, ts_us bigint, count_total bigint"


def grouped(rows):
    out = defaultdict(list)
    for k, o, i, t, v in rows:
        out[(k, o)].append((t, i, v))
    return {k: sorted(v) for k, v in out.items()}


def test_ordered_scan_equals_plain_window(spark):
    rows = [(k, o, i, t, None if v < 10 else v) for k, o, i, t, v in series(1)]
    df = spark.createDataFrame(rows, COLS)
    w = Window.partitionBy("instance").orderBy("ts_us", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("count_total")
    plain = df.select(
        "event_id", F.lag(v).over(w).alias("p"), F.coalesce(F.sum(v).over(upto), F.lit(0)).alias("s"),
        F.last(v, True).over(upto).alias("l"), F.max(v).over(upto).alias("m"),
        F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"))
    scan = ordered_scan(df, ["instance"], ["ts_us", "event_id"], [
        lag("count_total", "p"), running_sum(v, "s"), last_seen("count_total", "l"), running_max(v, "m"), max_before("count_total", "b")])
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, plain.collect())) == sorted(map(key, scan.select(plain.columns).collect()))


@pytest.mark.parametrize("range_us, step_us", [(6 * HOUR, HOUR), (5 * HOUR, 2 * HOUR), (HOUR, 3 * HOUR)])
def test_range_functions(spark, range_us, step_us):
    rows = series(2)
    df = spark.createDataFrame(rows, COLS)
    inc, last = {}, {}
    for (k, o), pts in grouped(rows).items():
        for step in range(0, 60 * HOUR, step_us):
            win = [p for p in pts if step - range_us < p[0] <= step]
            if len(win) < 2:
                continue
            deltas = [b[2] if b[2] < a[2] else b[2] - a[2] for a, b in zip(win, win[1:])]
            inc[(k, o, step)] = (sum(deltas), len(win))
            if win[-1][0] > win[-2][0]:
                last[(k, o, step)] = deltas[-1] * SECOND / (win[-1][0] - win[-2][0])
    got = {(r["instance"], r["op"], r["step_us"]): (r["inc"], r["n"]) for r in rangevec.increase(df, range_us, step_us).collect()}
    assert got == inc and all(v[0] >= 0 for v in got.values())
    got = {(r["instance"], r["op"], r["step_us"]): r["irate"] for r in rangevec.irate(df, range_us, step_us).collect()}
    assert got == pytest.approx(last)


def test_instant_and_nodata_fill_the_grid(spark):
    rows = series(3, n=150)
    df = spark.createDataFrame(rows, COLS)
    step, back, end = 15 * MINUTE, 40 * MINUTE, 48 * HOUR
    want = {}
    for (k, o), pts in grouped(rows).items():
        for t in range(0, end + 1, step):
            win = [p for p in pts if t - back < p[0] <= t]
            want[(k, o, t)] = win[-1][2] if win else None
    got = {(r["instance"], r["op"], r["step_us"]): r["value"] for r in rangevec.instant(df, step, back, "count_total").collect()}
    assert {k: v for k, v in got.items() if k[2] <= end} == {k: v for k, v in want.items() if v is not None}
    empty = {(r["instance"], r["op"], r["step_us"]) for r in rangevec.no_data(df, 0, end, step, back).collect()}
    assert empty == {k for k, v in want.items() if v is None}


@pytest.mark.parametrize("interval, chunks", [(HOUR, 4), (7 * MINUTE, 3), (3 * HOUR, 2)])
def test_thinning(spark, interval, chunks):
    rows = series(4)
    want = set()
    for (k, o), pts in grouped(rows).items():
        due = -1
        for t, i, _ in pts:
            if t >= due:
                want.add((k, o, t, i))
                due = t + interval
    df = spark.createDataFrame(rows, COLS)
    got = {tuple(r) for r in thinning.due_thinning(df, interval, chunk_intervals=chunks).select("instance", "op", "ts_us", "event_id").collect()}
    assert got == want


def episodes(points, for_us, keep_us):
    """The rule one evaluation at a time."""
    out, active, fired, false_since = [], None, None, None
    for t, on in points:
        if on:
            if active is None:
                active, fired = t, None
            false_since = None
            if fired is None and t >= active + for_us:
                fired = t
        elif active is not None:
            if fired is not None and keep_us:
                false_since = t if false_since is None else false_since
                if t < false_since + keep_us:
                    continue
            out.append((active, fired, t))
            active, fired, false_since = None, None, None
    return out + ([(active, fired, None)] if active is not None else [])


@pytest.mark.parametrize("for_us, keep_us", [(0, 0), (20 * MINUTE, 0), (10 * MINUTE, 30 * MINUTE), (0, 10 * MINUTE)])
def test_alert_episodes(spark, for_us, keep_us):
    rng = random.Random(5)
    rows, state = [], True
    for i in range(600):
        state = state if rng.random() < 0.7 else not state
        rows.append(("hot" if i % 5 else "b", i, i * 4 * MINUTE, state))
    df = spark.createDataFrame(rows, "instance string, event_id bigint, ts_us bigint, active boolean")
    got = {tuple(r) for r in alerts.alert_episodes(df, for_us, keep_us).collect()}
    want = {(k, *e) for k in ("hot", "b") for e in episodes([(t, a) for x, _, t, a in rows if x == k], for_us, keep_us)}
    assert got == want


def test_maintenance_windows(spark):
    rng = random.Random(6)
    win = []
    for i in range(300):
        s = rng.randrange(0, 200 * HOUR, SECOND)
        win.append((i, rng.choice(["hot", "hot", "b"]), s, s + rng.choice([0, MINUTE, 3 * HOUR, 50 * HOUR]) if rng.random() < 0.5 else s + MINUTE))
    rows = [(rng.choice(["hot", "b", "c"]), i, rng.randrange(0, 220 * HOUR, SECOND)) for i in range(500)]
    rows += [(w[1], 1000 + i, w[3]) for i, w in enumerate(win)]
    df = spark.createDataFrame(rows, "instance string, event_id bigint, ts_us bigint")
    maint = spark.createDataFrame(win, "window_id bigint, instance string, start_us bigint, end_us bigint")
    got = {(r["event_id"]): r["maintenance_status"] for r in schedule.maintenance_status(df, maint).collect()}
    want = {i: 3 if any(w[1] == k and w[2] <= t <= w[3] for w in win) else 0 for k, i, t in rows}
    assert got == want


def test_positions(spark):
    rows = [(f"v{i:05d}",) for i in random.Random(7).sample(range(100000), 3000)]
    got = [(r["value"], r["pos"]) for r in positioned(spark.createDataFrame(rows, "value string"), ["value"]).collect()]
    assert sorted(got) == [(v[0], i + 1) for i, v in enumerate(sorted(rows))]


def test_intervals_minus(spark):
    from fleetgauge.operators.intervals import minus

    rng = random.Random(8)

    def some(n, longest):
        return [(i, rng.choice(["hot", "hot", "b"]), s, s + rng.randrange(0, longest)) for i, s in ((i, rng.randrange(0, 2000)) for i in range(n))]

    rows, taken = some(80, 300), some(60, 40)
    left = minus(spark.createDataFrame(rows, "i int, k string, s bigint, e bigint"), spark.createDataFrame(taken, "i int, k string, s bigint, e bigint"), ["k"])
    got = {}
    for r in left.collect():
        got.setdefault(r["i"], []).append((r["s"], r["e"]))
    for i, k, s, e in rows:
        free = [t for t in range(s, e) if not any(x == k and a <= t < b for _, x, a, b in taken)]
        parts = [(t, t + 1) for t in free]
        joined = []
        for a, b in parts:
            if joined and joined[-1][1] == a:
                joined[-1] = (joined[-1][0], b)
            else:
                joined.append((a, b))
        assert sorted(got.get(i, [])) == joined


def in_files(spark, rows, schema, path, parts):
    """The rows in files that a stream takes one by one, the second of them empty."""
    for i in range(parts):
        mine = [] if i == 1 else rows[i::parts] if i else rows[0::parts] + rows[1::parts]
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_take_late_and_empty_input(spark, tmp_path):
    rng = random.Random(11)
    state, evals = False, []
    for i in range(120):
        state = state if rng.random() < 0.6 else not state
        evals.append((rng.choice(["hot", "b", None]), i, i * 4 * MINUTE, state, i))
    rng.shuffle(evals)
    kind = "instance string, event_id bigint, ts_us bigint, active boolean, count_total bigint"
    whole = spark.createDataFrame(evals, kind)
    names = {"keys": ["instance"]}

    def same(got, want):
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.collect()))

    out = str(tmp_path / "alerts")
    stateful.alert_states(in_files(spark, evals, kind, f"{out}-in", 4), out, f"{out}/checkpoint", 8 * MINUTE)
    same(stateful.read_episodes(spark, out), alerts.alert_episodes(whole, 8 * MINUTE))
    out = str(tmp_path / "thin")
    stateful.sample_thinning(in_files(spark, evals, kind, f"{out}-in", 4), out, f"{out}/checkpoint", 30 * MINUTE, **names)
    same(stateful.read_kept(spark, out, ["instance"]), thinning.due_thinning(whole, 30 * MINUTE, ["instance"]))
    out = str(tmp_path / "inc")
    stateful.range_increase(in_files(spark, evals, kind, f"{out}-in", 4), out, f"{out}/checkpoint", HOUR, 20 * MINUTE, **names)
    same(stateful.read_increase(spark, out, HOUR, 20 * MINUTE, ["instance"]), rangevec.increase(whole, HOUR, 20 * MINUTE, keys=["instance"]))


def test_thinning_folds_little_of_an_even_series(spark, monkeypatch):
    """Samples one second apart: chains never merge, yet no fold reads a part of them that grows."""
    monkeypatch.setattr(thinning, "FAN", 8)
    monkeypatch.setattr(thinning, "LEVELS", 2)
    read = spark.sparkContext.accumulator(0)
    rows = spark.range(19_200).select(F.lit("a").alias("k0"), (F.col("id") * SECOND).alias("ts"), F.col("id").alias("event_id"))
    plain = thinning._dues

    def counted(keys, seeded=False):
        fold = plain(keys, seeded)

        def run(parts):
            def told():
                for part in parts:
                    read.add(len(part))
                    yield part

            return fold(told())

        return fold if seeded else run

    monkeypatch.setattr(thinning, "_dues", counted)
    kept = [r["ts"] for r in thinning.due_thinning(rows, MINUTE, ["k0"], "ts").collect()]
    assert sorted(kept) == [i * MINUTE for i in range(320)] and read.value <= 2 * 61


def test_task_functions_travel_without_the_package(tmp_path):
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    made = [thinning._answers(["k0"], 5, 50), thinning._dues(["k0"]), thinning._composed(["k0"], 5, 400), thinning._kept(["k0"], 5)]
    (tmp_path / "f").write_bytes(cloudpickle.dumps(made))
    load = "import pickle, sys; pickle.load(open('f', 'rb')); assert 'fleetgauge' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", load], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_windows_take_two_rows_a_step(spark, monkeypatch):
    """Thirty days by a minute: 43,200 steps a sample, yet each step has two rows, and the sums are right."""
    rng = random.Random(4)
    times = sorted(rng.sample(range(0, 3 * 1440 * 60), 25))
    rows = [("a", "x", i, t * SECOND, rng.randrange(100)) for i, t in enumerate(times)]
    placed, plain = [], rangevec._steps

    def kept(*args):
        placed.append(plain(*args))
        return placed[-1]

    monkeypatch.setattr(rangevec, "_steps", kept)
    span, step = 30 * 1440 * MINUTE, MINUTE
    df = spark.createDataFrame(rows, "instance string, op string, event_id long, ts_us long, count_total long")
    got = {r["step_us"]: (r["inc"], r["n"]) for r in rangevec.increase(df, span, step).collect()}
    steps = placed[0].select("step_us").distinct().count()
    assert placed[0].count() == 2 * steps
    deltas = [0] + [b[4] if b[4] < a[4] else b[4] - a[4] for a, b in zip(rows, rows[1:])]
    want = {}
    for t in range(-(-rows[0][3] // step) * step, rows[-1][3] + span, step):
        inside = [i for i, r in enumerate(rows) if t - span < r[3] <= t]
        if len(inside) > 1:
            want[t] = (sum(deltas[i] for i in inside[1:]), len(inside))
    assert got == want
    value = {r["step_us"]: r["value"] for r in rangevec.instant(df, step, span, value="count_total").collect()}
    assert all(value[t] == next(r[4] for r in reversed(rows) if r[3] <= t) for t in want)
