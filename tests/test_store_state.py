"""Latest state, batch by batch."""

import random
import uuid

from fleetgauge.operators import store

KIND = "package string, name string, value long, ts_us long, event_id long"


def test_batches_meet_their_state_without_a_shuffle(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["p", "q", None]), rng.choice(["a", "b", "c", None]), rng.choice([1, 2, None]), rng.randrange(50), i) for i in range(200)]
    deletes = spark.createDataFrame([("p", 30, 10_000), ("p", 5, 10_001)], "package string, ts_us long, event_id long")
    name, state = f"s{uuid.uuid4().hex}", None
    for i, part in enumerate((rows[:90], [], rows[90:100], rows[100:])):
        updates = spark.createDataFrame(part, KIND)
        table, path = f"{name}_{i}", str(tmp_path / str(i))
        state = store.start_state(updates, table, path, 4) if state is None else store.upsert(state, updates, table, path, 4)
    want = store.latest_state(spark.createDataFrame(rows, KIND), deletes)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, store.current(state, deletes).collect())) == sorted(map(key, want.collect()))
    both = store.merged(spark.table(f"{name}_2"), spark.table(f"{name}_3_batch"))
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Exchange" not in plan, plan
