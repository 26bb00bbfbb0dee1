"""Ordered folds over keyed streams whose rows come late and in any order.

A fold walks the rows of a series in time order, carries a small state from row to row and gives outputs: alert
transitions, kept samples. ``transformWithState`` holds each series cut into buckets of time: a bucket keeps its rows,
the state before and after it and its outputs. New rows change their own buckets; from the first of these on, buckets
are folded again until one begins with the state it began with before. So a batch reads and writes the buckets that it
touches (the state store logs changes only), not the history. What has changed goes out as rows with ``change`` 1
(comes) or -1 (goes again); an output holds if its changes sum up to 1. The result is that of the batch operator,
whatever the order of arrival.

Rows may come up to ``keep_us`` behind the newest row of the stream (an event-time timer closes a bucket when the
watermark has passed it by that much, and only the state after it is kept). Rows that come later still are not
dropped silently: they go out with ``change`` 0 and their values in ``late``. Rows without a time go out likewise.
Other values may be NULL and come first in ties. A batch without rows changes nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

MISSING = -(2**63)  # stands for NULL
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@dataclass(frozen=True)
class Fold:
    """``rows`` and ``outputs`` name columns of longs, the time in microseconds first; ``step(state, rows)`` takes the
    state and rows in order and gives the state after them and the outputs."""

    rows: tuple[str, ...]
    outputs: tuple[str, ...]
    start: tuple[int, ...]
    step: Callable[[tuple[int, ...], np.ndarray], tuple[tuple[int, ...], np.ndarray]]


def _longs(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, width)


def _bytes(values) -> bytes:
    return np.ascontiguousarray(values, dtype=np.int64).tobytes()


class FoldProcessor(StatefulProcessor):
    def __init__(self, fold: Fold, keys: list[str], bucket_us: int, keep_us: int) -> None:
        self.fold, self.keys, self.bucket_us, self.keep_us = fold, keys, bucket_us, keep_us

    def init(self, handle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket bigint", "before binary, after binary, rows binary, outputs binary")
        self.closed = handle.getValueState("closed", "bucket bigint, after binary")  # the last bucket that was let go

    def close(self) -> None:
        pass

    def _floor(self) -> tuple[int, bytes]:
        return self.closed.get() if self.closed.exists() else (-(2**62), _bytes(self.fold.start))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([p[list(self.fold.rows)].to_numpy(dtype=np.int64) for p in rows])
        own = (new[:, 0] - 1) // self.bucket_us  # a bucket holds its end, as panes do
        floor, after = self._floor()
        late = (own <= floor) | (new[:, 0] == MISSING)
        if late.any():
            yield self._late(key, new[late].tolist())
            new, own = new[~late], own[~late]
        if len(new):
            yield from self._fold(key, new, own, after)

    def _fold(self, key, new: np.ndarray, own: np.ndarray, after: bytes) -> Iterator[pd.DataFrame]:
        fold, width, size = self.fold, len(self.fold.rows), len(self.fold.outputs)
        touched = {int(b): new[own == b] for b in np.unique(own)}
        known = {int(k[0]) for k in self.buckets.keys()}
        order = sorted(known | touched.keys())
        first = order.index(min(touched))
        if first:
            after = self.buckets.getValue((order[first - 1],))[1]
        last = max(touched)
        for b in order[first:]:
            before, _, rows, outputs = self.buckets.getValue((b,)) if b in known else (None, None, b"", b"")
            if b not in touched and before == after:
                if b > last:
                    break
                after = self.buckets.getValue((b,))[1]
                continue
            data = _longs(rows, width)
            if b in touched:
                data = np.concatenate([data, touched[b]])
                data = data[np.lexsort(data.T[::-1])]
                if b not in known:
                    self.handle.registerTimer(((b + 1) * self.bucket_us + self.keep_us) // 1000)
            state, found = fold.step(tuple(np.frombuffer(after, np.int64).tolist()), data)
            had = list(map(tuple, _longs(outputs, size).tolist()))
            have = list(map(tuple, found.reshape(-1, size).tolist()))
            self.buckets.updateValue((b,), (after, _bytes(state), _bytes(data), _bytes(found)))
            gone, come = sorted(set(had) - set(have)), sorted(set(have) - set(had))
            if gone or come:
                yield self._changes(key, gone + come, [-1] * len(gone) + [1] * len(come))
            after = _bytes(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = (expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.keep_us) // self.bucket_us - 1
        old = sorted(b for (b,) in self.buckets.keys() if b <= upto)
        if old:
            self.closed.update((old[-1], self.buckets.getValue((old[-1],))[1]))
            for b in old:
                self.buckets.removeKey((b,))
        return iter(())

    def _changes(self, key, outputs: list[tuple], change: list[int]) -> pd.DataFrame:
        out = {k: [v] * len(outputs) for k, v in zip(self.keys, key)}
        out |= {name: [o[i] for o in outputs] for i, name in enumerate(self.fold.outputs)}
        return pd.DataFrame(out | {"change": change, "late": [None] * len(outputs)}).astype({n: "Int64" for n in self.fold.outputs})

    def _late(self, key, rows: list[list]) -> pd.DataFrame:
        out = {k: [v] * len(rows) for k, v in zip(self.keys, key)}
        out |= {name: [None] * len(rows) for name in self.fold.outputs}
        rows = [[None if v == MISSING else v for v in r] for r in rows]
        return pd.DataFrame(out | {"change": [0] * len(rows), "late": rows}).astype({n: "Int64" for n in self.fold.outputs})


def changes(stream: DataFrame, fold: Fold, keys: list[str], bucket_us: int, keep_us: int) -> DataFrame:
    """keys, outputs, change and late as the rows of ``stream`` come in."""
    ts = fold.rows[0]
    # the watermark follows the rows' time, but rows behind it must reach the state: its column goes no further
    timed = stream.withColumn("_time", F.timestamp_micros(ts)).withWatermark("_time", "0 seconds")
    rows = timed.select(*keys, *[F.coalesce(F.col(c).cast("bigint"), F.lit(MISSING)).alias(c) for c in fold.rows])
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{c}` bigint" for c in fold.outputs), "change int, late array<bigint>"])
    return rows.groupBy(*keys).transformWithStateInPandas(FoldProcessor(fold, keys, bucket_us, keep_us), schema, "Append", "EventTime")


def follow_changes(out: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Append the changes of all available input under ``path``, each once; gives the ended query.

    ``partitions`` of the state are fixed by the first run of a checkpoint (default: the session's shuffle partitions)."""
    conf = out.sparkSession.conf
    wanted = ROCKSDB | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        query = (out.writeStream.format("parquet").outputMode("append").option("path", path)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    query.awaitTermination()
    return query


class SnapshotProcessor(StatefulProcessor):
    """The first row of each name of a snapshot, and how many rows came; given when the snapshot is closed."""

    NAMES = ("key", "event_id", "value_milli", "n")

    def __init__(self, keys: list[str], close_ms: Callable[[int], int]) -> None:
        self.keys, self.close_ms = keys, close_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "rows binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([p[list(self.NAMES)] for p in rows])
        new = new[new["key"].notna()]
        if new.empty or key[-1] is None:
            return
        closes = self.close_ms(int(key[-1]))
        if timerValues.getCurrentWatermarkInMs() >= closes:
            yield self._rows(key, new, True)
            return
        if self.first.exists():
            new = pd.concat([pickle.loads(self.first.get()[0]), new])
        else:
            self.handle.registerTimer(closes)
        new = new.sort_values(["key", "event_id", "value_milli"])
        firsts = new.drop_duplicates("key").assign(n=new.groupby("key", sort=True)["n"].sum().to_numpy())
        self.first.update((pickle.dumps(firsts.reset_index(drop=True)),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.first.exists():
            yield self._rows(key, pickle.loads(self.first.get()[0]), False)
            self.first.clear()

    def _rows(self, key, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        own = {k: [v] * len(rows) for k, v in zip(self.keys, key)}
        return pd.DataFrame(own | {c: rows[c].to_numpy() for c in self.NAMES} | {"late": [late] * len(rows)})


def standing(rows: DataFrame, keys: list[str], outputs: tuple[str, ...]) -> DataFrame:
    """The outputs that hold after all changes."""
    held = rows.where("change <> 0").groupBy(*keys, *outputs).agg(F.sum("change").alias("_n")).where("_n > 0")
    return held.select(*keys, *[F.nullif(c, F.lit(MISSING)).alias(c) for c in outputs])


def late_rows(rows: DataFrame, keys: list[str], names: tuple[str, ...]) -> DataFrame:
    """The rows that came too late, or without a time, with the fold's columns ``names``."""
    return rows.where("change = 0").select(*keys, *[F.col("late")[i].alias(c) for i, c in enumerate(names)])


# --- the folds ---------------------------------------------------------------------------

BEGINS, FIRES, RESOLVES = 0, 1, 2


def alert_fold(for_us: int, ts: str = "ts_us", tie: str = "event_id") -> Fold:
    """Transitions of episodes: active_at and active_tie name the episode, kind and at the transition.

    State: whether the row before was true, whether the episode is unresolved, its begin, whether it fired."""

    def step(state, rows):
        was, open_, begin, begin_tie, fired = state
        t, flag = rows[:, 0], rows[:, 2]
        true = flag == 1
        starts = true & ~np.concatenate([[bool(was)], true[:-1]])
        episode = np.cumsum(starts)
        at = np.concatenate([[begin], t[starts]])
        tie_at = np.concatenate([[begin_tie], rows[starts, 1]])
        held = true & (t >= at[episode] + for_us)
        done = flag == 0
        out = [np.stack([t[starts], rows[starts, 1], np.full(starts.sum(), BEGINS), t[starts]], axis=1)]
        firsts = {}
        for kind, mask, free in ((FIRES, held, not fired), (RESOLVES, done, bool(open_))):
            of, first = np.unique(episode[mask], return_index=True)
            place = np.flatnonzero(mask)[first]
            if len(of) and of[0] == 0 and not free:
                of, place = of[1:], place[1:]
            firsts[kind] = set(of.tolist())
            out.append(np.stack([at[of], tie_at[of], np.full(len(of), kind), t[place]], axis=1))
        e = int(episode[-1])
        new = e > 0
        fired = int(e in firsts[FIRES] or (not new and fired))
        open_ = int((new or open_) and e not in firsts[RESOLVES])
        return (int(true[-1]), open_, int(at[e]), int(tie_at[e]), fired), np.concatenate(out)

    return Fold((ts, tie, "active"), ("active_at", "active_tie", "kind", "at"), (0, 0, 0, 0, 0), step)


def episodes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Episodes from their transitions: keys, active_at, fires_at, resolved_at."""
    one = standing(rows, keys, ("active_at", "active_tie", "kind", "at"))
    return one.groupBy(*keys, "active_at", "active_tie").agg(
        F.min(F.when(F.col("kind") == FIRES, F.col("at"))).alias("fires_at"),
        F.min(F.when(F.col("kind") == RESOLVES, F.col("at"))).alias("resolved_at")).drop("active_tie")


def thinning_fold(interval_us: int, ts: str = "ts_us", tie: str = "event_id") -> Fold:
    """The samples that are kept. State: when the next one is due (first: at once)."""

    def step(state, rows):
        due, t, kept, i = state[0], rows[:, 0], [], 0
        while True:
            i += int(np.searchsorted(t[i:], due))
            if i >= len(t):
                break
            kept.append(i)
            due = int(t[i]) + interval_us
        return (due,), rows[kept]

    return Fold((ts, tie), (ts, tie), (MISSING,), step)


def pane_fold(range_us: int, step_us: int, bucket_us: int, value: str, ts: str = "ts_us", tie: str = "event_id") -> Fold:
    """Panes of a counter: samples, increase within the pane, and from the last sample before it.

    Panes are cut where windows and buckets begin and end. State: the value of the row before (MISSING: none)."""

    def step(state, rows):
        t, v = rows[:, 0], rows[:, 2]
        before = np.concatenate([[state[0]], v[:-1]])
        known = (v != MISSING) & (before != MISSING)
        delta = np.where(v < before, v, v - np.where(known, before, 0)) * known
        cuts = [t + -t % step_us, t + -t % bucket_us, t + range_us + -(t + range_us) % step_us - range_us]
        end = np.minimum.reduce(cuts)
        first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        edge = delta[first]
        return (int(v[-1]),), np.stack([end[first], np.diff(first, append=len(t)), np.add.reduceat(delta, first) - edge, edge], axis=1)

    return Fold((ts, tie, value), ("pane_us", "n", "inc0", "edge0"), (MISSING,), step)
