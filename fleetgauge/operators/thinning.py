"""Keep a sample only when the interval has passed since the last kept one.

The rule is sequential, but a series need not sit in one task. Each series is cut into chunks
longer than the interval. The only thing a chunk learns from its past is the time the next sample
is due, which lies before the end of the chunk's first interval; so every chunk first tells, for
each such due time, what the due time after it would be (runs with the same answer collapse to one
row). A tree over these few rows gives each chunk its true due time, and the chunks are then
thinned in parallel. All steps read sorted partitions as a stream.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.runs import runs
from fleetgauge.functions.text import whole_div

FIRST = -(2**63)  # due before every sample
SEED = -(2**63)
FAN, LEVELS = 256, 1


def _answers(keys: list[str], interval: int, width: int):
    """Per chunk: the due time after it, for each range of due times before it."""

    def answer(t: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        t = np.unique(t)
        # The last sample kept in this chunk when starting from each sample: follow the chain by doubling.
        follow = np.searchsorted(t, t + interval)
        last = np.where(follow < len(t), follow, np.arange(len(t)))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        # Due times reach at most one interval into the chunk; one sample past that answers the rest.
        heads = min(len(t), int(np.searchsorted(t, chunk * width + interval)) + 1)
        upto, after = t[:heads], (t[last] + interval)[:heads]
        ends = np.append(after[1:] != after[:-1], True)
        return upto[ends], after[ends]

    def frame(done: list) -> pd.DataFrame:
        sizes = [len(upto) for _, upto, _ in done]
        out = {c: np.repeat(np.array([k[i] for k, _, _ in done], dtype=object), sizes) for i, c in enumerate(keys)}
        out["chunk"] = np.repeat(np.array([k[-1] for k, _, _ in done], dtype="int64"), sizes)
        out["upto"] = np.concatenate([u for _, u, _ in done])
        out["after"] = np.concatenate([a for _, _, a in done])
        return pd.DataFrame(out)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, times, done = None, [], []
        for part in parts:
            ts = part["ts"].to_numpy()
            for key, lo, hi in runs(part, [*keys, "chunk"]):
                if key != held:
                    if held is not None:
                        done.append((held, *answer(np.concatenate(times), int(held[-1]))))
                    held, times = key, []
                times.append(ts[lo:hi])
            if done:
                yield frame(done)
                done = []
        if held is not None:
            yield frame([(held, *answer(np.concatenate(times), int(held[-1])))])

    return run


def _composed(keys: list[str], interval: int, width: int):
    """The answers of consecutive chunks as those of one ``width`` wide: what is due after all of them, for
    each due time before. Due times reach at most one interval into it, so only the answers up to there stay."""

    def then(upto: np.ndarray, after: np.ndarray, due: np.ndarray) -> np.ndarray:
        at = np.searchsorted(upto, due)  # a due time past the last answer passes by
        return np.where(at < len(upto), after[np.minimum(at, len(upto) - 1)], due)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, chunk, whole, own, out = None, None, None, [], []

        def add(whole, own, up):
            upto, after = (np.concatenate(x) for x in zip(*own))
            heads = int(np.searchsorted(upto, up * width + interval)) + 1
            if whole is None:
                return upto[:heads], after[:heads]
            more = (upto > whole[0][-1]) & (whole[0][-1] < up * width + interval)
            more[heads:] = False
            ends = np.concatenate([whole[0], upto[more]])
            next_ = np.concatenate([then(upto, after, whole[1]), after[more]])
            last = np.append(next_[1:] != next_[:-1], True)
            return ends[last], next_[last]

        def frame(done):
            rows = [(*k, u, a) for k, (us, as_) in done for u, a in zip(us.tolist(), as_.tolist())]
            return pd.DataFrame(rows, columns=[*keys, "chunk", "upto", "after"])

        for part in parts:
            upto, after = part["upto"].to_numpy(), part["after"].to_numpy()
            for key, lo, hi in runs(part, [*keys, "up", "chunk"]):
                if key != chunk:
                    if own:
                        whole = add(whole, own, int(chunk[-2]))
                    if key[:-1] != held:
                        if held is not None:
                            out.append((held, whole))
                        held, whole = key[:-1], None
                    chunk, own = key, []
                own.append((upto[lo:hi], after[lo:hi]))
            if out:
                yield frame(out)
                out = []
        if own:
            yield frame([(held, add(whole, own, int(chunk[-2])))])

    return run


def _dues(keys: list[str], seeded: bool = False):
    """Fold the answers of each series in time order: the due time before and after each chunk.

    ``seeded``: a first row of each group (chunk SEED) brings the due time; a group without one keeps nothing."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, chunk, due, after, open_ = None, None, FIRST, FIRST, False
        for part in parts:
            upto, then, out = part["upto"].tolist(), part["after"].tolist(), []
            for key, lo, hi in runs(part, [*keys, "chunk"]):
                if key[:-1] != series:
                    series, chunk, after, open_ = key[:-1], None, None if seeded else FIRST, False
                if seeded and key[-1] == SEED:
                    after = then[lo]
                    continue
                if key[-1] != chunk:
                    chunk, due, open_ = key[-1], after, after is not None
                if open_:
                    at = bisect_left(upto, due, lo, hi)  # the first answer that covers the due time
                    if at < hi:
                        after, open_ = then[at], False
                        out.append((*key, due, after))
            yield pd.DataFrame(out, columns=[*keys, "chunk", "due", "next_due"])

    return run


def _settled(answers: DataFrame, k: list[str], kinds: str, interval: int, width: int) -> DataFrame:
    """The due time before and after each chunk that keeps a sample (k, chunk, due, next_due).

    A tree over the chunks of a series: answers of FAN chunks become those of one, LEVELS times, the few that
    are left are folded in order, and the due times go down the same way. No task reads more than FAN chunks'
    answers of a group, up to FAN ** (LEVELS + 1) chunks of a series.
    """
    up = whole_div(F.col("chunk"), FAN)
    maps = [answers]
    for level in range(1, LEVELS + 1):
        grouped = maps[-1].withColumn("up", up).repartition(*k, "up").sortWithinPartitions(*k, "up", "chunk", "upto")
        maps.append(grouped.mapInPandas(_composed(k, interval, width * FAN**level), f"{kinds}, chunk long, upto long, after long"))
    told = f"{kinds}, chunk long, due long, next_due long"
    dues = maps.pop().repartition(*k).sortWithinPartitions(*k, "chunk", "upto").mapInPandas(_dues(k), told)
    while maps:
        seeds = dues.select(*k, F.col("chunk").alias("up"), F.lit(SEED).alias("chunk"), F.lit(SEED).alias("upto"), F.col("due").alias("after"))
        rows = maps.pop().withColumn("up", up).select(*k, "up", "chunk", "upto", "after").unionByName(seeds)
        rows = rows.repartition(*k, "up").sortWithinPartitions(*k, "up", "chunk", "upto")
        dues = rows.mapInPandas(_dues([*k, "up"], True), f"{kinds}, up long, chunk long, due long, next_due long").drop("up")
    return dues


def _kept(keys: list[str], interval: int):
    """Thin each chunk; its first row brings the due time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, due = None, FIRST
        for part in parts:
            ts, keep = part["ts"].tolist(), []
            for key, lo, hi in runs(part, [*keys, "chunk"]):
                if key != held:
                    held, due, lo = key, int(part["due"].iloc[lo]), lo + 1
                at = bisect_left(ts, due, lo, hi)
                while at < hi:
                    keep.append(at)
                    due = ts[at] + interval
                    at = bisect_left(ts, due, at + 1, hi)
            yield part.iloc[keep].drop(columns=["chunk", "due"])

    return run


def due_thinning(
    samples: DataFrame, interval_us: int, keys=("instance", "op"), ts="ts_us", tie="event_id", chunk_intervals: int = 16
) -> DataFrame:
    """Kept rows as keys, time and tie."""
    kept, _ = thin(samples, interval_us, list(keys), ts, tie, chunk_intervals)
    return kept


def thin(samples, interval_us, keys, ts="ts_us", tie="event_id", chunk_intervals=16, due: DataFrame | None = None):
    """Kept rows, and the next due time per series. ``due`` holds the due times of earlier batches."""
    interval, width = int(interval_us), int(interval_us) * int(chunk_intervals)
    k = [f"k{i}" for i in range(len(keys))]
    rows = samples.select(
        *[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(ts).alias("ts"), F.col(tie).alias("tie")
    )
    if due is not None:
        known = due.select(*[F.col(c).alias(n) for c, n in zip(keys, k)], F.col("due").alias("_due"))
        rows = rows.join(known, k, "left").where(F.col("_due").isNull() | (F.col("ts") >= F.col("_due"))).drop("_due")
    rows = rows.withColumn("chunk", whole_div(F.col("ts"), width))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    key_schema = ", ".join(f"{n} {kinds[n]}" for n in k)
    answers = (
        rows.select(*k, "chunk", "ts").repartition(*k, "chunk").sortWithinPartitions(*k, "chunk", "ts")
        .mapInPandas(_answers(k, interval, width), f"{key_schema}, chunk long, upto long, after long")
    )
    dues = _settled(answers, k, key_schema, interval, width)
    # The due time travels as one more row at the head of its chunk: one shuffle, no join. Chunks
    # without such a row hold nothing that is kept.
    heads = dues.select(*k, "chunk", F.lit(FIRST).alias("ts"), F.lit(0).cast(kinds["tie"]).alias("tie"), "due")
    never = F.lit(2**63 - 1)
    unhanded = rows.select(*k, "chunk", "ts", "tie", never.alias("due"))
    kept = (
        unhanded.unionByName(heads).repartition(*k, "chunk").sortWithinPartitions(*k, "chunk", "ts", "tie")
        .mapInPandas(_kept(k, interval), f"{key_schema}, ts long, tie {kinds['tie']}")
    )
    names = [F.col(n).alias(c) for c, n in zip(keys, k)]
    state = dues.groupBy(*k).agg(F.max("next_due").alias("due")).select(*names, "due")
    return kept.select(*names, F.col("ts").alias(ts), F.col("tie").alias(tie)), state
