"""Exact search for the rows with the largest integer inner products, by tiled matrix products.

Vectors become integers and are packed into shards of some thousand rows; query rows are packed again into blocks.
Shards and blocks meet in a grid: each shard goes to every column of blocks, each block to every row of shards, and
a cell holds a bounded share of both, so what moves per product falls as cells grow to ``CELL_BYTES``. In a cell,
each block meets each shard in one matrix product; rows whose best score can't enter their list are passed over, the
others select their best. The lists of a block from all rows of shards are merged in a tree, ``FAN`` at a time.
Products are exact: floats where every sum is a whole number they hold, else integers.

Vectors that are null, or hold null or non-finite entries, take no part; vectors of different widths have no
product and don't meet. Every row counts for itself: rows with equal ids are candidates of each other and each
have their list. A row without id can be found (ties go to it last), and is no query unless ``is_query`` says so.
Scores that no long holds count as the nearest long. Empty table: empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.components import stored
from fleetgauge.llm.vectors import entries, largest, whole

SHARD, BLOCK = 4096, 1024  # rows of a shard, queries of a block
CELL_BYTES = (16 << 20, 64 << 20)  # of blocks and of shards in a cell of the grid
CELLS = 3  # a core, at least, where there are shards enough
FAN = 16
NONE = -(2**63 - 1)  # the score of an empty place
#: States of a place in a list, in their order among equal scores.
NAMED, NAMELESS, EMPTY = 0, 1, 2

_PACKED = "shard long, width int, size int, ids binary, nameless binary, asked binary, kind string, entries binary"
_BLOCKS = "block long, width int, size int, ids binary, nameless binary, shards binary, places binary, kind string, entries binary"
_LISTS = "block long, part long, ids binary, nameless binary, found binary, state binary, score binary"


def _kind(x: np.ndarray) -> str:
    """The least integer type for all entries."""
    most = largest(x)
    return next(k for k in ("i1", "i2", "i4", "i8") if most < 1 << (8 * int(k[1]) - 1))


def _own(seq: int) -> int:
    """A number no other task gives."""
    return (TaskContext.get().partitionId() << 32) + seq


def _record(schema: str, *values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields)], names=[n for n, _ in fields])


def _pack(scale: float):
    """Shards of a task's vectors, rows in the order in which they win ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        seq = 0

        def shard(width: int) -> pa.RecordBatch:
            ids, nameless, asked, x = (np.concatenate(part) for part in zip(*held.pop(width)))
            order = np.lexsort((ids, nameless))
            x = x[order]
            return _record(_PACKED, _own(seq), width, len(x), ids[order].tobytes(), nameless[order].tobytes(), asked[order].tobytes(),
                           _kind(x), x.astype(_kind(x)).tobytes())

        for batch in batches:
            for start in range(0, batch.num_rows, SHARD):
                part = batch.slice(start, SHARD)
                ids, asked = part.column(0), part.column(1).fill_null(False).to_numpy(zero_copy_only=False)
                nameless = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for rows, x in whole(part.column(2), scale):
                    held.setdefault(x.shape[1], []).append((ids[rows], nameless[rows].astype(np.uint8), asked[rows].astype(np.uint8), x))
                    if sum(len(h[0]) for h in held[x.shape[1]]) >= SHARD:
                        yield shard(x.shape[1])
                        seq += 1
        for width in list(held):
            yield shard(width)
            seq += 1

    return run


def _entries(kind: str, data: bytes, size: int, width: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(size, width)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the query rows of shards."""
    held: dict[int, list] = {}
    seq = 0

    def block(width: int) -> pa.RecordBatch:
        ids, nameless, shards, places, x = (np.concatenate(part) for part in zip(*held.pop(width)))
        return _record(_BLOCKS, _own(seq), width, len(x), ids.tobytes(), nameless.tobytes(), shards.tobytes(), places.tobytes(),
                       _kind(x), x.astype(_kind(x)).tobytes())

    for batch in batches:
        for s in batch.to_pylist():
            places = np.flatnonzero(np.frombuffer(s["asked"], np.uint8))
            x = _entries(s["kind"], s["entries"], s["size"], s["width"])
            ids, nameless = np.frombuffer(s["ids"], np.int64), np.frombuffer(s["nameless"], np.uint8)
            for start in range(0, len(places), BLOCK):
                p = places[start:start + BLOCK]
                own = held.setdefault(s["width"], [])
                own.append((ids[p], nameless[p], np.full(len(p), s["shard"]), p, x[p].astype(np.int64)))
                if sum(len(h[0]) for h in own) >= BLOCK:
                    yield block(s["width"])
                    seq += 1
    for width in list(held):
        yield block(width)
        seq += 1


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, exact up to the ends of a long."""
    bound = q.shape[1] * largest(q) * largest(x)
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)
    if bound < 1 << 63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, NONE, -NONE).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest entries of each row, of equal ones the first; all columns, if fewer."""
    size = scores.shape[1]
    if size <= k:
        return np.tile(np.arange(size), (len(scores), 1))
    most = largest(np.where(scores == NONE, 0, scores))
    if (most + 2) * size >= 1 << 62:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    # one number a place tells score and order, so a partial selection is exact in ties
    keyed = np.where(scores == NONE, -most - 1, scores) * size + np.arange(size - 1, -1, -1)
    return np.argpartition(keyed, size - k, axis=1)[:, size - k:]


class Lists:
    """The best k of each query so far: found, state and score, best first."""

    def __init__(self, queries: int, k: int) -> None:
        self.found = np.zeros((queries, k), np.int64)
        self.state = np.full((queries, k), EMPTY, np.uint8)
        self.score = np.full((queries, k), NONE)

    def merge(self, rows, found: np.ndarray, state: np.ndarray, score: np.ndarray) -> None:
        k = self.found.shape[1]
        both = [np.concatenate([a[rows], b], axis=1) for a, b in ((self.found, found), (self.state, state), (self.score, score))]
        order = np.lexsort((both[0], both[1], -both[2]), axis=-1)[:, :k]
        self.found[rows], self.state[rows], self.score[rows] = (np.take_along_axis(a, order, axis=1) for a in both)

    def record(self, block: int, part: int, ids: bytes, nameless: bytes) -> pa.RecordBatch:
        return _record(_LISTS, block, part, ids, nameless, self.found.tobytes(), self.state.tobytes(), self.score.tobytes())


def _tile(lists: Lists, b: dict, q: np.ndarray, s: dict, x: np.ndarray) -> None:
    """One block against one shard."""
    scores = products(q, x)
    mine = np.flatnonzero(np.frombuffer(b["shards"], np.int64) == s["shard"])
    scores[mine, np.frombuffer(b["places"], np.int64)[mine]] = NONE  # the query's own row
    rows = np.flatnonzero(scores.max(axis=1) >= lists.score[:, -1])
    if len(rows) == 0:
        return
    at = best(scores[rows], lists.score.shape[1])
    score = np.take_along_axis(scores[rows], at, axis=1)
    state = np.frombuffer(s["nameless"], np.uint8)[at]
    itself = (np.frombuffer(b["shards"], np.int64)[rows] == s["shard"])[:, None] & (at == np.frombuffer(b["places"], np.int64)[rows][:, None])
    lists.merge(rows, np.frombuffer(s["ids"], np.int64)[at], np.where(itself, np.uint8(EMPTY), state), score)


def _cell(k: int):
    def run(key: tuple, blocks: pa.Table, shards: pa.Table) -> pa.Table:
        out = []
        shards = shards.to_pylist()
        for b in blocks.to_pylist() if shards else []:
            q = _entries(b["kind"], b["entries"], b["size"], b["width"])
            lists = Lists(len(q), k)
            for s in shards:
                if s["width"] == b["width"]:
                    _tile(lists, b, q, s, _entries(s["kind"], s["entries"], s["size"], s["width"]))
            out.append(lists.record(b["block"], key[0].as_py(), b["ids"], b["nameless"]))
        return pa.Table.from_batches(out) if out else _nothing()

    return run


def _nothing() -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in _LISTS.split(", "))]).empty_table()


def _lists(r: dict, k: int) -> Lists:
    out = Lists(0, k)
    out.found = np.frombuffer(r["found"], np.int64).reshape(-1, k).copy()
    out.state = np.frombuffer(r["state"], np.uint8).reshape(-1, k).copy()
    out.score = np.frombuffer(r["score"], np.int64).reshape(-1, k).copy()
    return out


def _merged(k: int):
    """One list a query from those of up to FAN parts."""

    def run(key: tuple, parts: pa.Table) -> pa.Table:
        rows = parts.to_pylist()
        total = _lists(rows[0], k)
        for r in rows[1:]:
            own = _lists(r, k)
            total.merge(slice(None), own.found, own.state, own.score)
        return pa.Table.from_batches([total.record(key[0].as_py(), key[1].as_py(), rows[0]["ids"], rows[0]["nameless"])])

    return run


def _rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lists = _lists(r, k)
                q, at = np.nonzero(lists.state != EMPTY)
                nameless = np.frombuffer(r["nameless"], np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["ids"], np.int64)[q], mask=nameless[q]), pa.array((at + 1).astype(np.int32)),
                     pa.array(lists.found[q, at], mask=lists.state[q, at] == NAMELESS), pa.array(lists.score[q, at])],
                    names=["query_id", "rank", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
          scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``is_query`` holds the k other rows of the highest
    inner product of floor(scale * entry), ties to the smaller id; all rows, if fewer."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), is_query.alias("asked"), entries(embedding).alias("entries"))
    shards = stored(rows.mapInArrow(_pack(scale), _PACKED), "topk-shards")
    blocks = stored(shards.mapInArrow(_ask, _BLOCKS), "topk-blocks")
    have = shards.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("entries")), F.lit(0)).alias("bytes")).first()
    want = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("entries")), F.lit(0)).alias("bytes")).first()
    across = max(1, min(want["n"], math.ceil(want["bytes"] / CELL_BYTES[0])))
    down = max(math.ceil(have["bytes"] / CELL_BYTES[1]), math.ceil(CELLS * spark.sparkContext.defaultParallelism / across))
    down = max(1, min(have["n"], down))
    # each side once for every line of the grid that it crosses
    left = blocks.select("*", F.pmod(F.xxhash64("block"), F.lit(across)).alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("g"))
    right = shards.drop("asked").select("*", F.pmod(F.xxhash64("shard"), F.lit(down)).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("h"))
    lists = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(_cell(k), _LISTS)
    while down > 1:
        down = math.ceil(down / FAN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("block", "part").applyInArrow(_merged(k), _LISTS)
    return lists.mapInArrow(_rows(k), "query_id long, rank int, vec_id long, score long")
