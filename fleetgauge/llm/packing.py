"""Mixture-controlled packing of documents into sequences of equal length.

Every source is a queue of tokens (its documents in the order of a hash). Windows of some sequences are filled
by deficit round-robin: each round gives every queue its share of the window by weight, what a share leaves of
a whole token is carried as a deficit to the next window, and a queue that runs dry leaves its share to the
others in proportion. Because documents may be cut, a queue always takes exactly what it is given, so the
round in which any token is served follows from the queue totals alone: window ``w`` ends where the weighted
service of all queues reaches ``w`` times its size. Each partition works out its own pieces from the totals
and the document's place in its queue; deficits carry across windows and partitions without passing state.
Windows follow each other without gaps and are cut into sequences, so only the very last one is padded.

Texts are encoded once into a table of ids; a second pass cuts the ids. Places in queues are prefix sums over
hash ranges (a window sees rows of one small range, another the sums of the ranges), so a hot source is spread.

Up to ``QUEUES`` sources have a queue each; if there are more, those that ``targets`` does not name share
``QUEUES`` hashed queues, which bounds what each task is told, and deficits hold by queue. Null texts are
empty and pack as their end token alone, a null source is the empty source, repeated rows are packed one after
another, an empty table gives an empty table, further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.llm.chunks import byte_encoder, row_sums
from fleetgauge.llm.common import flat_bytes, slices, spread, text_or_empty
from fleetgauge.llm.components import cut, stored

QUEUES = 256
RANGE_ROWS = 4096  # rows of a hash range, about


@dataclass(frozen=True)
class Mixture:
    """Totals and weights of the queues; all arithmetic is exact."""

    totals: tuple[int, ...]
    weights: tuple[Fraction, ...]
    window: int

    @functools.cached_property
    def phases(self) -> list[tuple[Fraction, Fraction, Fraction]]:
        """Served so far, virtual time and service per unit of time, from each moment a queue runs dry."""
        ends = sorted({Fraction(t) / w for t, w in zip(self.totals, self.weights) if t})
        out, now, served = [], Fraction(0), Fraction(0)
        for end in ends:
            slope = sum((w for t, w in zip(self.totals, self.weights) if Fraction(t) / w > now), Fraction(0))
            out.append((served, now, slope))
            served += slope * (end - now)
            now = end
        return out

    @functools.cached_property
    def _starts(self) -> list[Fraction]:
        return [p[0] for p in self.phases]

    @functools.cached_property
    def _rough(self) -> list[float]:
        return [float(w) for w in self.weights]

    def served(self, w: int) -> tuple[int, ...]:
        """Tokens taken from each queue before window ``w``."""
        if w * self.window >= sum(self.totals):
            return self.totals
        done, now, slope = self.phases[bisect.bisect_right(self._starts, w * self.window) - 1]
        time = now + (w * self.window - done) / slope
        return tuple(min(t, int(time * x)) for t, x in zip(self.totals, self.weights))

    def window_of(self, queue: int, place: int, served) -> int:
        """The window that takes the token at ``place`` of a queue."""
        weights = self._rough
        time = place / weights[queue]
        guess = int(sum(min(t, time * x) for t, x in zip(self.totals, weights)) // self.window)  # then made exact
        while guess and served(guess)[queue] > place:
            guess -= 1
        while served(guess + 1)[queue] <= place:
            guess += 1
        return guess


def mixture(totals: list[tuple[str, int]], window: int, targets: dict[str, float] | None) -> Mixture:
    """Weights of the named queues as given; the rest of 1 goes to the others in proportion to their tokens."""
    targets = targets or {}
    free = sum(t for q, t in totals if q not in targets)
    left = max(Fraction(0), 1 - sum((Fraction(x).limit_denominator(10**6) for x in targets.values()), Fraction(0)))
    left = left or Fraction(1, 10**6)
    weights = [Fraction(targets[q]).limit_denominator(10**6) if q in targets else left * Fraction(t, free or 1) for q, t in totals]
    if any(w <= 0 for w in weights):
        raise ValueError("targets must be positive")
    return Mixture(tuple(t for _, t in totals), tuple(weights), window)


def _queue(name: Column, targets: dict[str, float] | None, shared: bool) -> Column:
    """``=`` and the source, or ``#`` and the number of a queue that sources share."""
    own = F.concat(F.lit("="), name)
    hashed = F.concat(F.lit("#"), F.pmod(F.xxhash64(name), F.lit(QUEUES)).cast("string"))
    return (F.when(name.isin(*targets), own).otherwise(hashed) if targets else hashed) if shared else own


def _encoded(rows: DataFrame, kind: str, paths: tuple[str, str | None], end_id: int) -> DataFrame:
    """key, queue, doc_id, n and ``ids`` of every row; two bytes an id where the vocabulary allows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(*paths)
        for batch in slices(batches):
            data, at = flat_bytes(batch.column("text"))
            codes, firsts, _ = encoder.chunks(data, at)
            table, begins = encoder.ids()
            sizes = encoder.sizes[codes]
            n = row_sums(sizes, firsts) + 1
            ends = np.cumsum(n)
            out = np.full(int(ends[-1]), end_id, "<u4")
            own = np.ones(len(out), bool)
            own[ends - 1] = False  # each row's last id is the end
            out[own] = table[spread(begins[codes], sizes)]
            wide = bool((out > 0xFFFF).any())
            raw = pa.py_buffer(out if wide else out.astype("<u2"))
            bounds = np.concatenate([[0], ends]).astype(np.int64) * (4 if wide else 2)
            ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds), raw]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("queue"), batch.column("doc_id"), pa.array(n), ids], names=["key", "queue", "doc_id", "n", "ids"])

    return rows.select("key", "queue", "doc_id", "text").mapInArrow(run, f"key string, queue string, doc_id {kind}, n long, ids binary")


def places(counted: DataFrame) -> DataFrame:
    """key, queue, n, copies and ``place``, the tokens of the queue before the first copy."""
    rows = cut(counted.groupBy("key", "queue", "n").agg(F.count("*").alias("copies")))
    digits, n = 1, rows.count()
    while 16**digits * RANGE_ROWS < n:
        digits += 1
    rows = rows.withColumn("range", F.substring("key", 1, digits)).withColumn("all", F.col("n") * F.col("copies"))
    sums = rows.groupBy("queue", "range").agg(F.sum("all").alias("all"))
    before = Window.partitionBy("queue").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("queue", "range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("queue", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("own", F.coalesce(F.sum("all").over(inside), F.lit(0))).join(base, ["queue", "range"])
            .select("key", "queue", "n", "copies", (F.col("base") + F.col("own")).alias("place")))


PIECE = """start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"""


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, sequence: int = 1024, window_sequences: int = 64,
         targets: dict[str, float] | None = None, end_id: int = 0, source: str = "source") -> DataFrame:
    """A row per piece: doc_id and PIECE; ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers.

    ``targets`` maps sources to shares of the tokens of each window; without it every window holds the sources
    in the proportions of the whole."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    paths = (json_path, ranks_path)
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    names = docs.select(name.alias("s"))
    if targets:
        names = names.where(~F.col("s").isin(*targets))
    shared = names.distinct().limit(QUEUES + 1).count() > QUEUES
    rows = docs.select("doc_id", text_or_empty().alias("text"), _queue(name, targets, shared).alias("queue"), name.alias("_name"))
    rows = rows.withColumn("key", F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x01")), "_name", "text")))
    encoded = stored(_encoded(rows, kind, paths, end_id), "packing-ids")
    placed = cut(places(encoded.select("key", "queue", "n")))
    totals = sorted((r["queue"], int(r["t"])) for r in placed.groupBy("queue").agg(F.sum(F.col("n") * F.col("copies")).alias("t")).collect())
    plan = mixture(totals, sequence * window_sequences, {f"={q}": x for q, x in (targets or {}).items()})
    number = {q: i for i, (q, _) in enumerate(totals)}

    # equal rows are one row with a count, so that each copy can be given its own place
    distinct = encoded.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("ids").alias("ids"))
    work = distinct.join(placed, "key").select("doc_id", "ids", "queue", "n", "copies", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(1 << 14)
        def served(w: int) -> tuple[int, ...]:
            return plan.served(w)

        @functools.lru_cache(1 << 14)
        def starts(w: int) -> tuple[int, ...]:
            now, then = served(w), served(w + 1)
            at, out = sum(now), []
            for a, b in zip(now, then):
                out.append(at - a)
                at += b - a
            return tuple(out)

        def pieces(queue: int, place: int, n: int):
            done, w = 0, plan.window_of(queue, place, served)
            while done < n:
                x = place + done
                while served(w + 1)[queue] <= x:
                    w += 1
                at = starts(w)[queue] + x
                size = min(n - done, served(w + 1)[queue] - x, sequence - at % sequence)
                yield done, size, n, at // sequence, at % sequence
                done += size

        for batch in slices(batches, "ids"):
            owner, out, raw = [], [], []
            names, copies, first, sizes = (batch.column(c).to_pylist() for c in ("queue", "copies", "place", "n"))
            for i, own in enumerate(batch.column("ids").to_pylist()):
                n = sizes[i]
                if len(own) == 2 * n:
                    own = np.frombuffer(own, "<u2").astype("<u4").tobytes()
                for c in range(copies[i]):
                    for piece in pieces(number[names[i]], first[i] + c * n, n):
                        owner.append(i)
                        out.append(piece)
                        raw.append(own[4 * piece[0]:4 * (piece[0] + piece[1])])
            columns = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(np.ascontiguousarray(x)) for x in columns),
                 pa.array(raw, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return work.mapInArrow(run, f"doc_id {kind}, {PIECE}")
