"""Whitening of vectors by the exact covariance of their integer entries.

Entries c become x = floor(scale * c) + shift. The covariance comes by polarisation: the sum of squares of every
dimension and of every sum of two dimensions is aggregated, and half the difference of their variances is the
covariance of the two. All sums are of integers and exact: values are centred at the whole number next to their
mean before they are squared, and the rest of the centring is put right in the sums, still in integers. Tasks
hand over one row per pair of dimensions, so what comes together grows with the width of a vector, not with
the rows; the matrix of that width is solved by eigh on the driver.

Four passes read the vectors: sums, squares, the covariance of the result, the result. Nothing but sums moves.

Vectors that are null, or hold null or non-finite entries, take no part; nor do those of another width than most
(the greater of two as frequent). Rows with equal or null ids each count. A direction without variance (beside
the largest, within double precision) can't be scaled to one and gives no component: without any, as for one row
or an empty table, the result is empty. A deviation that no long holds is null. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.vectors import column_sums, entries, largest, whole

BLOCK = 4096  # rows worked off together
LOW = 60  # bits of the lower part of a sum of squares


class Matrices:
    """The integer matrices of one width of a DataFrame's batches, with their rows' ids."""

    def __init__(self, scale: float, shift: int, width: int | None = None) -> None:
        self.scale, self.shift, self.width = scale, shift, width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                for rows, x in whole(part.column(1), self.scale):
                    if x.shape[1] and self.width in (None, x.shape[1]):
                        yield part.column(0).take(pa.array(rows)), x + self.shift


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(read: Matrices):
    """Rows (width, dim, n, total) of a task."""

    def run(batches):
        found: dict[int, list] = {}
        for _, x in read(batches):
            own = found.setdefault(x.shape[1], [0, 0])
            own[0] += len(x)
            own[1] = own[1] + column_sums(x)
        for width, (n, total) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), _decimals(total)],
                names=["width", "dim", "n", "total"])

    return run


def squares(y: np.ndarray) -> list[np.ndarray]:
    """For each dimension i: the sum of squares of y_i, then those of y_i + y_j for each j after i."""
    wide = (2 * largest(y)) ** 2 * len(y) >= 1 << 62
    t = np.ascontiguousarray((y.astype(object) if wide else y).T)
    out = []
    for i in range(len(t)):
        pairs = t[i + 1:] + t[i]
        own = np.array([(t[i] * t[i]).sum()], dtype=object)
        out.append(np.concatenate([own, (pairs * pairs).sum(axis=1).astype(object)]))
    return out


def _square_sums(read: Matrices, centre: np.ndarray):
    """Rows (i, j, high, low) of a task: the sum of squares of y_i (j = i) or y_i + y_j is high * 2^LOW + low."""

    def run(batches):
        total = None
        for _, x in read(batches):
            own = squares(x - centre)
            total = own if total is None else [a + b for a, b in zip(total, own)]
        for i, values in enumerate(total or []):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(values), pa.int32()), pa.array(range(i, i + len(values)), pa.int32()),
                 _decimals(v >> LOW for v in values), _decimals(v & ((1 << LOW) - 1) for v in values)],
                names=["i", "j", "high", "low"])

    return run


class Whitening:
    """What is fitted: n rows, the whole centre of each dimension, what the sums keep beside it (rest = total -
    n * centre), and for each component its share of the variance and its direction over the root of its variance."""

    def __init__(self, n: int, total: list[int], squared: dict[tuple[int, int], int] | None = None, components: int = 0) -> None:
        self.n, self.total = n, total
        self.centre = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)
        self.rest = [s - n * int(m) for s, m in zip(total, self.centre)]
        self.covariance = self.explained = self.scaled = None
        if squared is not None:
            self._solve(squared, components)

    def _solve(self, squared: dict[tuple[int, int], int], components: int) -> None:
        n, rest, width = self.n, self.rest, len(self.rest)
        # n^2 * (sum of squares) - n * (sum)^2 is the sum of squares of n * y - rest, centred exactly
        own = [n * n * squared[i, i] - n * rest[i] ** 2 for i in range(width)]
        self.covariance = np.empty((width, width))
        for i in range(width):
            self.covariance[i, i] = own[i] / n**3
            for j in range(i + 1, width):
                both = n * n * squared[i, j] - n * (rest[i] + rest[j]) ** 2
                self.covariance[i, j] = self.covariance[j, i] = (both - own[i] - own[j]) / (2 * n**3)
        value, vector = np.linalg.eigh(self.covariance)
        value, vector = value[::-1], vector[:, ::-1]
        keep = value > max(value[0], 0.0) * width * np.finfo(float).eps
        keep[components:] = False
        self.explained = value[keep] / np.trace(self.covariance) if keep.any() else value[keep]
        self.scaled = vector[:, keep] / np.sqrt(value[keep])

    def apply(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([r / self.n for r in self.rest])
        return ((x - self.centre) - mean) @ self.scaled

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - total)^2."""
        y = x - self.centre
        wide = len(self.rest) * (self.n * largest(y) + max(map(abs, self.rest))) ** 2 >= 1 << 63
        d = (y.astype(object) if wide else y) * self.n - np.array(self.rest, dtype=object if wide else np.int64)
        return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def fit(vectors: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000) -> Whitening | None:
    """The whitening of ``vectors`` (id, entries), or None without vectors."""
    sums = vectors.mapInArrow(_sums(Matrices(scale, shift)), "width int, dim int, n long, total decimal(38,0)")
    sums = sums.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    most = sums.groupBy("width").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "total"))).alias("sums"))
    most = most.orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not most:
        return None
    n, total = most[0]["n"], [int(x["total"]) for x in most[0]["sums"]]
    plain = Whitening(n, total)
    pairs = vectors.mapInArrow(_square_sums(Matrices(scale, shift, len(total)), plain.centre), "i int, j int, high decimal(38,0), low decimal(38,0)")
    pairs = pairs.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    squared = {(r["i"], r["j"]): (int(r["high"]) << LOW) + int(r["low"]) for r in pairs.collect()}  # width^2 / 2 rows
    return Whitening(n, total, squared, components)


def identity_error(vectors: DataFrame, found: Whitening, scale: float, shift: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = found.scaled.shape[1]
    read = Matrices(scale, shift, len(found.rest))

    def run(batches):
        total = np.zeros((k + 1, k))
        for _, x in read(batches):
            w = found.apply(x)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "total"])

    sums = vectors.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    total = np.zeros((k + 1, k))
    for r in sums.collect():  # components^2 rows
        total[r["i"], r["j"]] = r["total"] / found.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 32,
           scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each row and component."""
    key = vectors.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), entries(embedding).alias("entries"))
    found = fit(vectors, components, scale, shift)
    if found is None or found.scaled.shape[1] == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, found, scale, shift)
    read, k = Matrices(scale, shift, len(found.rest)), found.scaled.shape[1]

    def run(batches):
        for ids, x in read(batches):
            size = len(x) * k
            rows = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, found.n)),
                 pa.array(found.deviation(x), pa.int64()).take(rows), pa.array(found.apply(x).ravel()),
                 pa.array(np.tile(found.explained, len(x))), pa.array(np.full(size, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
