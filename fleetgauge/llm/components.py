"""Connected components by alternating large and small stars, and cutting of lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.workdir import fresh_dir, shared_dir


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder: later steps survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows as a compressed table in the shared folder, for larger ones of which steps read some columns."""
    path = fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _star(edges: DataFrame, centre: str, other: str) -> DataFrame:
    """Ties ``other`` to the smallest end of all edges of its ``centre``. The minimum is aggregated before the
    shuffle and joined back, so that a hub's edges stay split."""
    least = edges.groupBy(F.col(centre).alias("c")).agg(F.min(other).alias("m"))
    return edges.join(least, F.col(centre) == F.col("c"))


def labelled(edges: DataFrame, key: str = "fp") -> DataFrame:
    """Nodes of the undirected edges (a, b) as ``key`` with ``component``, the smallest node reachable.

    Nodes that are the smallest of their component, or have no edge, are left out; loops and repeated edges
    change nothing."""
    pairs = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not _is_done(pairs):
        # large star: the larger neighbours of a node meet its smallest neighbour
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b"), F.col("a")))
        large = _star(both, "u", "v").where("v > u").select(F.least("m", "u").alias("a"), F.col("v").alias("b"))
        # small star: a node and its smaller neighbours meet the smallest of them
        small = _star(large, "b", "a").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        pairs = cut(small.select("e.*").where("a <> b").distinct())
    return pairs.select(F.col("b").alias(key), F.col("a").alias("component"))


def _is_done(pairs: DataFrame) -> bool:
    """Whether all edges (a < b) are stars: no node is both the end of one and the start of another, or the end of two."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(2).alias("n")), F.struct(F.col("b").alias("node"), F.lit(1).alias("n")))).alias("e"))
    ends = ends.groupBy("e.node").agg(F.max("e.n").alias("role"), F.sum((F.col("e.n") == 1).cast("long")).alias("ends"))
    return ends.where("ends > 1 OR (ends = 1 AND role = 2)").limit(1).isEmpty()
