"""Half-open intervals [s, e) per key: taking some away from others, without pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.scan import ordered_scan, running_sum

FOREVER = 9_000_000_000_000_000_000


def minus(intervals: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """What ``taken`` (keys, s, e) leaves of each row of ``intervals`` (keys, s, e and more): one row per part.

    What is taken forms islands, with gaps between them that are numbered like the islands before them. One scan
    over the turns of what is taken and both ends of each row counts how many intervals cover an instant and how
    many islands have begun; the latter tells a row the numbers of the gaps it can reach, so rows and gaps meet
    by equality and nothing is compared that does not touch. NULL keys count as empty text.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = {n: F.coalesce(F.col(k).cast("string"), F.lit("")) for n, k in zip(names, keys)}
    # by how many intervals more, or fewer, an instant is covered from then on
    turns = F.array(F.struct(F.col("s").alias("_at"), F.lit(1).alias("_by")), F.struct(F.col("e").alias("_at"), F.lit(-1).alias("_by")))
    turns = taken.where("e > s").select(*[e.alias(n) for n, e in keyed.items()], F.explode(turns).alias("x")).select(*names, "x.*")
    turns = turns.groupBy(*names, "_at").agg(F.sum("_by").alias("_by")).where("_by <> 0").withColumn("_rank", F.lit(0))
    # both ends of a row and these turns in one order: an island that starts with a row counts at its start,
    # one that starts as the row ends does not count
    both_ends = F.array(*[F.struct(F.col(at).alias("_at"), F.lit(rank).alias("_rank")) for at, rank in (("s", 1), ("e", -1))])
    asked = intervals.withColumns(keyed).withColumn("x", F.explode(both_ends)).select("*", "x.*", F.lit(0).cast("bigint").alias("_by")).drop("x")
    opens = F.when((F.col("_by") > 0) & (F.col("_cover") == F.col("_by")), 1).otherwise(0)
    seen = ordered_scan(asked.unionByName(turns, allowMissingColumns=True), names, ["_at", "_rank"],
                        [running_sum("_by", "_cover")], [running_sum(opens, "_seen")])
    # an island's start ends the gap before it, its end starts the gap after it
    starts = F.col("_cover") == F.col("_by")
    edges = seen.where("_by <> 0 AND (_cover = 0 OR _cover = _by)").select(
        *names, F.when(starts, F.col("_seen") - 1).otherwise(F.col("_seen")).alias("no"),
        F.when(~starts, F.col("_at")).alias("s"), F.when(starts, F.col("_at")).alias("e"))
    gaps = edges.groupBy(*names, "no").agg(
        F.coalesce(F.max("s"), F.lit(-FOREVER)).alias("_from"), F.coalesce(F.max("e"), F.lit(FOREVER)).alias("_to"))
    whole = [*dict.fromkeys([*names, *intervals.columns])]
    rows = seen.where("_rank <> 0").groupBy(*whole).agg(F.min("_seen").alias("_first"), F.max("_seen").alias("_last"), F.count("*").alias("_n"))
    rows = rows.withColumn("no", F.explode(F.sequence("_first", "_last")))
    parts = rows.join(gaps, [*names, "no"], "left").withColumns({
        "s": F.greatest("s", F.coalesce("_from", F.col("s"))), "e": F.least("e", F.coalesce("_to", F.col("e")))})
    equal = F.explode(F.array_repeat(F.lit(0), (F.col("_n") / 2).cast("int")))  # rows that are equal come out as often
    return parts.where("e > s").select(*intervals.columns, equal.alias("_again")).drop("_again")
