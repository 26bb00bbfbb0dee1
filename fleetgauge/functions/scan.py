"""Ordered scans (previous row, running sum, last value, running maximum) that survive hot keys.

A plain window over one series puts the whole series into one task. Here every key is cut
into time chunks: the window runs inside (key, chunk), the last row of a chunk tells what it hands on,
the window over a key only sees those chunk rows, and the carry is joined back on (key, chunk).
Results are exactly those of the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.constants import CHUNK_US


@dataclass(frozen=True)
class Scan:
    kind: str  # lag | sum | last | max | max_before
    value: Column | str  # a column name where it can be: it is then not carried twice
    alias: str


def lag(value, alias):
    """Value of the row before this one (NULL for the first)."""
    return Scan("lag", value, alias)


def running_sum(value, alias):
    """Sum up to and including this row."""
    return Scan("sum", value, alias)


def last_seen(value, alias):
    """Latest non-NULL value up to and including this row."""
    return Scan("last", value, alias)


def running_max(value, alias):
    """Greatest value up to and including this row."""
    return Scan("max", value, alias)


def max_before(value, alias):
    """Greatest value of the rows before this one."""
    return Scan("max_before", value, alias)


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], *phases: list[Scan], chunk_us: int = CHUNK_US) -> DataFrame:
    """Add one column per scan; a later phase may use the columns of an earlier one.

    ``order[0]`` is an integer that is also cut into chunks. A NULL text key is the empty label (both
    are one series), other NULL keys are a series of their own; a NULL time comes before all others.
    Keys come out as they went in. Both sides of the carry join start from the same window, so Spark
    reuses its shuffle instead of reading the source again, most of all when ``df`` holds only keys,
    order and scanned columns.
    """
    group, named, away = [], {}, {}
    for i, k in enumerate(keys):
        field = df.schema[k]
        if not field.nullable:
            group.append(k)
            continue
        g = f"_g{i}"
        group.append(g)
        if field.dataType.typeName() == "string":
            named[g], away[k] = F.coalesce(F.col(k), F.lit("")), F.when(~F.col(f"_n{i}"), F.col(g))
            named[f"_n{i}"] = F.col(k).isNull()
        else:
            named[g], away[k] = F.coalesce(F.col(k).cast("string"), F.lit("")), F.col(k)
    rows = df.withColumns(named) if named else df
    rows = rows.drop(*[k for i, k in enumerate(keys) if f"_n{i}" in named])
    rows = rows.withColumn("_chunk", F.coalesce(F.expr(f"`{order[0]}` div {int(chunk_us)}"), F.lit(-(2**62))))
    added = []
    for scans in phases:
        rows = _phase(rows, [*group, "_chunk"], group, order, scans)
        added += [s.alias for s in scans]
    columns = {c: away.get(c, F.col(c)) for c in dict.fromkeys([*df.columns, *added])}
    return rows.select(*[e.alias(c) for c, e in columns.items()])


def _phase(df: DataFrame, group: list[str], keys: list[str], order: list[str], scans: list[Scan]) -> DataFrame:
    inner = Window.partitionBy(*group).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)

    # _l: the scan inside the chunk; _t: its value after the chunk's last row; _c: carry into the chunk.
    local, total, carry, out = {}, {}, {}, {}
    for i, s in enumerate(scans):
        v = F.col(s.value if isinstance(s.value, str) else f"_v{i}")
        here, past, t = F.col(f"_l{i}"), F.col(f"_c{i}"), f"_t{i}"
        if s.kind == "lag":
            local[f"_l{i}"], total[t], carry[f"_c{i}"] = F.lag(v).over(inner), v, F.lag(t).over(chunks)
            out[s.alias] = F.when(F.col("_head"), past).otherwise(here)
        elif s.kind == "sum":
            local[f"_l{i}"], total[t], carry[f"_c{i}"] = F.sum(v).over(upto), here, F.sum(t).over(before)
            out[s.alias] = F.coalesce(past, F.lit(0)) + F.coalesce(here, F.lit(0))
        elif s.kind == "last":
            local[f"_l{i}"], total[t] = F.last(v, ignorenulls=True).over(upto), here
            carry[f"_c{i}"] = F.last(t, ignorenulls=True).over(before)
            out[s.alias] = F.coalesce(here, past)
        elif s.kind == "max":
            local[f"_l{i}"], total[t], carry[f"_c{i}"] = F.max(v).over(upto), here, F.max(t).over(before)
            out[s.alias] = F.greatest(here, past)
        elif s.kind == "max_before":
            local[f"_l{i}"], total[t], carry[f"_c{i}"] = F.max(v).over(earlier), F.greatest(here, v), F.max(t).over(before)
            out[s.alias] = F.greatest(here, past)
        else:
            raise ValueError(s.kind)
    local["_tail"] = F.lead(F.lit(True)).over(inner).isNull()
    if any(s.kind == "lag" for s in scans):
        local["_head"] = F.lag(F.lit(True)).over(inner).isNull()

    values = {f"_v{i}": s.value for i, s in enumerate(scans) if not isinstance(s.value, str)}
    inside = (df.withColumns(values) if values else df).withColumns(local)
    tails = inside.where("_tail").select(*group, *[e.alias(t) for t, e in total.items()])
    carried = tails.withColumns(carry).select(*group, *carry)
    joined = inside.join(carried, group)
    return joined.select(*[c for c in df.columns if c not in out], *[e.alias(a) for a, e in out.items()])


def positioned(df: DataFrame, order: list[str], alias: str = "pos") -> DataFrame:
    """Number the rows 1..n in global order without pulling them into one task.

    The range-sorted rows are checkpointed so that partition numbers are fixed; the only thing
    gathered is one count per partition.
    """
    from fleetgauge.workdir import shared_dir

    shared_dir(df.sparkSession)
    numbered = (
        df.orderBy(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row"))
        .drop("_id")
        .checkpoint()
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part").count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        numbered.join(offsets, "_part")
        .withColumn(alias, (F.col("_offset") + F.col("_row") + 1).cast("bigint"))
        .drop("_part", "_row", "_offset")
    )
