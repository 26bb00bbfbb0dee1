"""Row filters of the collection pass and of label queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.constants import DEFAULT_EXCLUDES, DEFAULT_INCLUDES
from fleetgauge.functions.local import local_table
from fleetgauge.functions.text import from_epoch_us, stat_key

#: Up to so many rules fold into one condition; more become a table.
FOLDED = 64


def starts_with_any(name: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [name.startswith(p) for p in prefixes], F.lit(False))


def prefix_rules(stats: DataFrame, include=DEFAULT_INCLUDES, exclude=DEFAULT_EXCLUDES) -> DataFrame:
    """Drop names under an exclude prefix, unless an include prefix matches too. Default: keep.

    Rules are lists, or tables of a column ``prefix``. A few listed ones fold into one condition inside the scan's own
    stage; more are looked up (see ``prefix_table_rules``).
    """
    if isinstance(include, DataFrame) or isinstance(exclude, DataFrame) or len(include) + len(exclude) > FOLDED:
        return prefix_table_rules(stats, include, exclude)
    key = stat_key()
    return stats.where(starts_with_any(key, include) | ~starts_with_any(key, exclude))


def _prefixes(stats: DataFrame, rules) -> DataFrame:
    rules = rules if isinstance(rules, DataFrame) else local_table(stats.sparkSession, [(p,) for p in rules], {"prefix": "string"})
    return rules.where("prefix IS NOT NULL").select("prefix").distinct()


def prefix_table_rules(stats: DataFrame, include, exclude) -> DataFrame:
    """``prefix_rules`` with rule tables of any size: the plan stays as it is, however many there are.

    Each distinct name is judged once. Its starts, of only those lengths that rules have, are looked up in the rules
    by an equi-join; names that lose are few rows again, and their samples go by an anti-join.
    """
    rules = _prefixes(stats, include).withColumn("wins", F.lit(True)).unionByName(_prefixes(stats, exclude).withColumn("wins", F.lit(False)))
    lengths = rules.agg(F.coalesce(F.array_sort(F.collect_set(F.length("prefix"))), F.array().cast("array<int>")).alias("lengths"))
    names = stats.select(stat_key().alias("_name")).where("_name IS NOT NULL").distinct()
    # one row of lengths meets every name: as a literal, for it is as short as the longest rule
    sizes = F.array(*[F.lit(n) for n in lengths.first()["lengths"]]).cast("array<int>")
    starts = names.select("_name", F.explode(F.filter(sizes, lambda n: n <= F.length("_name"))).alias("_n"))
    starts = starts.select("_name", F.expr("substring(_name, 1, _n)").alias("prefix"))
    lost = starts.join(rules, "prefix").groupBy("_name").agg(F.bool_or("wins").alias("_wins")).where("NOT _wins")
    kept = stats.withColumn("_name", stat_key()).join(lost.select("_name"), "_name", "left_anti")
    return kept.where("_name IS NOT NULL").drop("_name")


def drop_facility(stats: DataFrame, own: str) -> DataFrame:
    """Drop the collector's own facility, whatever its case; rows without one stay, to be counted as invalid."""
    return stats.where(~F.lower("facility").eqNullSafe(own.lower()))


def value_types(stats: DataFrame, types=("LONG", "NUMBER")) -> DataFrame:
    return stats.where(F.col("vtype").isin(*types))


def verdicts(stats: DataFrame, value="value_milli") -> DataFrame:
    """``invalid`` without facility or name, ``skipped`` without a value, else ``ok``."""
    bad = F.col("facility").isNull() | F.col("stat").isNull()
    return stats.withColumn("verdict", F.when(bad, "invalid").when(F.col(value).isNull(), "skipped").otherwise("ok"))


def conditional_emit(rows: DataFrame, rules: dict[str, tuple[Column, Column]], ids) -> DataFrame:
    """One output row per metric whose guard holds: ``rules`` maps a metric to (guard, value)."""
    candidates = F.array(*[
        F.when(guard, F.struct(F.lit(m).alias("metric"), value.cast("bigint").alias("value")))
        for m, (guard, value) in rules.items()
    ])
    out = rows.select(*ids, F.explode(F.array_compact(candidates)).alias("c"))
    return out.select(*ids, "c.metric", "c.value")


def label_match(samples: DataFrame, equal: dict[str, str]) -> DataFrame:
    """Equality matchers on labels; a missing label is the empty text. One that is also stored as a column is compared
    there, which reaches the scan."""
    return reduce(lambda df, kv: df.where(_equals(df, *kv)), equal.items(), samples)


def _equals(samples: DataFrame, label: str, value: str) -> Column:
    own = F.col(label) if label in samples.columns else F.col("labels")[label]
    return own == value if value else F.coalesce(own, F.lit("")) == ""


def _label(samples: DataFrame, label: str) -> Column:
    return F.coalesce(F.col(label) if label in samples.columns else F.col("labels")[label], F.lit(""))


def whole_match(pattern: str) -> str:
    """A pattern that holds for the whole text only, line ends included."""
    return rf"(?s)\A(?:{pattern})\z"


def label_regex(samples: DataFrame, label: str, pattern: str) -> DataFrame:
    """Regular expression over the whole label value; a missing label is the empty text."""
    return samples.where(_label(samples, label).rlike(whole_match(pattern)))


def series_of(samples: DataFrame, labels: str = "labels", key: str = "series_key") -> DataFrame:
    """The dictionary of series: each with its labels once, as ``series_id`` (a hash of the key) and ``series_key``."""
    return samples.groupBy(key).agg(F.first(labels).alias(labels)).withColumn("series_id", F.xxhash64(key))


def select_series(samples: DataFrame, series: DataFrame, matchers, key: str = "series_key") -> DataFrame:
    """Samples of the series of the dictionary that all ``matchers`` (label, operator, value) hold for: ``=``, ``!=``,
    ``=~`` and ``!~``, a missing label being the empty text.

    Matchers run once a series, whatever its samples, which are then chosen by a semi-join on the key: Spark
    broadcasts a short list of chosen series, or filters the samples' side by a Bloom filter of it at run time."""
    chosen = reduce(lambda df, m: df.where(_holds(df, *m)), matchers, series)
    return samples.join(chosen.select(key), key, "left_semi")


def _holds(series: DataFrame, label: str, operator: str, value: str) -> Column:
    own = _label(series.select("labels"), label)
    found = own.rlike(whole_match(value)) if operator.endswith("~") else own == value
    return ~found if operator.startswith("!") else found


_COMPARE = {
    ">": lambda c, x: c > x, "<": lambda c, x: c < x, ">=": lambda c, x: c >= x,
    "<=": lambda c, x: c <= x, "==": lambda c, x: c == x, "!=": lambda c, x: c != x,
}


def value_threshold(samples: DataFrame, op: str, limit, value="value") -> DataFrame:
    return samples.where(_COMPARE[op](F.col(value), F.lit(limit)))


def time_range(samples: DataFrame, from_us: int, to_us: int, ts="ts_us") -> DataFrame:
    """Samples in ``[from, to]``. ``ts`` is in microseconds or a stored zone-less timestamp; the latter is
    compared with literals, so the bounds reach the scan."""
    stored = samples.schema[ts].dataType.typeName() == "timestamp_ntz"
    low, high = (from_epoch_us(f"{int(us)}L") if stored else F.lit(int(us)) for us in (from_us, to_us))
    return samples.where(F.col(ts).between(low, high))
