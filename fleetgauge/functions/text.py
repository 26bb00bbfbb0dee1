"""Text, number and time formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OTHER_ASCII = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_REPLACED = "".join("C" if c == "/" else "_" for c in _OTHER_ASCII)
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{ts}`)")


def from_epoch_us(us: str) -> Column:
    """The inverse: a zone-less timestamp from microseconds."""
    return F.expr(f"timestampadd(MICROSECOND, {us}, {EPOCH})")


def ceil_to(us: Column, step_us: int) -> Column:
    """The first multiple of ``step_us`` at or after the instant."""
    return us + F.pmod(-us, F.lit(int(step_us)))


def whole_div(number: Column, by: int) -> Column:
    """Integer quotient, rounded down."""
    return F.call_function("div", number - F.pmod(number, F.lit(int(by))), F.lit(int(by)))


def sanitized(name: Column) -> Column:
    """Letters and digits stay, a slash becomes C, everything else an underscore.

    Plain ASCII names, nearly all of them, go through a character table; only others need the pattern.
    """
    plain = F.octet_length(name) == F.char_length(name)
    return F.when(plain, F.translate(name, _OTHER_ASCII, _REPLACED)).otherwise(
        F.regexp_replace(F.translate(name, "/", "C"), "[^A-Za-z0-9]", "_")
    )


def prefixed(prefix: str | None, name: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), name) if prefix else name


def stat_key(facility="facility", stat="stat") -> Column:
    """Lower-cased dotted name; the key for rules, duplicates and descriptions."""
    return F.lower(F.concat_ws(".", facility, stat))


def help_text(text: Column) -> Column:
    """Drop control characters, collapse blanks, trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f]", ""), " +", " "))


def matched_number(text: Column, pattern: str, group: int, kind: str = "bigint") -> Column:
    """The number a pattern finds; NULL where it finds none or it is too large.

    The empty string of a missed match is taken out first: a failing cast is far slower than NULL.
    """
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast(kind)


def first_token(text: Column) -> Column:
    return F.substring_index(text, " ", 1)


def to_milli(number: Column) -> Column:
    """Double to whole thousandths, half away from zero, as DECIMAL(38,0): no finite size that metrics take is lost."""
    scaled = number * F.lit(1000.0) + F.when(number >= 0, F.lit(0.5)).otherwise(F.lit(-0.5))
    small = F.abs(scaled) < F.lit(2.0**53)  # larger doubles are whole
    return F.when(small, scaled.try_cast("bigint").cast("decimal(38,0)")).otherwise(scaled.try_cast("decimal(38,0)"))


def milli_text(milli: Column) -> Column:
    """Whole thousandths (integer or decimal) as fixed three-decimal text, sign kept."""
    digits = F.abs(milli).cast("string")
    digits = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(
        F.when(milli < 0, F.lit("-")).otherwise(F.lit("")),
        F.substring(digits, F.lit(1), F.length(digits) - 3), F.lit("."), F.right(digits, F.lit(3)),
    )


def rounded(number: Column, decimals: int) -> Column:
    """Half-up rounding by floor, the same double in every engine."""
    scale = float(10**decimals)
    return F.floor(number * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def duration_text(seconds: Column) -> Column:
    """``1.50 hours`` style text; two decimals, truncated."""

    def scaled(unit: int, label: str) -> Column:
        whole = whole_div(seconds, unit)
        part = whole_div(seconds % unit * 100, unit)
        return F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), 2, "0"), F.lit(f" {label}"))

    return (
        F.when(seconds >= 86400, scaled(86400, "days"))
        .when(seconds >= 3600, scaled(3600, "hours"))
        .when(seconds >= 60, scaled(60, "minutes"))
        .otherwise(F.concat(seconds.cast("string"), F.lit(" seconds")))
    )


def escaped(value: Column) -> Column:
    """Label value as it stands between quotes in the text format."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def label_text(labels: Column) -> Column:
    """``{k="v", k2="v2"}`` with sorted names, empty when there are no labels."""
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)),
        lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')),
    )
    return F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))).otherwise(F.lit(""))


def static_series_key(name: Column, labels: dict[str, Column]) -> Column:
    """``series_key`` for label names known beforehand; NULL values are left out."""
    pairs = [
        F.when(v.isNotNull(), F.concat(F.lit(f'{k}="'), escaped(v), F.lit('"'))) for k, v in sorted(labels.items())
    ]
    text = F.concat_ws(", ", *pairs)
    return F.concat(name, F.when(text != "", F.concat(F.lit("{"), text, F.lit("}"))).otherwise(F.lit("")))


def series_key(name: Column, labels: Column) -> Column:
    """Name plus sorted label pairs: the identity of a series."""
    return F.concat(name, label_text(labels))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that they are computed once per row.

    A plain column is copied into every later filter on it; the output of a generator is not.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))
