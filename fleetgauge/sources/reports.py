"""Console transaction reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.functions.text import once, sanitized

HEADER = "Function"  # fixed value: first word of the table header
# A name without two blanks in a row, two blanks, five numbers.
_ROW = r"(?s)^(?:[^ ]| (?! ))*  " + " ".join([r" *-?\d+"] * 5)


def read_captures(spark: SparkSession, path: str, instance_part: str, day_part: str) -> DataFrame:
    """One row per report file: instance and day from the path, whole text."""
    file = F.col("_metadata.file_path")
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.regexp_extract(file, instance_part, 1).alias("instance"), F.regexp_extract(file, day_part, 1).alias("d"),
        F.col("value").alias("text"),
    )


def parse_captures(captures: DataFrame, ids=("instance", "d")) -> DataFrame:
    """Rows of the report table: from two lines below the header to the first line that is no row.

    A row is a name that ends at the first two blanks, and five whole numbers. All of it happens
    inside the capture's own row, so nothing is shuffled.
    """
    tail = F.expr(f"substring(text, instr(text, '{HEADER}'))")
    lines = F.split(tail, "[\\x01-\\x1f]+")
    body = F.when(F.size(lines) > 2, F.slice(lines, 3, F.size(lines) - 2)).otherwise(F.array().cast("array<string>"))
    first_bad = F.array_position(F.transform("_body", lambda line: line.rlike(_ROW)), False)
    good = F.slice("_body", F.lit(1), F.when(first_bad > 0, first_bad - 1).otherwise(F.size("_body")).cast("int"))
    rows = (
        captures.where(F.instr("text", HEADER) > 0).withColumn("_body", body)
        .select(*ids, F.explode(good).alias("line"))
    )
    numbers = ["count", "min_ms", "max_ms", "total_ms", "avg_ms"]
    # The row has passed the pattern: its parts are found by blanks; what follows the last digit is no number.
    name = F.substring_index("line", "  ", 1)
    rows = once(rows, {"_name": name, "_n": F.regexp_extract_all(F.expr("substring(line, length(substring_index(line, '  ', 1)) + 1)"), F.lit(r"(-?\d+)"), F.lit(1))})
    return rows.select(
        *ids, sanitized(F.col("_name")).alias("op"), *[F.col("_n")[i].try_cast("bigint").alias(n) for i, n in enumerate(numbers)],
    ).where("op <> ''")


def totals_by_op(report: DataFrame, ids=("instance", "d")) -> DataFrame:
    """Count and total per capture and operation; equal rows count once."""
    rows = report.select(*ids, "op", "count", "total_ms").dropDuplicates()
    return rows.groupBy(*ids, "op").agg(F.sum("count").alias("n"), F.sum("total_ms").alias("total_ms"))
