"""Access logs and plain logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgauge.functions.text import once, static_series_key

# The fields taken from a log line; others are dropped.
FIELDS = {"time": "string", "status": "int", "method": "string", "uri": "string", "request_time": "decimal(12,3)"}


def parse_access_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON fields of each line; a line that is no JSON object is kept and flagged ``corrupt``.

    Fields are read as text and cast one by one, so quoted numbers count and one bad field spoils no other.
    """
    schema = ", ".join(f"{n} STRING" for n in FIELDS) + ", _corrupt STRING"
    parsed = F.from_json(line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = once(lines, {"_j": parsed})
    bad = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull()
    return rows.withColumns({
        **{n: F.when(~bad, F.col(f"_j.{n}").try_cast(kind)) for n, kind in FIELDS.items()}, "corrupt": bad,
    }).drop("_j")


def log_times(logs: DataFrame, time: str = "time") -> DataFrame:
    """RFC 3339 text to microseconds (``ts_us``), whatever the session zone."""
    zoned = F.col(time).rlike(r"\d([Zz]|[+-]\d{2}:\d{2})$")  # the text names its own zone
    return logs.withColumn("ts_us", F.when(zoned, F.unix_micros(F.upper(time).try_cast("timestamp"))))


def json_fields(lines: DataFrame) -> DataFrame:
    """event_id, instant, uri and request time in thousandths of each readable line."""
    rows = log_times(parse_access_log(lines)).where("NOT corrupt")
    return rows.select("event_id", "ts_us", "uri", (F.col("request_time") * 1000).cast("bigint").alias("request_ms"))


def promote_labels(logs: DataFrame, job: str, namespace: str, pod: str) -> DataFrame:
    """Method and status become labels beside the static job, namespace and pod."""
    return logs.withColumn("series_key", static_series_key(F.lit(""), {
        "job": F.lit(job), "namespace": F.lit(namespace), "pod": F.lit(pod),
        "method": F.col("method"), "status": F.col("status").cast("string"),
    }))


def read_log(spark: SparkSession, path: str, job: str, file_part: str = "([^/]+)$") -> DataFrame:
    """Plain lines with the static job label; lines are numbered within their file, whose path ``file_part`` shortens.

    The number comes from the order of a line within the file's own splits, counted per split
    and shifted by the lines of the splits before, so that no file lands in one task whole.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        meta.file_path.alias("path"), meta.file_block_start.alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    inside = Window.partitionBy("path", "block").orderBy("at")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").count().select(
        "path", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    return lines.withColumn("_row", F.row_number().over(inside)).join(blocks, ["path", "block"]).select(
        F.lit(job).alias("job"), F.regexp_extract("path", file_part, 1).alias("file"), (F.col("_before") + F.col("_row")).alias("line_no"), F.col("value").alias("line")
    )
