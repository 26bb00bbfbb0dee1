"""Metrics text format: reading, and rendering back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgauge.functions.text import label_text, once, series_key

_NAME = "^[a-zA-Z_:][a-zA-Z0-9_:]*"
_TAIL = r"^[ \t]+\S+(?:[ \t]+-?[0-9]+)?\s*$"  # value, and a time that is not kept
_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def _unescaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))
    out = F.replace(F.replace(out, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\u0001"), F.lit("\\"))


def label_map(body: Column) -> Column:
    """Text between the braces as a map."""
    names = F.regexp_extract_all(body, F.lit(_LABEL), F.lit(1))
    values = F.transform(F.regexp_extract_all(body, F.lit(_LABEL), F.lit(2)), _unescaped)
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, values))


def _parsed(lines: DataFrame) -> DataFrame:
    """Each line (column ``value``) taken apart once: kind (sample, HELP, TYPE or NULL), name, labels, number, text."""
    line = F.col("value")
    words = F.split(line, " ", 4)
    meta = line.startswith("# HELP ") | line.startswith("# TYPE ")
    name = F.regexp_extract(F.when(meta, words[2]).otherwise(line), _NAME, 0)
    rest = F.expr("substring(value, length(_name) + 1)")
    rows = once(lines, {"_meta": meta, "_name": name, "_words": F.when(meta, words)})
    braced = rest.startswith("{")
    rows = once(rows, {"_tail": F.when(braced, F.substring_index(rest, "}", -1)).otherwise(rest), "_braced": braced})
    body = F.expr("substring(value, length(_name) + 2, length(value) - length(_name) - length(_tail) - 2)")
    sample = ~F.col("_meta") & (F.col("_name") != "") & F.col("_tail").rlike(_TAIL)
    number = F.split(F.ltrim(F.regexp_replace("_tail", "\t", " ")), r"\s+")[0]
    rows = once(rows, {
        "labels": F.when(sample, label_map(F.when(F.col("_braced"), body).otherwise(""))),
        "_number": F.when(sample, number.try_cast("double")),
    })
    kind = F.when(F.col("_meta") & (F.col("_words")[2] == F.col("_name")) & (F.col("_name") != ""), F.col("_words")[1]).when(
        F.col("labels").isNotNull() & F.col("_number").isNotNull(), "sample")
    return rows.withColumns({"_kind": kind, "_text": F.get("_words", F.lit(3))}).withColumnRenamed("_name", "name")


def _samples(rows: DataFrame, keep: list[str]) -> DataFrame:
    rows = rows.select(*keep, "name", "labels", F.col("_number").alias("value"))
    return rows.withColumns({"series_key": series_key(F.col("name"), F.col("labels")), "op": F.col("labels")["op"]})


def parse_samples(lines: DataFrame) -> DataFrame:
    """Sample lines (column ``value``) as name, labels, series_key, op, value; other columns stay."""
    return _samples(_parsed(lines).where("_kind = 'sample'"), [c for c in lines.columns if c != "value"])


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither sample nor comment nor blank, as they came."""
    return _parsed(lines).where("_kind IS NULL AND trim(value) <> '' AND NOT startswith(value, '#')").select(*lines.columns)


def read_lines(spark: SparkSession, path: str, file_part: str = "(.*)") -> DataFrame:
    """Lines with the part of the file path that names the snapshot."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.regexp_extract("_metadata.file_path", file_part, 1).alias("file"), "value"
    )


def read_exposition(spark: SparkSession, path: str, file_part: str = "(.*)") -> DataFrame:
    """A directory of metric files as samples with the type and help of their family.

    The text is read once; a family of a file brings its own HELP and TYPE lines along."""
    rows = _parsed(read_lines(spark, path, file_part)).where("_kind IS NOT NULL")
    family = Window.partitionBy("file", "name")
    for kind in ("TYPE", "HELP"):
        rows = rows.withColumn(kind.lower(), F.max(F.when(F.col("_kind") == kind, F.col("_text"))).over(family))
    out = _samples(rows.where("_kind = 'sample'"), ["file", "type", "help"])
    return out.select(
        "file", "name", F.coalesce("type", F.lit("untyped")).alias("type"), F.coalesce("help", F.lit("")).alias("help"),
        "series_key", "op", "value",
    )


def render(samples: DataFrame, families: DataFrame, scope: list[str]) -> DataFrame:
    """Samples as text lines per file and family: HELP, TYPE, then the samples by labels.

    ``samples``: scope, name, labels, value_text. ``families``: name, family_no, type, help.
    A text file holds one snapshot of one server, so line numbers restart in each (file, family).
    """
    text = F.concat(F.col("name"), F.col("_labels"), F.lit(" "), F.col("value_text"))
    order = Window.partitionBy(*scope, "name").orderBy("_labels", "value_text")
    body = samples.withColumn("_labels", label_text(F.col("labels"))).select(
        *scope, "name", (F.row_number().over(order) + 2).alias("line_no"), text.alias("line")
    )
    heads = samples.select(*scope, "name").distinct().join(families, "name").select(
        *scope, "name", "family_no",
        F.explode(F.array(
            F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("# HELP "), "name", F.lit(" "), "help").alias("line")),
            F.struct(F.lit(2).alias("line_no"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "type").alias("line")),
        )).alias("h"),
    )
    body = body.join(families.select("name", "family_no"), "name").select(
        *scope, "family_no", F.col("name").alias("family"), "line_no", "line"
    )
    heads = heads.select(*scope, "family_no", F.col("name").alias("family"), "h.line_no", "h.line")
    return heads.unionByName(body)


def write_exposition(lines: DataFrame, path: str, scope: list[str]) -> None:
    """One folder per snapshot (``a=../b=..``), its lines in order in one file."""
    (
        lines.repartition(*scope).sortWithinPartitions(*scope, "family_no", "line_no")
        .select(*scope, F.col("line").alias("value"))
        .write.partitionBy(*scope).text(path)
    )
