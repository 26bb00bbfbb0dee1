"""Small tables given as Python rows (configuration)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def local_table(spark: SparkSession, rows: list[tuple], schema: dict[str, str]) -> DataFrame:
    """Rows as a literal table. Spark knows its exact size, so joins with it need no hint."""
    names = list(schema)
    if not rows:
        rows, keep = [tuple([None] * len(names))], "false"
    else:
        keep = "true"
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    columns = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in schema.items())
    return spark.sql(f"SELECT {columns} FROM VALUES {values} AS t({', '.join(names)}) WHERE {keep}")
