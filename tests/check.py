"""Run named jobs beside their SQL twins in DuckDB: python tests/check.py [sf] [key ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return str(x)


def rows_of(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in idx) for r in rows)


def compare(spark, con, sf, key, fn, sql):
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(got)} rows (no SQL)"
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got == want:
        return True, f"{len(got)} rows"
    a, b = set(got), set(want)
    return False, f"{len(got)} vs {len(want)} rows; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"


def session(cpus="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("fleetgauge-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as e

    sf = f"/root/testdata/sf{argv[0] if argv else '0.001'}"
    spark, con = session(), duck(sf)
    queries, oracle = e.queries(), e.oracle_sql()
    keys = argv[1:] or list(queries)
    bad = 0
    for k in keys:
        t = time.time()
        try:
            ok, note = compare(spark, con, sf, k, queries[k], oracle.get(k))
        except Exception as x:  # report and go on with the next job
            ok, note = False, f"{type(x).__name__}: {str(x)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {k:28s} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
