"""Text formats, logs, published tables and thinning."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.constants import DAY, HOUR, TRANS_PREFIX
from fleetgauge.functions.local import local_table
from fleetgauge.functions.text import milli_text, whole_div
from fleetgauge.operators import expiry as ep
from fleetgauge.operators import labels as lb
from fleetgauge.operators import store as st
from fleetgauge.operators import thinning as th
from fleetgauge.plans import views as v
from fleetgauge.plans.registry import job
from fleetgauge.plans.stat_jobs import milli_text_sql
from fleetgauge.sources import exposition as ex
from fleetgauge.sources import logs as lg
from fleetgauge.sources import prom as pm
from fleetgauge.sources import reports as rp
from fleetgauge.workdir import fresh_dir

COUNT, TOTAL = f"{TRANS_PREFIX}_count", f"{TRANS_PREFIX}_total_seconds"
# Families of the transaction file, in file order.
FAMILIES = [
    (COUNT, 1, "counter", "Transaction count"),
    (TOTAL, 2, "counter", "Total transaction time in seconds"),
]
SCOPE = ["instance", "d"]
FILE_PART = "(instance=[^/]+/d=[^/]+)/"


def families(spark):
    return local_table(spark, FAMILIES, {"name": "string", "family_no": "int", "type": "string", "help": "string"})


def trans_samples(spark, sf):
    """Transaction counters of each server and day as labelled samples."""
    rows = v.trans_report(spark, sf).select(
        "instance", "d", F.create_map(F.lit("op"), F.col("op")).alias("labels"),
        F.explode(F.array(
            F.struct(F.lit(COUNT).alias("name"), F.col("n").cast("string").alias("value_text")),
            F.struct(F.lit(TOTAL).alias("name"), milli_text(F.col("total")).alias("value_text")),
        )).alias("s"),
    )
    return rows.select("instance", "d", "s.name", "labels", "s.value_text")


def trans_lines(spark, sf):
    return ex.render(trans_samples(spark, sf), families(spark), SCOPE)


SAMPLES = {"texts": f"""
    SELECT instance, d, 1 AS family_no, '{COUNT}' AS name, op, CAST(n AS VARCHAR) AS value_text FROM trans_report
    UNION ALL SELECT instance, d, 2, '{TOTAL}', op, {milli_text_sql('total')} FROM trans_report"""}
HEAD = f"""SELECT DISTINCT instance, d, family_no, name AS family, k AS line_no,
      CASE k WHEN 1 THEN concat('# HELP ', name, CASE family_no WHEN 1 THEN ' {FAMILIES[0][3]}' ELSE ' {FAMILIES[1][3]}' END)
        ELSE concat('# TYPE ', name, ' counter') END AS line FROM texts, (SELECT unnest([1, 2]) AS k)"""
RENDERED = {**SAMPLES, "lines": f"""{HEAD} UNION ALL
    SELECT instance, d, family_no, name, 2 + row_number() OVER (PARTITION BY instance, d, name ORDER BY op),
      concat(name, '{{op="', op, '"}} ', value_text) FROM texts"""}


@job("snk_exposition_text", "SELECT instance, d, family, line_no, line FROM lines", "trans_report", RENDERED)
def snk_exposition_text(spark, sf):
    return trans_lines(spark, sf).drop("family_no")


@job("so_render_order", "SELECT instance, d, family_no, line_no, line FROM lines ORDER BY ALL", "trans_report", RENDERED)
def so_render_order(spark, sf):
    rows = trans_lines(spark, sf).select("instance", "d", "family_no", "line_no", "line")
    return rows.orderBy("instance", "d", "family_no", "line_no")


@job("src_exposition_text", f"""
    SELECT concat('instance=', instance, '/d=', d) AS file, name, 'counter' AS type,
      CASE family_no WHEN 1 THEN '{FAMILIES[0][3]}' ELSE '{FAMILIES[1][3]}' END AS help,
      concat(name, '{{op="', op, '"}}') AS series_key, op, CAST(value_text AS DOUBLE) AS value FROM texts""", "trans_report", SAMPLES)
def src_exposition_text(spark, sf):
    path = fresh_dir(spark, "metrics")
    ex.write_exposition(trans_lines(spark, sf), path, SCOPE)
    return ex.read_exposition(spark, path, FILE_PART)


@job("src_prom_format", f"""
    SELECT concat('instance=', instance, '/d=', d) AS file, name, 'counter' AS type, '{FAMILIES[1][3]}' AS help,
      concat(name, '{{op="', op, '"}}') AS series_key, op, CAST(value_text AS DOUBLE) AS value FROM texts WHERE family_no = 2""",
     "trans_report", SAMPLES)
def src_prom_format(spark, sf):
    path = fresh_dir(spark, "metrics")
    ex.write_exposition(trans_lines(spark, sf), path, SCOPE)
    return pm.read_samples(spark, path, [TOTAL], FILE_PART)


@job("se_union_distinct", f"""
    SELECT concat(name, '{{op="', op, '"}} ', value_text) AS line FROM texts WHERE family_no = 1
    UNION SELECT concat(name, '{{op="', op, '"}} ', value_text) FROM texts WHERE family_no = 2""", "trans_report", SAMPLES)
def se_union_distinct(spark, sf):
    rows = trans_lines(spark, sf).where("line_no > 2")
    return lb.union_distinct(rows.where("family_no = 1").select("line"), rows.where("family_no = 2").select("line"))


def captures(spark, sf):
    """Console captures built from the daily totals: title, header, ruler, rows, a bad row, a stray row."""
    row = F.concat_ws("  ", F.concat(F.lit("DB "), "op"), "n", "lo", "hi", "total", F.expr("total div n"))
    return (
        v.trans_report(spark, sf).groupBy("instance", "d")
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))  # one entry per operation
        .select("instance", "d", F.concat(
            F.lit("> show trans\r\nFunction   Count  Min  Max  Total  Average\r\n\r\n-----------------\r\n"),
            F.array_join("rows", "\r\n"), F.lit("\r\nTotal  n/a\r\nSTRAY  1  1  1  1  1\r\n"),
        ).alias("text"))
    )


REPORT = "SELECT instance, d, concat('DB_', op) AS op, n AS count, lo AS min_ms, hi AS max_ms, total AS total_ms, total // n AS avg_ms FROM trans_report"


@job("src_trans_report", REPORT, "trans_report")
def src_trans_report(spark, sf):
    path = fresh_dir(spark, "captures")
    captures(spark, sf).write.partitionBy("instance", "d").option("lineSep", "\u0000").text(path)
    return rp.parse_captures(rp.read_captures(spark, path, "instance=([^/]+)", "d=([^/]+)"))


@job("ag_trans_by_op", "SELECT instance, d, concat('DB_', op) AS op, n, total AS total_ms FROM trans_report", "trans_report")
def ag_trans_by_op(spark, sf):
    rows = rp.parse_captures(captures(spark, sf))
    return rp.totals_by_op(rows.unionByName(rows.where("count > 5")))  # rows shown twice count once


# --- logs --------------------------------------------------------------------------------


@job("src_access_log_json", """
    SELECT event_id, corrupt, CASE WHEN NOT corrupt THEN strftime(make_timestamp(time_us), '%Y-%m-%dT%H:%M:%SZ') END AS time,
      CASE WHEN NOT corrupt THEN status END AS status, CASE WHEN NOT corrupt THEN method END AS method,
      CASE WHEN NOT corrupt THEN uri END AS uri, CASE WHEN NOT corrupt THEN request_ms END AS request_ms FROM logs""", "logs")
def src_access_log_json(spark, sf):
    rows = lg.parse_access_log(v.loglines(spark, sf))
    return rows.select("event_id", "corrupt", "time", "status", "method", "uri",
                       (F.col("request_time") * 1000).cast("bigint").alias("request_ms"))


@job("prj_json_fields", "SELECT event_id, time_us AS ts_us, uri, request_ms FROM logs WHERE NOT corrupt", "logs")
def prj_json_fields(spark, sf):
    return lg.json_fields(v.loglines(spark, sf))


@job("prj_promote_labels", f"""
    SELECT event_id, CASE WHEN corrupt THEN '{{job="{v.JOB}", namespace="web", pod="proxy-1"}}'
      ELSE concat('{{job="{v.JOB}", method="', method, '", namespace="web", pod="proxy-1", status="', status, '"}}') END AS series_key, line
    FROM logs""", "logs")
def prj_promote_labels(spark, sf):
    rows = lg.parse_access_log(v.loglines(spark, sf))
    return lg.promote_labels(rows, v.JOB, "web", "proxy-1").select("event_id", "series_key", "line")


@job("src_log_tail", f"""
    SELECT '{v.JOB}' AS job, concat('d=', CAST(CAST(ts AS DATE) AS VARCHAR)) AS file,
      row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS line_no, line
    FROM loglines JOIN events USING (event_id)""", "loglines")
def src_log_tail(spark, sf):
    path = fresh_dir(spark, "log")
    day = F.date_add(F.lit("1970-01-01").cast("date"), whole_div(F.col("ts_us"), DAY).cast("int"))
    lines = v.loglines(spark, sf).withColumn("d", day).repartition("d").sortWithinPartitions("d", "event_id")
    lines.select("d", F.col("line").alias("value")).write.partitionBy("d").text(path)
    return lg.read_log(spark, path, v.JOB, "(d=[^/]+)/")


# --- tables ------------------------------------------------------------------------------


@job("snk_snapshot_publish", "SELECT instance, op, d, n, total FROM trans_report", "trans_report")
def snk_snapshot_publish(spark, sf):
    path = fresh_dir(spark, "snapshots")
    rows = v.trans_report(spark, sf).select("instance", "op", "d", "n", "total")
    st.publish(rows.where("n > 1"), path)  # an older version that readers no longer see
    st.publish(rows, path)
    return st.read_published(spark, path)


KEEP_DAYS, KEEP_BYTES = 20, 600_000


@job("snk_retention", f"""
    SELECT day, bytes, day >= {v.TO_US // DAY - KEEP_DAYS} AND sum(bytes) OVER (ORDER BY day DESC) <= {KEEP_BYTES} AS keep
    FROM (SELECT epoch_us(ts) // {DAY} AS day, CAST(sum(strlen(line)) AS BIGINT) AS bytes
          FROM loglines JOIN events USING (event_id) GROUP BY ALL)""", "loglines")
def snk_retention(spark, sf):
    sizes = v.loglines(spark, sf).select(F.octet_length("line").cast("bigint").alias("bytes"), whole_div(F.col("ts_us"), DAY).alias("day"))
    return st.retention(sizes, v.TO_US // DAY, KEEP_DAYS, KEEP_BYTES)


@job("snk_retention_drop", f"""
    SELECT event_id, day, line FROM (
      SELECT event_id, epoch_us(ts) // {DAY} AS day, line, epoch_us(ts) // {DAY} >= {v.TO_US // DAY - KEEP_DAYS} AND
        sum(strlen(line)) OVER (ORDER BY epoch_us(ts) // {DAY} DESC RANGE UNBOUNDED PRECEDING) <= {KEEP_BYTES} AS keep
      FROM loglines JOIN events USING (event_id)) WHERE keep""", "loglines")
def snk_retention_drop(spark, sf):
    path = fresh_dir(spark, "retention")
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    rows = v.loglines(spark, sf).select("event_id", "line", whole_div(F.col("ts_us"), DAY).alias("day"))
    kept = ep.create(rows, table, path)
    sizes = kept.select("day", F.octet_length("line").cast("bigint").alias("bytes"))
    ep.retire(spark, table, st.retention(sizes, v.TO_US // DAY, KEEP_DAYS, KEEP_BYTES), v.TO_US)
    ep.purge(spark, table, v.TO_US)
    return spark.table(table).select("event_id", "day", "line")


LATEST_SQL = """
    WITH u AS (SELECT concat(facility, '/', snapshot % 7) AS package, stat AS name, ts_us, event_id,
        CASE WHEN event_id % 11 <> 0 THEN value_milli END AS value, event_id % 50 = 3 AS wipe FROM stats WHERE facility IS NOT NULL),
      d AS (SELECT package, max(ts_us) AS ts_us FROM u WHERE wipe GROUP BY ALL)
    SELECT package, name, value FROM (SELECT * FROM u WHERE NOT wipe
      QUALIFY row_number() OVER (PARTITION BY package, name ORDER BY ts_us DESC, event_id DESC) = 1) l
    LEFT JOIN d USING (package) WHERE value IS NOT NULL AND (d.ts_us IS NULL OR l.ts_us > d.ts_us)""".replace("WITH u", ", u", 1)


def _updates(spark, sf):
    """Updates and package deletes."""
    rows = v.stats(spark, sf).where("facility IS NOT NULL").select(
        F.concat("facility", F.lit("/"), (F.col("snapshot") % 7).cast("string")).alias("package"), F.col("stat").alias("name"),
        F.when(F.col("event_id") % 11 != 0, F.col("value_milli")).alias("value"), "ts_us", "event_id",
    )
    wipe = F.col("event_id") % 50 == 3
    return rows.where(~wipe), rows.where(wipe).select("package", "ts_us", "event_id")


@job("snk_latest_state", LATEST_SQL, "stats")
def snk_latest_state(spark, sf):
    return st.latest_state(*_updates(spark, sf))


@job("snk_state_upsert", LATEST_SQL, "stats")
def snk_state_upsert(spark, sf):
    updates, deletes = _updates(spark, sf)
    path = fresh_dir(spark, "state")
    name, state = path.rsplit("/", 1)[-1].replace("-", "_"), None
    for part in range(3):  # batches in no order of time
        batch, table = updates.where(F.col("event_id") % 3 == part), f"{name}_{part}"
        state = st.start_state(batch, table, f"{path}/{part}", 8) if state is None else st.upsert(state, batch, table, f"{path}/{part}", 8)
    return st.current(state, deletes)


THIN = 3 * HOUR
THIN_SQL = {
    "kept": f"""
        SELECT instance, op, min(ts_us) AS ts_us FROM counters GROUP BY ALL
        UNION ALL
        SELECT k.instance, k.op, min(c.ts_us) FROM kept k JOIN counters c
          ON c.instance = k.instance AND c.op = k.op AND c.ts_us >= k.ts_us + {THIN} GROUP BY ALL"""}


@job("wn_due_thinning", "SELECT instance, op, ts_us, event_id FROM kept JOIN counters USING (instance, op, ts_us)", "counters", THIN_SQL)
def wn_due_thinning(spark, sf):
    samples = v.gauges(spark, sf)
    return th.due_thinning(samples, THIN)
