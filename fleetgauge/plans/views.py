"""The monitoring data model filled from the driver tables.

Each input table exists twice: as a Spark DataFrame built here, and as a SQL view text used
only by the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.constants import DAY, DISK_COMPONENTS, HOUR, MINUTE
from fleetgauge.functions.local import local_table
from fleetgauge.functions.scan import ordered_scan, running_sum
from fleetgauge.functions.text import epoch_us
from fleetgauge.operators.filters import time_range

JOB = "fleet"
FROM_US = 1_704_067_200_000_000  # 2024-01-01, start of the data range
TO_US = FROM_US + 30 * DAY
AT_US = FROM_US + 15 * DAY + 12 * HOUR
BACKUP_FACILITY = "ServerBackup"

# (instance, weekday 0=Sunday, business day, start, end, zone, dst); srv0 has the feature off.
_WORK = {1, 2, 3, 4, 5}
CALENDAR = (
    [("srv1", d, d in _WORK, 6 * 3600, 18 * 3600, 0, 0) for d in range(7)]
    + [("srv2", d, d in _WORK, 6 * 3600, (13 if d == 5 else 18) * 3600, 0, 0) for d in range(7)]
    + [("srv3", d, d in {5, 6, 0, 1}, 22 * 3600, 6 * 3600, 0, 0) for d in range(7)]
    + [("srv4", d, d in _WORK, 6 * 3600 + 1800, 18 * 3600, -1, 1) for d in range(7)]
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def server(of: str = "user_id"):
    return F.concat(F.lit("srv"), F.expr(f"{of} % 5"))


def milli():
    return F.round(F.col("value") * 1000).cast("bigint")


def events(spark, sf) -> DataFrame:
    return timed(table(spark, sf, "events"))


def timed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"ts_us": epoch_us("ts"), "instance": server()})


def extent(spark, sf) -> tuple[int, int]:
    """The days of the events, midnight to midnight; of no events, the first day of all."""
    first, last = table(spark, sf, "events").select(epoch_us("ts").alias("t")).agg(F.min("t"), F.max("t")).first()
    return (0, DAY) if first is None else (first // DAY * DAY, (last // DAY + 1) * DAY)


def counters(spark, sf) -> DataFrame:
    rows = events(spark, sf).select(
        "event_id", F.lit(JOB).alias("job"), "instance", F.col("event_type").alias("op"), "ts_us",
        F.to_date("ts").alias("day"), milli().alias("m"),
    )
    scans = [running_sum(F.lit(1).cast("bigint"), "count_total"), running_sum("m", "ms_total")]
    return ordered_scan(rows, ["instance", "op", "day"], ["ts_us", "event_id"], scans).drop("day", "m")


def up(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        "event_id", "instance", "ts_us", F.when(F.col("event_type") == "error", 0).otherwise(1).cast("bigint").alias("value")
    )


def gauges(spark, sf, from_us: int | None = None, to_us: int | None = None) -> DataFrame:
    """Response time samples in thousandths, one series per server and op; of a stretch of time, if given."""
    rows = table(spark, sf, "events")
    if from_us is not None:
        rows = time_range(rows, from_us, to_us, "ts")
    return timed(rows).select(
        "event_id", F.lit(JOB).alias("job"), "instance", F.col("event_type").alias("op"), "ts_us", milli().alias("value")
    )


def catalog(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("note_id"),
        F.expr("CASE WHEN p_partkey % 50 = 49 THEN 'Event' ELSE 'Statistic' END").alias("form"),
        F.concat("p_brand", F.lit("."), "p_type").alias("stat_name"),
        F.concat(F.lit("  "), "p_name", F.lit("   of size ")).alias("description"),
        F.when(F.col("p_size") % 2 == 0, "Bytes").otherwise("").alias("units"),
    )


STAT_NAMES = ["ECONOMY", "Economy", "SMALL", "Disk./.Free", "a.b c", "a_b c"]
STAT_TYPES = ["LONG", "NUMBER", "TEXT", "TIMEDATE"]
STAT_TEXTS = ["Successful", "Failed at 10", "S0000123.TXN"]


def cycle(by: str, values: list) -> F.Column:
    return F.expr(f"array({', '.join('NULL' if v is None else repr(v) for v in values)})[CAST({by} % {len(values)} AS INT)]")


def stats(spark, sf) -> DataFrame:
    """Typed statistics; facility is NULL on some rows."""
    return as_stats(events(spark, sf))


def as_stats(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id", "ts_us", F.expr("ts_us div 86400000000").alias("snapshot"), "instance",
        F.when(F.col("event_id") % 97 != 0, F.concat(F.lit("Brand#"), F.expr("user_id % 25 + 1"))).alias("facility"),
        cycle("event_id", STAT_NAMES).alias("stat"),
        F.when(F.col("event_id") % 89 == 0, "OTHER").otherwise(cycle("event_id", STAT_TYPES)).alias("vtype"),
        (milli() - 50000).alias("value_milli"),
        (F.col("value") - 50.0).alias("value_number"),
        cycle("event_id", STAT_TEXTS).alias("value_text"),
    )


def mail(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        F.col("event_id").alias("note_id"), "instance",
        cycle("user_id", ["mail1.box", "mail2.box", "mail3.box"]).alias("mailbox"),
        F.col("ts_us").alias("added_us"),
        F.expr("CASE event_type WHEN 'view' THEN 'L' WHEN 'click' THEN 'H' ELSE 'N' END").alias("delivery_priority"),
        (F.col("event_type") == "signup").alias("has_send_at"),
    )


def trans_report(spark, sf, from_us: int | None = None, to_us: int | None = None) -> DataFrame:
    rows = table(spark, sf, "events")
    if from_us is not None:
        rows = time_range(rows, from_us, to_us, "ts")
    return (
        rows
        .groupBy(server().alias("instance"), F.upper("event_type").alias("op"), F.to_date("ts").cast("string").alias("d"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(milli()).alias("total"),
             F.min(milli()).alias("lo"), F.max(milli()).alias("hi"))
    )


def maint(spark, sf) -> DataFrame:
    rows = events(spark, sf).where("event_type = 'error'")
    return rows.select(
        F.col("event_id").alias("window_id"), "instance", F.col("ts_us").alias("start_us"),
        F.expr(f"CASE WHEN user_id % 5 = 4 AND event_id % 7 = 0 THEN NULL ELSE ts_us + {30 * MINUTE} END").alias("end_us"),
    )


MAINT_COMMANDS = ["on 30", "end +60", "start +10", "off", "on", "bogus"]


def maint_commands(spark, sf) -> DataFrame:
    rows = events(spark, sf).where("event_type = 'error'")
    iso = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
    later = "date_format(ts + INTERVAL 2 HOURS, 'yyyy-MM-dd HH:mm:ss')"
    return rows.select(
        "instance", F.col("event_id").alias("seq"), "ts_us",
        F.when(F.col("event_id") % 31 == 0, F.expr(f"concat('start ', {later})"))
        .when(F.col("event_id") % 37 == 0, F.expr(f"concat('end ', {iso})"))
        .when(F.col("event_id") % 41 == 0, F.lit("start soon"))
        .when(F.col("event_id") % 43 == 0, F.lit("CLEAR"))
        .otherwise(cycle("event_id", MAINT_COMMANDS)).alias("cmd"),
    )


def txn(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("srv"), F.expr("l_suppkey % 5")).alias("instance"),
        F.expr(
            "CASE l_linenumber WHEN 7 THEN 'nlogctrl.lfh' WHEN 6 THEN concat('X', l_orderkey, '.TXN') "
            "WHEN 5 THEN concat('S', lpad(CAST(l_orderkey AS STRING), 7, '0'), '.txn') "
            "ELSE concat('S', lpad(CAST(l_orderkey AS STRING), 7, '0'), '.TXN') END"
        ).alias("filename"),
    )


def disks(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.concat(F.lit("srv"), F.expr("p_partkey % 5")).alias("instance"),
        cycle("p_partkey", DISK_COMPONENTS).alias("component"),
        F.expr("CASE WHEN p_partkey % 61 = 0 THEN '' ELSE concat('/local/', p_partkey) END").alias("path"),
        F.expr("CAST(round(p_retailprice * 1048576) AS BIGINT)").alias("total_bytes"),
        F.expr("CAST(round(p_retailprice * 1048576) AS BIGINT) div 3").alias("free_bytes"),
    )


def probes(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        "event_id", "instance", "ts_us",
        cycle("event_id", [None, "RESTRICTED", "UNAVAILABLE", "OTHER"]).alias("ping_err"),
        F.expr("CAST(event_id % 500 AS INT)").alias("ping_ms"),
        F.expr("CASE WHEN event_id % 20 = 8 THEN 'OTHER' END").alias("open_err"),
        F.expr("CAST(event_id % 700 AS INT)").alias("open_ms"),
    )


def loglines(spark, sf) -> DataFrame:
    """JSON access-log lines; some are cut off."""
    line = F.expr(
        """concat('{"time":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","remote_addr":"10.0.0.1","status":',
           CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '201' ELSE '200' END,
           ',"method":"', CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END, '","uri":"/u/', user_id,
           '","request_time":', CAST(CAST(value AS DECIMAL(12,3)) AS STRING), '}')"""
    )
    return events(spark, sf).select(
        "event_id", "ts_us", F.when(F.col("event_id") % 53 == 0, F.substring(line, 1, 40)).otherwise(line).alias("line")
    )


def backup_stats(spark, sf) -> DataFrame:
    names = [
        "LastBackup.DB.Status", "LastBackup.TL.Status", "LastBackup.TL.LastLogExtend",
        "lastbackup.db.time", "LastBackup.TL.Time", "Time.Start", "Other",
    ]
    rows = events(spark, sf).withColumn("stat", cycle("event_id", names))
    return rows.select(
        "event_id", "instance",
        F.when(F.col("stat") == "Time.Start", "Server").otherwise(BACKUP_FACILITY).alias("facility"), "stat",
        F.when(F.col("event_id") % 7 < 3, "TEXT").otherwise("TIMEDATE").alias("vtype"),
        cycle("event_id", STAT_TEXTS).alias("value_text"), F.col("ts_us").alias("value_us"),
    )


def server_config(spark, sf) -> DataFrame:
    """One configuration row per server."""
    return table(spark, sf, "customer").select(
        F.concat(F.lit("srv"), "c_custkey").alias("instance"),
        F.expr("c_custkey % 4 <> 3").alias("calendar_on"),
        cycle("c_custkey", ["1-5", "1,2,3", "1-5,0", "5-1", "7", "0-6", "1,x,3", None, "2-9,4", ",6,,"]).alias("days"),
        cycle("c_custkey", ["6-18", "06:00-18:00", "06:30:00-18:00:15", "22-6", None, "soon", "06:00-13:30"]).alias("hours"),
        F.expr("CAST(c_custkey % 3 % 2 AS INT)").alias("store_on"),
        F.expr("CAST(c_custkey % 3 AS INT)").alias("log_style"), F.expr("CAST(c_custkey % 2 AS INT)").alias("restricted"),
        F.expr("CAST(c_nationkey % 6 AS INT)").alias("store_catalog_status"),
    )


def server_hours(spark, sf) -> DataFrame:
    """Per-weekday overrides of the business hours."""
    rows = table(spark, sf, "customer").where("c_custkey % 2 = 0")
    return rows.select(
        F.concat(F.lit("srv"), "c_custkey").alias("instance"), F.expr("CAST(c_custkey % 7 AS INT)").alias("weekday"),
        F.when(F.col("c_custkey") % 3 == 0, "6-13").otherwise("08:15-12:45").alias("hours"),
    )


def calendar(spark) -> DataFrame:
    return local_table(spark, CALENDAR, {
        "instance": "string", "weekday": "int", "is_business_day": "boolean", "start_s": "int", "end_s": "int",
        "zone": "int", "dst": "int",
    })


def targets(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.lit(JOB).alias("job"), F.concat(F.lit("srv"), "n_nationkey").alias("instance"),
        F.col("n_name").alias("pod"), F.col("r_name").alias("namespace"),
    )


def evals(spark, sf) -> DataFrame:
    """Rule evaluations of the down rule: true where the target did not answer."""
    return as_evals(events(spark, sf))


def as_evals(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "instance", "ts_us", (F.col("event_type") == "error").alias("active"))


def alert_evals(spark, sf) -> DataFrame:
    """Evaluations of both rules of one alert: critical while down, warning while slow."""
    e = events(spark, sf).select("event_id", "instance", "ts_us", "event_type", milli().alias("m"))
    return e.select(
        "event_id", "instance", "ts_us",
        F.explode(F.array(
            F.struct(F.lit("critical").alias("severity"), (F.col("event_type") == "error").alias("active")),
            F.struct(F.lit("warning").alias("severity"), (F.col("m") > 60000).alias("active")),
        )).alias("r"),
    ).select("event_id", "instance", "ts_us", "r.severity", "r.active")


def alerts(spark, sf) -> DataFrame:
    """Alert intervals: down episodes are critical, slow episodes are warnings of the same name."""
    from fleetgauge.operators.alerts import alert_episodes

    both = alert_evals(spark, sf)
    ep = alert_episodes(both, for_us=0, keys=["instance", "severity"])
    return ep.select(
        F.concat_ws(":", "severity", "instance", "active_at").alias("alert_id"),
        F.lit("ServerSlowOrDown").alias("alertname"), "severity", "instance",
        F.expr("CASE WHEN instance IN ('srv0', 'srv1') THEN 'c1' WHEN instance = 'srv2' THEN 'c2' END").alias("cluster"),
        F.expr("CASE WHEN severity = 'critical' THEN 'mail' END").alias("service"),
        F.col("active_at").alias("starts_us"), F.col("resolved_at").alias("ends_us"),
    )


def _cyc(by: str, values: list) -> str:
    items = " ".join(f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for i, v in enumerate(values))
    return f"CASE {by} % {len(values)} {items} END"


_ISO = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_SRV = "concat('srv', user_id % 5)"
_MILLI = "CAST(round(value*1000) AS BIGINT)"
_DAY = "PARTITION BY user_id % 5, event_type, CAST(ts AS DATE) ORDER BY ts, event_id"
_NAMES = ["LastBackup.DB.Status", "LastBackup.TL.Status", "LastBackup.TL.LastLogExtend", "lastbackup.db.time",
          "LastBackup.TL.Time", "Time.Start", "Other"]

# name -> (views it needs, SQL)
SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "extent": ([], f"""
        SELECT epoch_us(min(ts)) // {DAY} * {DAY} AS low, (epoch_us(max(ts)) // {DAY} + 1) * {DAY} AS high FROM events"""),
    "counters": ([], f"""
        SELECT event_id, '{JOB}' AS job, {_SRV} AS instance, event_type AS op, epoch_us(ts) AS ts_us,
          CAST(row_number() OVER w AS BIGINT) AS count_total,
          CAST(sum({_MILLI}) OVER ({_DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ms_total
        FROM events WINDOW w AS ({_DAY})"""),
    "up": ([], f"""
        SELECT event_id, {_SRV} AS instance, epoch_us(ts) AS ts_us,
          CAST(CASE WHEN event_type='error' THEN 0 ELSE 1 END AS BIGINT) AS value FROM events"""),
    "gauges": ([], f"""
        SELECT event_id, '{JOB}' AS job, {_SRV} AS instance, event_type AS op, epoch_us(ts) AS ts_us, {_MILLI} AS value
        FROM events"""),
    "catalog": ([], """
        SELECT p_partkey AS note_id, CASE WHEN p_partkey % 50 = 49 THEN 'Event' ELSE 'Statistic' END AS form,
          concat(p_brand, '.', p_type) AS stat_name, concat('  ', p_name, '   of size ') AS description,
          CASE WHEN p_size % 2 = 0 THEN 'Bytes' ELSE '' END AS units FROM part"""),
    "stats": ([], f"""
        SELECT event_id, epoch_us(ts) AS ts_us, epoch_us(ts) // 86400000000 AS snapshot, {_SRV} AS instance,
          CASE WHEN event_id % 97 <> 0 THEN concat('Brand#', user_id % 25 + 1) END AS facility,
          {_cyc('event_id', STAT_NAMES)} AS stat,
          CASE WHEN event_id % 89 = 0 THEN 'OTHER' ELSE {_cyc('event_id', STAT_TYPES)} END AS vtype,
          {_MILLI} - 50000 AS value_milli, value - 50.0::DOUBLE AS value_number,
          {_cyc('event_id', STAT_TEXTS)} AS value_text FROM events"""),
    "mail": ([], """
        SELECT event_id AS note_id, concat('srv', user_id % 5) AS instance, concat('mail', user_id % 3 + 1, '.box') AS mailbox, epoch_us(ts) AS added_us,
          CASE event_type WHEN 'view' THEN 'L' WHEN 'click' THEN 'H' ELSE 'N' END AS delivery_priority,
          event_type = 'signup' AS has_send_at FROM events"""),
    "trans_report": ([], f"""
        SELECT {_SRV} AS instance, upper(event_type) AS op, CAST(CAST(ts AS DATE) AS VARCHAR) AS d,
          count(*) AS n, CAST(sum({_MILLI}) AS BIGINT) AS total, min({_MILLI}) AS lo, max({_MILLI}) AS hi
        FROM events GROUP BY ALL"""),
    "maint": ([], f"""
        SELECT event_id AS window_id, {_SRV} AS instance, epoch_us(ts) AS start_us,
          CASE WHEN user_id % 5 = 4 AND event_id % 7 = 0 THEN NULL ELSE epoch_us(ts) + {30 * MINUTE} END AS end_us
        FROM events WHERE event_type='error'"""),
    "maint_commands": ([], f"""
        SELECT {_SRV} AS instance, event_id AS seq, epoch_us(ts) AS ts_us,
          CASE WHEN event_id % 31 = 0 THEN concat('start ', strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S'))
               WHEN event_id % 37 = 0 THEN concat('end ', {_ISO})
               WHEN event_id % 41 = 0 THEN 'start soon' WHEN event_id % 43 = 0 THEN 'CLEAR'
               ELSE {_cyc('event_id', MAINT_COMMANDS)} END AS cmd
        FROM events WHERE event_type='error'"""),
    "txn": ([], """
        SELECT concat('srv', l_suppkey % 5) AS instance,
          CASE l_linenumber WHEN 7 THEN 'nlogctrl.lfh' WHEN 6 THEN concat('X', l_orderkey, '.TXN')
            WHEN 5 THEN concat('S', lpad(CAST(l_orderkey AS VARCHAR),7,'0'), '.txn')
            ELSE concat('S', lpad(CAST(l_orderkey AS VARCHAR),7,'0'), '.TXN') END AS filename FROM lineitem"""),
    "disks": ([], f"""
        SELECT concat('srv', p_partkey % 5) AS instance, {_cyc('p_partkey', DISK_COMPONENTS)} AS component,
          CASE WHEN p_partkey % 61 = 0 THEN '' ELSE concat('/local/', p_partkey) END AS path,
          CAST(round(p_retailprice * 1048576) AS BIGINT) AS total_bytes,
          CAST(round(p_retailprice * 1048576) AS BIGINT) // 3 AS free_bytes FROM part"""),
    "probes": ([], f"""
        SELECT event_id, {_SRV} AS instance, epoch_us(ts) AS ts_us,
          {_cyc('event_id', [None, 'RESTRICTED', 'UNAVAILABLE', 'OTHER'])} AS ping_err,
          CAST(event_id % 500 AS INT) AS ping_ms, CASE WHEN event_id % 20 = 8 THEN 'OTHER' END AS open_err,
          CAST(event_id % 700 AS INT) AS open_ms FROM events"""),
    "fullline": ([], """
        SELECT event_id, concat('{"time":"', strftime(ts,'%Y-%m-%dT%H:%M:%SZ'), '","remote_addr":"10.0.0.1","status":',
          CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 ELSE 200 END,
          ',"method":"', CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END, '","uri":"/u/', user_id,
          '","request_time":', CAST(CAST(value AS DECIMAL(12,3)) AS VARCHAR), '}') AS line FROM events"""),
    "loglines": (["fullline"], """
        SELECT event_id, CASE WHEN event_id % 53 = 0 THEN substr(line, 1, 40) ELSE line END AS line FROM fullline"""),
    "logs": (["loglines"], """
        SELECT l.event_id, l.line, e.event_id % 53 = 0 AS corrupt, e.user_id, epoch_us(date_trunc('second', e.ts)) AS time_us,
          CASE e.event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 ELSE 200 END AS status,
          CASE e.event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method, concat('/u/', e.user_id) AS uri,
          CAST(CAST(e.value AS DECIMAL(12,3)) * 1000 AS BIGINT) AS request_ms
        FROM loglines l JOIN events e USING (event_id)"""),
    "backup_stats": ([], f"""
        SELECT event_id, {_SRV} AS instance, CASE WHEN event_id % 7 = 5 THEN 'Server' ELSE '{BACKUP_FACILITY}' END AS facility,
          {_cyc('event_id', _NAMES)} AS stat, CASE WHEN event_id % 7 < 3 THEN 'TEXT' ELSE 'TIMEDATE' END AS vtype,
          {_cyc('event_id', STAT_TEXTS)} AS value_text, epoch_us(ts) AS value_us FROM events"""),
    "server_config": ([], f"""
        SELECT concat('srv', c_custkey) AS instance, c_custkey % 4 <> 3 AS calendar_on,
          {_cyc('c_custkey', ["1-5", "1,2,3", "1-5,0", "5-1", "7", "0-6", "1,x,3", None, "2-9,4", ",6,,"])} AS days,
          {_cyc('c_custkey', ["6-18", "06:00-18:00", "06:30:00-18:00:15", "22-6", None, "soon", "06:00-13:30"])} AS hours,
          CAST(c_custkey % 3 % 2 AS INT) AS store_on, CAST(c_custkey % 3 AS INT) AS log_style, CAST(c_custkey % 2 AS INT) AS restricted, CAST(c_nationkey % 6 AS INT) AS store_catalog_status FROM customer"""),
    "server_hours": ([], """
        SELECT concat('srv', c_custkey) AS instance, CAST(c_custkey % 7 AS INT) AS weekday,
          CASE WHEN c_custkey % 3 = 0 THEN '6-13' ELSE '08:15-12:45' END AS hours FROM customer WHERE c_custkey % 2 = 0"""),
    "calendar": ([], "SELECT * FROM (VALUES "
        + ", ".join(f"('{i}', {w}, {str(b).lower()}, {s}, {e}, {z}, {d})" for i, w, b, s, e, z, d in CALENDAR)
        + ") t(instance, weekday, is_business_day, start_s, end_s, zone, dst)"),
    "targets": ([], f"""
        SELECT '{JOB}' AS job, concat('srv', n_nationkey) AS instance, n_name AS pod, r_name AS namespace
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "evals": (["up"], "SELECT event_id, instance, ts_us, value = 0 AS active FROM up"),
    "alert_evals": ([], f"""
        SELECT event_id, {_SRV} AS instance, epoch_us(ts) AS ts_us, 'critical' AS severity, event_type = 'error' AS active FROM events
        UNION ALL SELECT event_id, {_SRV}, epoch_us(ts), 'warning', {_MILLI} > 60000 FROM events"""),
    "alert_flags": (["alert_evals"], """
        SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY instance, severity ORDER BY ts_us, event_id), false) AS starts
        FROM alert_evals"""),
    "alert_marks": (["alert_flags"], """
        SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY instance, severity ORDER BY ts_us, event_id) AS ep
        FROM alert_flags"""),
    "alerts": (["alert_marks"], """
        SELECT concat_ws(':', severity, instance, min(ts_us)) AS alert_id, 'ServerSlowOrDown' AS alertname, severity, instance,
          CASE WHEN instance IN ('srv0','srv1') THEN 'c1' WHEN instance = 'srv2' THEN 'c2' END AS cluster,
          CASE WHEN severity = 'critical' THEN 'mail' END AS service,
          min(ts_us) AS starts_us, min(CASE WHEN NOT active THEN ts_us END) AS ends_us
        FROM alert_marks WHERE ep > 0 GROUP BY instance, severity, ep"""),
}
