"""One full collection of every server at an instant, as samples and as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.constants import DAY, HEALTH_PREFIX, MAIL_LOOKBACK_US, MAIL_MIN_WAIT_US, SECOND, STAT_PREFIX, TRANS_PREFIX
from fleetgauge.functions.text import series_key, whole_div
from fleetgauge.operators import collection as co
from fleetgauge.operators import health as he
from fleetgauge.operators import labels as lb
from fleetgauge.operators import mailbox as mb
from fleetgauge.operators import schedule as sc
from fleetgauge.plans import views as v
from fleetgauge.plans.registry import job
from fleetgauge.plans.schedule_jobs import BUSINESS, MANUAL, STATUS_SQL, manual
from fleetgauge.plans.stat_jobs import EXCLUDE, EXTENTS, INCLUDE, KEY, PING, STATE, kept_sql, milli_text_sql, sanitize_sql

AT, BUILD = v.AT_US, 10000


def families(spark, sf) -> list:
    """The families in collection order; each input is reduced to one row per server first."""
    now = F.lit(AT)
    up = v.up(spark, sf).select("instance").distinct().withColumn("ts_us", now)
    config = v.server_config(spark, sf)
    maint = v.maint(spark, sf).where(F.col("start_us") <= AT)
    latest = F.struct("start_us", "window_id")
    window = maint.groupBy("instance").agg(F.max_by("start_us", latest).alias("start_us"), F.max_by("end_us", latest).alias("end_us"))
    servers = (
        sc.maintenance_status(up, maint, manual(spark)).join(window, "instance", "left")
        .join(config.select("instance", "restricted"), "instance", "left").fillna({"restricted": 0})
    )
    probes = v.probes(spark, sf).where(F.col("ts_us") <= AT)
    probe = probes.groupBy("instance").agg(
        F.max(F.struct("ts_us", "event_id", "ping_err", "ping_ms", "open_err", "open_ms")).alias("p")
    ).select("instance", "p.*")
    known = config.join(up.select("instance"), "instance", "left_semi")
    buckets = mb.age_buckets(v.mail(spark, sf), AT, AT, DAY, servers=up).withColumn("scan_ms", F.col("n") * 3)
    today = v.stats(spark, sf).where((F.col("snapshot") == AT // DAY) & (F.col("ts_us") <= AT))
    return [
        co.common(servers, AT, BUILD),
        co.state(he.server_state(probe)),
        co.plain(he.storage_status(known)),
        co.transaction_log(known.select("instance", "log_style"), he.extent_summary(v.txn(spark, sf))),
        co.disks(v.disks(spark, sf)),
        co.mail(buckets),
        co.transactions(v.trans_report(spark, sf, AT // DAY * DAY, AT), up, AT),
        co.shutdown(up.join(manual(spark), "instance", "left_semi"), AT),
        co.business(sc.business_time(up, v.calendar(spark))),
        co.statistics(today, "Brand#3", INCLUDE, EXCLUDE),
        co.plain(he.backup_status(
            v.backup_stats(spark, sf).where((whole_div(F.col("value_us"), DAY) == AT // DAY) & (F.col("value_us") <= AT)), v.BACKUP_FACILITY)),
    ]


_H = f"{HEALTH_PREFIX}_"


def _one(name: str, value: str, source: str) -> str:
    return f"SELECT instance, '{_H}{name}' AS series_key, CAST({value} AS VARCHAR) AS value_text FROM {source}"


COLLECTION = {
    **STATE, **EXTENTS,
    "srv": "SELECT DISTINCT instance FROM up",
    "marks": f"SELECT instance, CAST({AT} AS BIGINT) AS ts_us FROM srv",
    **BUSINESS,
    "win": f"SELECT * FROM maint WHERE start_us <= {AT} QUALIFY row_number() OVER (PARTITION BY instance ORDER BY start_us DESC, window_id DESC) = 1",
    "common": f"""SELECT s.instance, w.start_us, w.end_us, coalesce(c.restricted, 0) AS restricted,
        {STATUS_SQL.format(ts='ts_us')} AS status FROM marks s LEFT JOIN win w USING (instance) LEFT JOIN server_config c USING (instance)""",
    "probe": f"SELECT * FROM states WHERE ts_us <= {AT} QUALIFY row_number() OVER (PARTITION BY instance ORDER BY ts_us DESC, event_id DESC) = 1",
    "conf": "SELECT * FROM server_config SEMI JOIN srv USING (instance)",
    "logs0": "SELECT c.instance, c.log_style, coalesce(n_files, 0) AS n_files, min_no, max_no FROM conf c LEFT JOIN extents USING (instance)",
    "dsk": """SELECT *, concat('{component="', component, '", path="', path, '"}') AS lab FROM disks WHERE path <> ''""",
    "waits": f"""SELECT instance, ({AT} - added_us) // 1000000 AS w FROM mail WHERE delivery_priority <> 'L' AND NOT has_send_at
        AND added_us <= {AT - MAIL_MIN_WAIT_US} AND added_us >= {AT - MAIL_LOOKBACK_US}""",
    "trans": f"""SELECT concat('srv', user_id % 5) AS instance, upper(event_type) AS op, count(*) AS n, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS total
        FROM events WHERE epoch_us(ts) BETWEEN {AT // DAY * DAY} AND {AT} GROUP BY ALL""",
    "box": """SELECT instance, count(w) * 3 AS scan_ms, coalesce(CAST(sum(w) // nullif(count(w), 0) AS BIGINT), 0) AS avg_s, count(*) FILTER (w < 900) AS a,
        count(*) FILTER (w >= 900 AND w < 3600) AS b, count(*) FILTER (w >= 3600) AS c FROM srv LEFT JOIN waits USING (instance) GROUP BY ALL""",
    "firsts": f"""SELECT * FROM stats WHERE snapshot = {AT // DAY} AND ts_us <= {AT} AND facility IS NOT NULL AND lower(facility) <> 'brand#3'
        AND ({kept_sql(INCLUDE, EXCLUDE)}) QUALIFY row_number() OVER (PARTITION BY instance, {KEY} ORDER BY event_id) = 1""",
    "bk": f"""SELECT *, lower(stat) AS s FROM backup_stats WHERE value_us // {DAY} = {AT // DAY} AND value_us <= {AT}
        AND (facility = '{v.BACKUP_FACILITY}' OR s = 'time.start')""",
}
NUMBER_MILLI = "CAST(trunc(value_number * 1000.0::DOUBLE + CASE WHEN value_number >= 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) AS BIGINT)"
COLLECTION_SQL = " UNION ALL ".join([
    _one("Exporter_Build", str(BUILD), "common"), _one("stat_update_timestamp", str(AT // SECOND), "common"),
    _one("maintenance_start_timestamp", "start_us // 1000000", "common WHERE start_us IS NOT NULL"),
    _one("maintenance_end_timestamp", "end_us // 1000000", "common WHERE end_us IS NOT NULL"),
    _one("maintenance_status", "status", "common"), _one("server_restricted_status", "restricted", "common"),
    _one("state", "state", "probe"),
    _one("ping_latency_seconds", milli_text_sql(f"({PING})"), "probe WHERE state < 3"),
    _one("response_time_seconds", milli_text_sql("open_ms"), "probe WHERE state < 1"),
    _one("daos_status", "store_on", "conf"), _one("daos_catalog_status", "store_catalog_status", "conf WHERE store_on <> 0"),
    _one("daos_catalog_not_synced", "CASE WHEN store_catalog_status = 1 THEN 0 ELSE 1 END", "conf WHERE store_on <> 0"),
    _one("translog_style", "log_style", "logs0"), _one("translog_file_count", "n_files", "logs0 WHERE log_style = 1"),
    _one("translog_file_min", "min_no", "logs0 WHERE log_style = 1 AND n_files > 0"),
    _one("translog_file_max", "max_no", "logs0 WHERE log_style = 1 AND n_files > 0"),
    f"SELECT instance, concat('{_H}disk_total_bytes', lab), CAST(total_bytes AS VARCHAR) FROM dsk",
    f"SELECT instance, concat('{_H}disk_free_bytes', lab), CAST(free_bytes AS VARCHAR) FROM dsk",
    _one("mail_pending_avg_age_seconds", "avg_s", "box"), _one("mailbox_check_errors", "0", "box"),
    _one("mailbox_check_time", milli_text_sql("scan_ms"), "box"),
    f"""SELECT instance, concat('{TRANS_PREFIX}_count{{op="', op, '"}}'), CAST(n AS VARCHAR) FROM trans""",
    f"""SELECT instance, concat('{TRANS_PREFIX}_total_seconds{{op="', op, '"}}'), {milli_text_sql('total')} FROM trans""",
    f"SELECT instance, '{TRANS_PREFIX}_stat_transactions_update_timestamp', '{AT // SECOND}' FROM srv",
    _one("stat_shutdown_timestamp", str(AT // SECOND), f"srv WHERE instance IN ('{MANUAL[0]}')"),
    _one("mailbox_check_timestamp", str(AT // SECOND), "box"), _one("mail_pending_age_5m_15m", "a", "box"),
    _one("mail_pending_age_15m_60m", "b", "box"), _one("mail_pending_age_ge_60m", "c", "box"),
    _one("business_day", "business_day", "timed"), _one("business_hours", "business_hours", "timed"),
    f"""SELECT instance, concat('{STAT_PREFIX}_', {sanitize_sql("concat_ws('.', facility, stat)")}),
          CASE vtype WHEN 'LONG' THEN CAST(value_milli AS VARCHAR) ELSE {milli_text_sql(NUMBER_MILLI)} END
        FROM firsts WHERE vtype IN ('LONG', 'NUMBER')""",
    _one("LastBackup_DB_Status", "CASE WHEN value_text = 'Successful' THEN 0 ELSE 1 END", "bk WHERE vtype = 'TEXT' AND s = 'lastbackup.db.status'"),
    _one("LastBackup_TL_Status", "CASE WHEN value_text = 'Successful' THEN 0 ELSE 1 END", "bk WHERE vtype = 'TEXT' AND s = 'lastbackup.tl.status'"),
    _one("LastBackup_TL_LastLogExtendNumber", "123", "bk WHERE s = 'lastbackup.tl.lastlogextend' AND value_text = 'S0000123.TXN'"),
    _one("LastBackup_DB_Time", "value_us // 1000000", "bk WHERE vtype = 'TIMEDATE' AND s = 'lastbackup.db.time'"),
    _one("LastBackup_TL_Time", "value_us // 1000000", "bk WHERE vtype = 'TIMEDATE' AND s = 'lastbackup.tl.time'"),
    _one("Server_Time_Start", "value_us // 1000000", "bk WHERE vtype = 'TIMEDATE' AND s = 'time.start'"),
])


@job("se_union_families", COLLECTION_SQL, "up maint calendar probes server_config txn disks mail stats backup_stats", COLLECTION)
def se_union_families(spark, sf):
    rows = lb.union_families(*families(spark, sf))
    return rows.select("instance", series_key(F.col("name"), F.col("labels")).alias("series_key"), "value_text")
