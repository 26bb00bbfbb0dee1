"""Statistics: names, descriptions, filters, types, health families, mailbox, log extents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.constants import DAY, HEALTH_PREFIX, HOUR, MAIL_LOOKBACK_US, MAIL_MIN_WAIT_US, STAT_PREFIX
from fleetgauge.functions.text import first_token, milli_text, to_milli
from fleetgauge.operators import filters as fl
from fleetgauge.operators import health as he
from fleetgauge.operators import labels as lb
from fleetgauge.operators import mailbox as mb
from fleetgauge.operators import normalize as no
from fleetgauge.plans import views as v
from fleetgauge.plans.registry import job


def sanitize_sql(text: str) -> str:
    return f"regexp_replace(replace({text}, '/', 'C'), '[^A-Za-z0-9]', '_', 'g')"


def milli_text_sql(m: str) -> str:
    return (f"concat(CASE WHEN {m} < 0 THEN '-' ELSE '' END, abs({m}) // 1000, '.', "
            f"lpad(CAST(abs({m}) % 1000 AS VARCHAR), 3, '0'))")


KEY = "lower(concat_ws('.', facility, stat))"
NAMED = "facility IS NOT NULL"

# --- scans -------------------------------------------------------------------------------


@job("src_stats_snapshot", """
    SELECT event_id, snapshot, instance, facility, stat, vtype, CASE WHEN vtype = 'LONG' THEN value_milli END AS long_value,
      CASE WHEN vtype = 'NUMBER' THEN value_number END AS number_value, CASE WHEN vtype = 'TEXT' THEN value_text END AS text_value,
      CASE WHEN vtype = 'TIMEDATE' THEN ts_us END AS time_us FROM stats""", "stats")
def src_stats_snapshot(spark, sf):
    return no.typed_stats(v.stats(spark, sf))


HELPS = {"helps": r"""
    SELECT lower(stat_name) AS key, min_by(trim(regexp_replace(regexp_replace(
        CASE WHEN units <> '' THEN concat(description, ' [', units, ']') ELSE description END,
        '[\x00-\x1f]', '', 'g'), ' +', ' ', 'g')), note_id) AS help
    FROM catalog WHERE form = 'Statistic' GROUP BY ALL"""}


@job("src_stat_catalog", "SELECT key, help FROM helps", "catalog", HELPS)
def src_stat_catalog(spark, sf):
    return no.descriptions(v.catalog(spark, sf))


EVERY = 6 * HOUR
SCANS = {"scans": f"SELECT unnest(range(low, high + 1, {EVERY})) AS scan_us FROM extent"}
PENDING = f"""FROM scans CROSS JOIN (SELECT DISTINCT instance FROM mail) i LEFT JOIN mail ON mail.instance = i.instance AND delivery_priority <> 'L' AND NOT has_send_at
    AND added_us <= scan_us - {MAIL_MIN_WAIT_US} AND added_us >= scan_us - {MAIL_LOOKBACK_US}"""


WAITING = f"""FROM mail WHERE delivery_priority <> 'L' AND NOT has_send_at
    AND added_us <= {v.AT_US - MAIL_MIN_WAIT_US} AND added_us >= {v.AT_US - MAIL_LOOKBACK_US}"""


@job("src_mailbox_pending", f"SELECT instance, mailbox, note_id, ({v.AT_US} - added_us) // 1000000 AS wait_s {WAITING}", "mail")
def src_mailbox_pending(spark, sf):
    return mb.pending(v.mail(spark, sf), v.AT_US)


@job("flt_mail_pending", f"SELECT note_id {WAITING}", "mail")
def flt_mail_pending(spark, sf):
    return mb.pending(v.mail(spark, sf), v.AT_US).select("note_id")


@job("ag_mail_age_buckets", f"""
    SELECT instance, scan_us, count(*) FILTER (wait_s < 300) AS lt_5m, count(*) FILTER (wait_s >= 300 AND wait_s < 900) AS m5_15,
      count(*) FILTER (wait_s >= 900 AND wait_s < 3600) AS m15_60, count(*) FILTER (wait_s >= 3600) AS ge_60m, count(wait_s) AS n,
      CAST(coalesce(sum(wait_s) // nullif(count(wait_s), 0), 0) AS BIGINT) AS avg_s, CAST(0 AS BIGINT) AS errors
    FROM (SELECT i.instance, scan_us, (scan_us - added_us) // 1000000 AS wait_s {PENDING}) GROUP BY ALL""", "mail extent", SCANS)
def ag_mail_age_buckets(spark, sf):
    return mb.age_buckets(v.mail(spark, sf), *v.extent(spark, sf), EVERY)


@job("src_txn_listing", "SELECT instance, filename FROM txn WHERE filename LIKE '%.TXN'", "txn")
def src_txn_listing(spark, sf):
    return he.extent_listing(v.txn(spark, sf))


EXTENT = "TRY_CAST(nullif(regexp_extract(filename, '^S([0-9]+)([.].*)?$', 1), '') AS BIGINT)"


@job("prj_txn_number", f"SELECT instance, filename, {EXTENT} AS extent_no FROM txn", "txn")
def prj_txn_number(spark, sf):
    return v.txn(spark, sf).withColumn("extent_no", he.extent_number(F.col("filename")))


EXTENTS = {"extents": f"""SELECT instance, count(*) AS n_files, min({EXTENT}) AS min_no, max({EXTENT}) AS max_no
    FROM txn WHERE filename LIKE '%.TXN' GROUP BY ALL"""}


@job("ag_txn_extents", "SELECT * FROM extents", "txn", EXTENTS)
def ag_txn_extents(spark, sf):
    return he.extent_summary(v.txn(spark, sf))


# --- names and values --------------------------------------------------------------------


@job("prj_metric_name", f"""
    SELECT event_id, {KEY} AS key, concat('{STAT_PREFIX}_', {sanitize_sql("concat_ws('.', facility, stat)")}) AS metric
    FROM stats WHERE {NAMED}""", "stats")
def prj_metric_name(spark, sf):
    return no.metric_names(v.stats(spark, sf).where(NAMED)).select("event_id", "key", "metric")


@job("prj_help_text", r"""
    SELECT note_id, trim(regexp_replace(regexp_replace(description, '[\x00-\x1f]', '', 'g'), ' +', ' ', 'g')) AS help FROM catalog""", "catalog")
def prj_help_text(spark, sf):
    return v.catalog(spark, sf).select("note_id", no.help_text(F.col("description")).alias("help"))


@job("prj_first_token", "SELECT event_id, split_part(value_text, ' ', 1) AS token FROM stats", "stats")
def prj_first_token(spark, sf):
    return v.stats(spark, sf).select("event_id", first_token(F.col("value_text")).alias("token"))


@job("prj_fixed_milli", f"""
    SELECT event_id, {milli_text_sql('m')} AS value_text FROM (SELECT event_id,
      CAST(trunc(value_number * 1000.0::DOUBLE + CASE WHEN value_number >= 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) AS BIGINT) AS m FROM stats)""", "stats")
def prj_fixed_milli(spark, sf):
    return v.stats(spark, sf).select("event_id", milli_text(to_milli(F.col("value_number"))).alias("value_text"))


@job("prj_ms_to_seconds", f"SELECT event_id, {milli_text_sql('ms_total')} AS seconds_text FROM counters", "counters")
def prj_ms_to_seconds(spark, sf):
    return v.counters(spark, sf).select("event_id", milli_text(F.col("ms_total")).alias("seconds_text"))


@job("prj_epoch_seconds", """
    SELECT event_id, epoch_us(ts) // 1000000 AS epoch_s, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S:'),
      lpad(CAST(epoch_us(ts) % 1000000 // 10000 AS VARCHAR), 2, '0'), 'Z') AS iso_text FROM events WHERE year(ts) >= 1900""")
def prj_epoch_seconds(spark, sf):
    return no.epoch_values(v.table(spark, sf, "events").select("event_id", "ts")).select("event_id", "epoch_s", "iso_text")


@job("prj_bytes_to_mb", """
    SELECT instance, component, path, CAST((total_bytes * 2000 + 1048576) // 2097152 AS DOUBLE) / 1000.0::DOUBLE AS total_mb,
      CAST((free_bytes * 2000 + 1048576) // 2097152 AS DOUBLE) / 1000.0::DOUBLE AS free_mb FROM disks WHERE path <> ''""", "disks")
def prj_bytes_to_mb(spark, sf):
    return he.disk_sizes(v.disks(spark, sf))


# --- health ------------------------------------------------------------------------------

STATE = {"states": """
    SELECT *, CASE WHEN ping_err = 'RESTRICTED' THEN 1 WHEN ping_err = 'UNAVAILABLE' THEN 2 WHEN ping_err IS NOT NULL THEN 3
      WHEN open_err IS NOT NULL THEN 3 ELSE 0 END AS state FROM probes"""}
PING = "CASE WHEN ping_err IS NULL THEN ping_ms ELSE 0 END"


@job("prj_server_state", f"""
    SELECT instance, ts_us, state, CASE WHEN state < 3 THEN {PING} END AS ping_ms,
      CASE WHEN state < 1 THEN open_ms END AS response_ms FROM states""", "probes", STATE)
def prj_server_state(spark, sf):
    return he.server_state(v.probes(spark, sf)).select("instance", "ts_us", "state", "ping_ms", "response_ms")


@job("flt_conditional_emit", f"""
    SELECT event_id, instance, ts_us, 'state' AS metric, CAST(state AS BIGINT) AS value FROM states
    UNION ALL SELECT event_id, instance, ts_us, 'ping_latency_ms', {PING} FROM states WHERE state < 3
    UNION ALL SELECT event_id, instance, ts_us, 'response_time_ms', open_ms FROM states WHERE state < 1""", "probes", STATE)
def flt_conditional_emit(spark, sf):
    rows = he.server_state(v.probes(spark, sf))
    return fl.conditional_emit(rows, {
        "state": (F.lit(True), F.col("state")),
        "ping_latency_ms": (F.col("state") < 3, F.col("ping_ms")),
        "response_time_ms": (F.col("state") < 1, F.col("response_ms")),
    }, ["event_id", "instance", "ts_us"])


@job("prj_storage_status", """
    SELECT instance, 'daos_status' AS metric, CAST(store_on AS BIGINT) AS value FROM server_config
    UNION ALL SELECT instance, 'daos_catalog_status', store_catalog_status FROM server_config WHERE store_on <> 0
    UNION ALL SELECT instance, 'daos_catalog_not_synced', CASE WHEN store_catalog_status = 1 THEN 0 ELSE 1 END
      FROM server_config WHERE store_on <> 0""", "server_config")
def prj_storage_status(spark, sf):
    return he.storage_status(v.server_config(spark, sf))


@job("prj_backup_status", f"""
    SELECT event_id, instance, CASE lower(stat) WHEN 'lastbackup.db.status' THEN 'LastBackup_DB_Status'
        WHEN 'lastbackup.tl.status' THEN 'LastBackup_TL_Status' ELSE 'LastBackup_TL_LastLogExtendNumber' END AS metric,
      CASE WHEN lower(stat) = 'lastbackup.tl.lastlogextend' THEN CAST(nullif(regexp_extract(value_text, '^S([0-9]+)([.].*)?$', 1), '') AS BIGINT)
        WHEN lower(value_text) = 'successful' THEN 0 ELSE 1 END AS value
    FROM backup_stats WHERE facility = '{v.BACKUP_FACILITY}' AND vtype = 'TEXT'
      AND (lower(stat) IN ('lastbackup.db.status', 'lastbackup.tl.status')
           OR lower(stat) = 'lastbackup.tl.lastlogextend' AND regexp_matches(value_text, '^S[0-9]+([.].*)?$'))
    UNION ALL
    SELECT event_id, instance, CASE lower(stat) WHEN 'lastbackup.db.time' THEN 'LastBackup_DB_Time'
        WHEN 'lastbackup.tl.time' THEN 'LastBackup_TL_Time' ELSE 'Server_Time_Start' END, value_us // 1000000
    FROM backup_stats WHERE vtype = 'TIMEDATE' AND (facility = '{v.BACKUP_FACILITY}'
      AND lower(stat) IN ('lastbackup.db.time', 'lastbackup.tl.time') OR facility = 'Server' AND stat = 'Time.Start')""", "backup_stats")
def prj_backup_status(spark, sf):
    return he.backup_status(v.backup_stats(spark, sf), v.BACKUP_FACILITY)


# --- filters -----------------------------------------------------------------------------

INCLUDE, EXCLUDE = ["brand#12."], ["brand#1", "brand#12.small"]


def kept_sql(include, exclude):
    inc = " OR ".join(f"starts_with({KEY}, '{p}')" for p in include)
    exc = " OR ".join(f"starts_with({KEY}, '{p}')" for p in exclude)
    return f"({inc}) OR NOT ({exc})"


@job("flt_prefix_rules", f"SELECT event_id, {KEY} AS key FROM stats WHERE {NAMED} AND ({kept_sql(INCLUDE, EXCLUDE)})", "stats")
def flt_prefix_rules(spark, sf):
    rows = fl.prefix_rules(v.stats(spark, sf).where(NAMED), INCLUDE, EXCLUDE)
    return rows.select("event_id", no.stat_key().alias("key"))


# The rules are as many as there are part types: the excludes are the types' first words under one brand.
@job("flt_prefix_rule_table", f"""
    SELECT event_id, {KEY} AS key FROM stats WHERE {NAMED} AND (
      EXISTS (SELECT 1 FROM part WHERE p_size = 7 AND starts_with({KEY}, lower(concat(p_brand, '.eco'))))
      OR NOT EXISTS (SELECT 1 FROM part WHERE starts_with({KEY}, lower(concat(p_brand, '.', substr(p_type, 1, CAST(p_size % 3 + 2 AS INT)))))))""", "stats")
def flt_prefix_rule_table(spark, sf):
    part = v.table(spark, sf, "part")
    exclude = part.select(F.expr("lower(concat(p_brand, '.', substring(p_type, 1, p_size % 3 + 2)))").alias("prefix"))
    include = part.where("p_size = 7").select(F.expr("lower(concat(p_brand, '.eco'))").alias("prefix"))
    rows = fl.prefix_rules(v.stats(spark, sf).where(NAMED), include, exclude)
    return rows.select("event_id", no.stat_key().alias("key"))


@job("flt_facility", "SELECT event_id, facility, stat FROM stats WHERE lower(facility) IS DISTINCT FROM 'brand#7'", "stats")
def flt_facility(spark, sf):
    return fl.drop_facility(v.stats(spark, sf), "BRAND#7").select("event_id", "facility", "stat")


@job("flt_value_types", "SELECT event_id, vtype FROM stats WHERE vtype IN ('LONG', 'NUMBER')", "stats")
def flt_value_types(spark, sf):
    return fl.value_types(v.stats(spark, sf)).select("event_id", "vtype")


@job("flt_invalid_split", """
    SELECT event_id, CASE WHEN facility IS NULL OR stat IS NULL THEN 'invalid' WHEN v IS NULL THEN 'skipped' ELSE 'ok' END AS verdict
    FROM (SELECT *, CASE WHEN event_id % 13 <> 0 THEN value_milli END AS v FROM stats)""", "stats")
def flt_invalid_split(spark, sf):
    rows = v.stats(spark, sf).withColumn("value_milli", F.when(F.col("event_id") % 13 != 0, F.col("value_milli")))
    return fl.verdicts(rows).select("event_id", "verdict")


ZONE = "CASE WHEN event_id % 4 <> 0 THEN concat('z', event_id % 3) END"  # some samples have no such label


def _samples(spark, sf, labels=("job", "instance", "op")):
    rows = v.gauges(spark, sf).withColumn("zone", F.expr(ZONE))
    return lb.labelled(rows, f"{HEALTH_PREFIX}_response_ms", list(labels))


ZONED = ("job", "instance", "op", "zone")


@job("flt_label_match", f"""
    SELECT event_id, concat('{HEALTH_PREFIX}_response_ms{{instance="', instance, '", job="', job, '", op="', op, '"}}') AS series_key, value
    FROM gauges WHERE instance = 'srv2' AND op = 'click' AND job = '{v.JOB}' AND coalesce({ZONE}, '') = ''""", "gauges")
def flt_label_match(spark, sf):
    out = fl.label_match(_samples(spark, sf, ZONED), {"instance": "srv2", "job": v.JOB, "op": "click", "zone": ""})
    return out.select("event_id", "series_key", "value")


@job("flt_label_regex", f"""
    SELECT event_id, op, {ZONE} AS zone, value FROM gauges
    WHERE regexp_full_match(op, 'c.*|sign') AND regexp_full_match(coalesce({ZONE}, ''), 'z1|') AND {ZONE} IS DISTINCT FROM 'z2'""", "gauges")
def flt_label_regex(spark, sf):
    samples = _samples(spark, sf, ZONED)
    matchers = [("op", "=~", "c.*|sign"), ("zone", "=~", "z1|"), ("zone", "!=", "z2")]
    return fl.select_series(samples, fl.series_of(samples), matchers).select("event_id", "op", "zone", "value")


@job("flt_value_threshold", "SELECT event_id, instance, value FROM gauges WHERE value > 100000", "gauges")
def flt_value_threshold(spark, sf):
    return fl.value_threshold(v.gauges(spark, sf), ">", 100_000).select("event_id", "instance", "value")


@job("flt_time_range", f"SELECT event_id, ts_us, value FROM gauges WHERE ts_us BETWEEN {v.AT_US - 24 * HOUR} AND {v.AT_US}", "gauges")
def flt_time_range(spark, sf):
    return v.gauges(spark, sf, v.AT_US - 24 * HOUR, v.AT_US).select("event_id", "ts_us", "value")


# --- joins and aggregates ----------------------------------------------------------------


@job("jn_description", f"""
    SELECT event_id, {KEY} AS key, coalesce(help, concat('Statistic - ', facility, '.', stat)) AS help
    FROM stats LEFT JOIN helps ON helps.key = {KEY} WHERE {NAMED}""", "stats catalog", HELPS)
def jn_description(spark, sf):
    helps = no.descriptions(v.catalog(spark, sf))
    return no.described(v.stats(spark, sf).where(NAMED), helps).select("event_id", "key", "help")


@job("jn_target_labels", """
    SELECT event_id, instance, job, op, value, coalesce(pod, '') AS pod, coalesce(namespace, '') AS namespace
    FROM gauges LEFT JOIN (SELECT * FROM targets WHERE instance <> 'srv3') USING (job, instance)""", "gauges targets")
def jn_target_labels(spark, sf):
    out = lb.target_labels(v.gauges(spark, sf), v.targets(spark, sf).where("instance <> 'srv3'"))  # one is not listed
    return out.select("event_id", "instance", "job", "op", "value", "pod", "namespace")


# Two chained variables: the jobs of one namespace, then their servers.
@job("jn_variable_chain", "SELECT DISTINCT concat('srv', l_suppkey) AS instance FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 7")
def jn_variable_chain(spark, sf):
    info = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("job"), F.concat(F.lit("srv"), "l_suppkey").alias("instance"))
    chosen = v.table(spark, sf, "supplier").where("s_nationkey = 7").select(F.col("s_suppkey").alias("job"))
    return lb.instances_of_jobs(info, chosen)


@job("ag_type_counts", f"""
    SELECT snapshot, count(*) AS n_all, count(*) FILTER ({NAMED} AND vtype = 'TEXT') AS n_text,
      count(*) FILTER ({NAMED} AND vtype = 'LONG') AS n_long, count(*) FILTER ({NAMED} AND vtype = 'NUMBER') AS n_number,
      count(*) FILTER ({NAMED} AND vtype = 'TIMEDATE') AS n_time, count(*) FILTER (NOT {NAMED}) AS n_invalid,
      count(*) FILTER ({NAMED} AND vtype = 'OTHER') AS n_unknown FROM stats GROUP BY ALL""".replace("NOT facility IS NOT NULL", "facility IS NULL"), "stats")
def ag_type_counts(spark, sf):
    return no.type_counts(v.stats(spark, sf))


@job("ag_first_wins_dedup", f"""
    SELECT snapshot, instance, key, value, n_dup, count(*) OVER (PARTITION BY snapshot, instance, metric) - 1 AS n_collide FROM (
      SELECT snapshot, instance, {KEY} AS key, value_milli AS value, {sanitize_sql("concat_ws('.', facility, stat)")} AS metric,
        count(*) OVER (PARTITION BY snapshot, instance, {KEY}) - 1 AS n_dup
      FROM stats WHERE {NAMED} QUALIFY row_number() OVER (PARTITION BY snapshot, instance, {KEY} ORDER BY event_id) = 1)""", "stats")
def ag_first_wins_dedup(spark, sf):
    return no.first_wins(v.stats(spark, sf))


@job("ag_label_values", "SELECT DISTINCT op AS value FROM gauges ORDER BY 1", "gauges")
def ag_label_values(spark, sf):
    return lb.label_values(_samples(spark, sf, ["op"]), "op")


@job("so_label_values", """
    SELECT row_number() OVER (ORDER BY value) AS pos, value FROM (SELECT DISTINCT concat('host', lpad(CAST(l_partkey AS VARCHAR), 9, '0')) AS value FROM lineitem)""")
def so_label_values(spark, sf):
    hosts = v.table(spark, sf, "lineitem").select(
        F.concat(F.lit("host"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("instance"))
    return lb.numbered_label_values(lb.labelled(hosts, "up", ["instance"]), "instance")


@job("wn_staleness", f"""
    SELECT u.instance, max(ts_us) AS last_us, ({v.TO_US} - max(ts_us)) // 1000000 AS age_s,
      coalesce(max(ts_us) FILTER (event_type = 'signup'), -1) >= max(ts_us) AS ended
    FROM (SELECT *, concat('srv', user_id) AS instance, epoch_us(ts) AS ts_us FROM events) u GROUP BY ALL""")
def wn_staleness(spark, sf):
    rows = v.table(spark, sf, "events").select(
        F.concat(F.lit("srv"), "user_id").alias("instance"), v.epoch_us("ts").alias("ts_us"),
        (F.col("event_type") == "signup").alias("shutdown"))
    return lb.staleness(rows, v.TO_US)
