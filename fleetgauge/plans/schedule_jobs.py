"""Business-time, maintenance and alert jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.constants import HOUR, MINUTE, SINCE, WILL_END, WILL_START
from fleetgauge.functions.local import local_table
from fleetgauge.operators import alerts as al
from fleetgauge.operators import schedule as sc
from fleetgauge.plans import views as v
from fleetgauge.plans.registry import job

MANUAL = ["srv3"]


def manual(spark):
    return local_table(spark, [(m,) for m in MANUAL], {"instance": "string"})


# Weekday and second of the day on the calendar's clock.
BUSINESS = {
    "clocked": """
        SELECT s.*, c.zone, c.dst, s.ts_us // 1000000 + (c.dst - c.zone) * 3600 AS loc
        FROM marks s LEFT JOIN (SELECT DISTINCT instance, zone, dst FROM calendar) c USING (instance)""",
    "timed": """
        SELECT k.*, CASE WHEN k.zone IS NULL OR c.is_business_day THEN 1 ELSE 0 END AS business_day,
          CASE WHEN k.zone IS NULL THEN 1 WHEN NOT c.is_business_day THEN 0
               WHEN c.start_s <= c.end_s THEN CASE WHEN loc % 86400 < c.start_s OR loc % 86400 > c.end_s THEN 0 ELSE 1 END
               ELSE CASE WHEN loc % 86400 < c.start_s AND loc % 86400 > c.end_s THEN 0 ELSE 1 END END AS business_hours
        FROM clocked k LEFT JOIN calendar c ON c.instance = k.instance
          AND c.weekday = dayofweek(make_timestamp(k.loc * 1000000))""",
}
UP_TIMED = {"marks": "SELECT * FROM up", **BUSINESS}


@job("jn_business_time", "SELECT instance, ts_us, business_day, business_hours FROM timed", "up calendar", UP_TIMED)
def jn_business_time(spark, sf):
    out = sc.business_time(v.up(spark, sf), v.calendar(spark))
    return out.select("instance", "ts_us", "business_day", "business_hours")


@job("ag_business_uptime", """
    SELECT instance, ts_us // 86400000000 AS day, CAST(sum(value) AS BIGINT) AS n_up, count(*) AS n_all,
      CAST(sum(value) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS ratio
    FROM timed WHERE business_hours = 1 GROUP BY ALL""", "up calendar", UP_TIMED)
def ag_business_uptime(spark, sf):
    return sc.business_uptime(v.up(spark, sf), v.calendar(spark))


STATUS_SQL = f"""CASE WHEN s.instance IN ('{"', '".join(MANUAL)}') THEN 1
    WHEN EXISTS (SELECT 1 FROM maint m WHERE m.instance = s.instance AND m.start_us <= s.{{ts}}
                 AND (m.end_us IS NULL OR s.{{ts}} <= m.end_us)) THEN 3 ELSE 0 END"""


@job("jn_maintenance", f"SELECT instance, ts_us, {STATUS_SQL.format(ts='ts_us')} AS maintenance_status FROM up s", "up maint")
def jn_maintenance(spark, sf):
    out = sc.maintenance_status(v.up(spark, sf), v.maint(spark, sf), manual(spark))
    return out.select("instance", "ts_us", "maintenance_status")


# The formats in the order they are tried, on the leading part of the text.
_I = r"\s*([+-]?\d+)"
CALENDAR_CTES = {
    "spec": """
        SELECT instance, coalesce(days, '1-5') AS days, coalesce(hours, '6-18') AS hours FROM server_config
        WHERE days IS NOT NULL OR calendar_on""",
    "tok": """
        SELECT instance, t FROM (SELECT instance, unnest(string_split(days, ',')) AS t FROM spec) WHERE t <> ''""",
    "rng": rf"""
        SELECT instance, TRY_CAST(nullif(regexp_extract(t, CASE WHEN contains(t, '-') THEN '^{_I}-{_I}' ELSE '^{_I}' END, 1), '') AS INT) AS a,
          CASE WHEN contains(t, '-') THEN TRY_CAST(nullif(regexp_extract(t, '^{_I}-{_I}', 2), '') AS INT)
               ELSE TRY_CAST(nullif(regexp_extract(t, '^{_I}', 1), '') AS INT) END AS b FROM tok""",
    "ok": "SELECT instance, bool_and(coalesce(a BETWEEN 0 AND 6 AND b BETWEEN 0 AND 6, false)) AS days_ok FROM rng GROUP BY ALL",
    "wd": "SELECT unnest(range(0, 7)) AS weekday",
    "on_days": """
        SELECT DISTINCT instance, weekday FROM rng, wd WHERE a BETWEEN 0 AND 6 AND b BETWEEN 0 AND 6
          AND CASE WHEN a <= b THEN weekday BETWEEN a AND b ELSE weekday >= a OR weekday <= b END""",
    "merged": """
        SELECT s.instance, CAST(wd.weekday AS INT) AS weekday, coalesce(o.hours, s.hours) AS h,
          d.instance IS NOT NULL AS is_business_day, coalesce(ok.days_ok, true) AS days_ok
        FROM spec s CROSS JOIN wd LEFT JOIN server_hours o ON o.instance = s.instance AND o.weekday = wd.weekday
        LEFT JOIN on_days d ON d.instance = s.instance AND d.weekday = wd.weekday LEFT JOIN ok ON ok.instance = s.instance""",
    "split": r"""
        SELECT *, string_split(string_split(h, '-')[1], ':') AS l, string_split(string_split(h, '-')[2], ':') AS r,
          regexp_full_match(h, '\d+-\d+|\d+:\d+-\d+:\d+|\d+:\d+:\d+-\d+:\d+:\d+') AS hours_ok FROM merged""",
}


@job("prj_calendar_from_spec", """
    SELECT instance, weekday, is_business_day, days_ok AND hours_ok AS valid,
      CASE WHEN hours_ok THEN CAST(l[1] AS INT) * 3600 + coalesce(CAST(l[2] AS INT), 0) * 60 + coalesce(CAST(l[3] AS INT), 0) ELSE 0 END AS start_s,
      CASE WHEN hours_ok THEN CAST(r[1] AS INT) * 3600 + coalesce(CAST(r[2] AS INT), 0) * 60 + coalesce(CAST(r[3] AS INT), 0) ELSE 0 END AS end_s
    FROM split""", "server_config server_hours", CALENDAR_CTES)
def prj_calendar_from_spec(spark, sf):
    return sc.calendar_from_spec(v.server_config(spark, sf), v.server_hours(spark, sf))


_STAMP = r"'\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?'"
COMMANDS = {
    "cmds": rf"""
        SELECT *, CAST(nullif(regexp_extract(cmd, '^(?:on|start \+|end \+)\s*([+-]?\d+)', 1), '') AS BIGINT) AS mins,
          CASE WHEN regexp_full_match(regexp_replace(cmd, '^(start|end) ', ''), {_STAMP})
               THEN epoch_us(TRY_CAST(regexp_replace(cmd, '^(start|end) ', '') AS TIMESTAMP)) END AS moment
        FROM maint_commands""",
    "acts": """
        SELECT *, CASE WHEN lower(cmd) IN ('off', 'clear') THEN 'clear'
          WHEN starts_with(cmd, 'on') THEN CASE WHEN coalesce(mins, 0) = 0 THEN 'manual' ELSE 'window' END
          WHEN starts_with(cmd, 'start +') THEN CASE WHEN coalesce(mins, 0) = 0 THEN 'invalid' ELSE 'start' END
          WHEN starts_with(cmd, 'start ') THEN CASE WHEN moment IS NULL THEN 'invalid' ELSE 'start' END
          WHEN starts_with(cmd, 'end +') THEN CASE WHEN coalesce(mins, 0) = 0 THEN 'invalid' ELSE 'end' END
          WHEN starts_with(cmd, 'end ') THEN CASE WHEN moment IS NULL THEN 'invalid' ELSE 'end' END
          ELSE 'invalid' END AS action FROM cmds""",
    "actions": f"""
        SELECT instance, seq, ts_us, action,
          CASE action WHEN 'window' THEN ts_us WHEN 'start' THEN coalesce(moment, ts_us + mins * {MINUTE}) END AS start_us,
          CASE action WHEN 'window' THEN ts_us + mins * {MINUTE} WHEN 'end' THEN coalesce(moment, ts_us + mins * {MINUTE}) END AS end_us
        FROM acts""",
}


@job("prj_maintenance_commands", "SELECT instance, seq, action, start_us, end_us FROM actions", "maint_commands", COMMANDS)
def prj_maintenance_commands(spark, sf):
    return sc.maintenance_commands(v.maint_commands(spark, sf)).drop("ts_us")


# The twin walks the commands one by one.
FOLD = {
    **COMMANDS,
    "numbered": "SELECT *, row_number() OVER (PARTITION BY instance ORDER BY ts_us, seq) AS k FROM actions",
    "fold": """
        SELECT instance, k, seq, CASE action WHEN 'manual' THEN 1 ELSE 0 END AS manual, start_us, end_us FROM numbered WHERE k = 1
        UNION ALL
        SELECT n.instance, n.k, n.seq,
          CASE n.action WHEN 'clear' THEN 0 WHEN 'manual' THEN 1 ELSE f.manual END,
          CASE n.action WHEN 'clear' THEN NULL WHEN 'window' THEN n.start_us WHEN 'start' THEN n.start_us ELSE f.start_us END,
          CASE n.action WHEN 'clear' THEN NULL WHEN 'window' THEN n.end_us WHEN 'end' THEN n.end_us
            WHEN 'start' THEN CASE WHEN f.end_us - n.start_us <= -1000000 THEN NULL ELSE f.end_us END ELSE f.end_us END
        FROM fold f JOIN numbered n ON n.instance = f.instance AND n.k = f.k + 1""",
}


@job("wn_maintenance_fold", "SELECT instance, seq, manual, start_us, end_us FROM fold", "maint_commands", FOLD)
def wn_maintenance_fold(spark, sf):
    return sc.maintenance_fold(v.maint_commands(spark, sf))


def duration_sql(s: str) -> str:
    def part(unit, label):
        return f"concat({s} // {unit}, '.', lpad(CAST(({s} % {unit}) * 100 // {unit} AS VARCHAR), 2, '0'), ' {label}')"

    return (f"CASE WHEN {s} >= 86400 THEN {part(86400, 'days')} WHEN {s} >= 3600 THEN {part(3600, 'hours')} "
            f"WHEN {s} >= 60 THEN {part(60, 'minutes')} ELSE concat({s}, ' seconds') END")


REPORT = {
    "latest": "SELECT * FROM maint QUALIFY row_number() OVER (PARTITION BY instance ORDER BY start_us DESC, window_id DESC) = 1",
    "servers": f"SELECT DISTINCT instance, instance IN ('{MANUAL[0]}') AS manual FROM up",
    "state": f"""
        SELECT s.instance, start_us, end_us, CASE WHEN manual THEN 1 WHEN start_us <= {v.TO_US} AND (end_us IS NULL OR {v.TO_US} <= end_us)
          THEN 3 ELSE 0 END AS status, abs(start_us - {v.TO_US}) // 1000000 AS ds, abs(end_us - {v.TO_US}) // 1000000 AS de
        FROM servers s LEFT JOIN latest USING (instance)""",
}


@job("prj_maintenance_report", f"""
    SELECT instance, status, CASE WHEN start_us IS NULL THEN '' WHEN start_us - {v.TO_US} >= 1000000 THEN concat('{WILL_START}', {duration_sql('ds')})
      WHEN status > 0 THEN concat('{SINCE}', {duration_sql('ds')}) ELSE '' END AS start_text,
      CASE WHEN status > 0 AND end_us - {v.TO_US} >= 1000000 THEN concat('{WILL_END}', {duration_sql('de')}) ELSE '' END AS end_text,
      coalesce(end_us - start_us <= -1000000, false) AS warn FROM state""", "up maint", REPORT)
def prj_maintenance_report(spark, sf):
    servers = v.up(spark, sf).select("instance").distinct().withColumn("manual", F.col("instance").isin(MANUAL))
    return sc.maintenance_report(servers, v.maint(spark, sf), v.TO_US)


# --- alerts ------------------------------------------------------------------------------

FOR_US = 10 * MINUTE
EPISODES = {
    "flags": """SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY instance ORDER BY ts_us, event_id), false) AS starts FROM evals""",
    "runs": "SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY instance ORDER BY ts_us, event_id) AS ep FROM flags",
    "eps": "SELECT instance, ep, min(ts_us) AS active_at, min(CASE WHEN NOT active THEN ts_us END) AS resolved_at FROM runs WHERE ep > 0 GROUP BY ALL",
}
EPISODES_SQL = f"""
    SELECT e.instance, e.active_at, (SELECT min(r.ts_us) FROM runs r WHERE r.instance = e.instance AND r.ep = e.ep AND r.active
      AND r.ts_us >= e.active_at + {FOR_US}) AS fires_at, e.resolved_at FROM eps e"""


@job("wn_alert_for", EPISODES_SQL, "evals", EPISODES)
def wn_alert_for(spark, sf):
    return al.alert_episodes(v.evals(spark, sf), FOR_US)


KEEP_US = 2 * HOUR
# Walks the evaluations of a server one by one: what is active, since when, fired when, false since when.
KEPT = {
    "steps": "SELECT *, row_number() OVER (PARTITION BY instance ORDER BY ts_us, event_id) AS k FROM evals",
    "walk": f"""
        SELECT instance, k, ts_us, CASE WHEN active THEN ts_us END AS act, CAST(NULL AS BIGINT) AS fired, CAST(NULL AS BIGINT) AS fell,
          CAST(NULL AS BIGINT) AS ended_act, CAST(NULL AS BIGINT) AS ended_fired FROM steps WHERE k = 1
        UNION ALL
        SELECT n.instance, n.k, n.ts_us,
          CASE WHEN n.active THEN coalesce(w.act, n.ts_us)
               WHEN w.fired IS NULL OR n.ts_us >= coalesce(w.fell, n.ts_us) + {KEEP_US} THEN NULL ELSE w.act END,
          CASE WHEN n.active THEN CASE WHEN w.fired IS NOT NULL THEN w.fired WHEN n.ts_us >= coalesce(w.act, n.ts_us) + {FOR_US} THEN n.ts_us END
               WHEN n.ts_us >= coalesce(w.fell, n.ts_us) + {KEEP_US} THEN NULL ELSE w.fired END,
          CASE WHEN n.active THEN NULL WHEN w.fired IS NULL OR n.ts_us >= coalesce(w.fell, n.ts_us) + {KEEP_US} THEN NULL ELSE coalesce(w.fell, n.ts_us) END,
          CASE WHEN NOT n.active AND w.act IS NOT NULL AND (w.fired IS NULL OR n.ts_us >= coalesce(w.fell, n.ts_us) + {KEEP_US}) THEN w.act END,
          CASE WHEN NOT n.active AND w.fired IS NOT NULL AND n.ts_us >= coalesce(w.fell, n.ts_us) + {KEEP_US} THEN w.fired END
        FROM walk w JOIN steps n ON n.instance = w.instance AND n.k = w.k + 1""",
    "last": "SELECT instance, act, fired FROM walk QUALIFY row_number() OVER (PARTITION BY instance ORDER BY k DESC) = 1",
}


@job("wn_alert_keep", """
    SELECT instance, ended_act AS active_at, ended_fired AS fires_at, ts_us AS resolved_at FROM walk WHERE ended_act IS NOT NULL
    UNION ALL SELECT instance, act, fired, NULL FROM last WHERE act IS NOT NULL""", "evals", KEPT)
def wn_alert_keep(spark, sf):
    return al.alert_episodes(v.evals(spark, sf), FOR_US, keep_us=KEEP_US)


NO_END = 9_000_000_000_000_000_000
# The twins cut an alert at every boundary inside it and keep the pieces that nothing covers.
INHIBIT = {
    "spans": f"SELECT *, starts_us AS s, coalesce(ends_us, {NO_END}) AS e FROM alerts",
    "src": "SELECT alertname, instance, s, e FROM spans WHERE severity = 'critical' AND e > s",
    "tgt": "SELECT * FROM spans WHERE severity = 'warning' AND e > s",
    "pts": """
        SELECT alert_id, s AS p FROM tgt UNION SELECT alert_id, e FROM tgt
        UNION SELECT t.alert_id, c.s FROM tgt t JOIN src c USING (alertname, instance) WHERE c.s > t.s AND c.s < t.e
        UNION SELECT t.alert_id, c.e FROM tgt t JOIN src c USING (alertname, instance) WHERE c.e > t.s AND c.e < t.e""",
    "segs": "SELECT alert_id, p AS ps, lead(p) OVER (PARTITION BY alert_id ORDER BY p) AS pe FROM pts",
    "free": """
        SELECT t.alert_id, t.severity, t.instance, g.ps, g.pe FROM segs g JOIN tgt t USING (alert_id)
        WHERE g.pe IS NOT NULL AND NOT EXISTS (SELECT 1 FROM src c WHERE c.alertname = t.alertname AND c.instance = t.instance AND c.s <= g.ps AND c.e > g.ps)""",
}


@job("jn_alert_inhibit", f"""
    SELECT alert_id, severity, instance, ps AS starts_us, nullif(pe, {NO_END}) AS ends_us FROM free
    UNION ALL SELECT alert_id, severity, instance, starts_us, ends_us FROM alerts WHERE severity <> 'warning'""", "alerts", INHIBIT)
def jn_alert_inhibit(spark, sf):
    return al.alert_inhibit(v.alerts(spark, sf)).select("alert_id", "severity", "instance", "starts_us", "ends_us")


SUPPRESS = {
    "spans": f"""
        SELECT a.*, starts_us AS s, coalesce(ends_us, {v.TO_US}) AS e, c.shift
        FROM alerts a LEFT JOIN (SELECT DISTINCT instance, (dst - zone) * 3600 AS shift FROM calendar) c USING (instance)
        WHERE instance NOT IN ('{"', '".join(MANUAL)}') AND coalesce(ends_us, {v.TO_US}) > starts_us""",
    "days": """
        SELECT *, unnest(range((s // 1000000 + shift) // 86400, ((e - 1) // 1000000 + shift) // 86400 + 1)) AS d
        FROM spans WHERE shift IS NOT NULL""",
    "hours": """
        SELECT d.*, c.start_s AS a, c.end_s AS b FROM days d JOIN calendar c
          ON c.instance = d.instance AND c.weekday = (d.d + 4) % 7 AND c.is_business_day""",
    "cuts": """
        SELECT alert_id, severity, instance, ends_us, s, e, s AS a, e AS b FROM spans WHERE shift IS NULL
        UNION ALL SELECT alert_id, severity, instance, ends_us, s, e, (d * 86400 + a - shift) * 1000000, (d * 86400 + b + 1 - shift) * 1000000 FROM hours WHERE a <= b
        UNION ALL SELECT alert_id, severity, instance, ends_us, s, e, (d * 86400 - shift) * 1000000, (d * 86400 + b + 1 - shift) * 1000000 FROM hours WHERE a > b
        UNION ALL SELECT alert_id, severity, instance, ends_us, s, e, (d * 86400 + a - shift) * 1000000, (d * 86400 + 86400 - shift) * 1000000 FROM hours WHERE a > b""",
    "parts": """
        SELECT row_number() OVER () AS k, * FROM (SELECT alert_id, severity, instance, ends_us, greatest(s, a) AS ps, least(e, b) AS pe FROM cuts) WHERE pe > ps""",
    "win": f"SELECT instance, start_us AS s, coalesce(end_us + 1, {NO_END}) AS e FROM maint",
    "pts": """
        SELECT k, ps AS p FROM parts UNION SELECT k, pe FROM parts
        UNION SELECT k, w.s FROM parts t JOIN win w USING (instance) WHERE w.s > t.ps AND w.s < t.pe
        UNION SELECT k, w.e FROM parts t JOIN win w USING (instance) WHERE w.e > t.ps AND w.e < t.pe""",
    "segs": "SELECT k, p AS gs, lead(p) OVER (PARTITION BY k ORDER BY p) AS ge FROM pts",
}


@job("jn_alert_suppress", f"""
    SELECT alert_id, severity, t.instance, gs AS starts_us, CASE WHEN ends_us IS NULL AND ge = {v.TO_US} THEN NULL ELSE ge END AS ends_us
    FROM segs g JOIN parts t USING (k) WHERE ge IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM win w WHERE w.instance = t.instance AND w.s <= g.gs AND w.e > g.gs)""", "alerts calendar maint", SUPPRESS)
def jn_alert_suppress(spark, sf):
    out = al.alert_suppress(v.alerts(spark, sf), v.calendar(spark), v.maint(spark, sf), v.TO_US, manual(spark))
    return out.select("alert_id", "severity", "instance", "starts_us", "ends_us")


# An alert was last reported when its condition last held before the instant.
REPORTED = {"reported": f"""
    SELECT a.*, coalesce(ends_us, u + 300000000) AS over_us FROM alerts a LEFT JOIN (
      SELECT instance, severity, max(ts_us) AS u FROM alert_evals WHERE ts_us <= {v.AT_US} GROUP BY ALL) USING (instance, severity)"""}


@job("ag_alert_groups", f"""
    SELECT alertname, coalesce(cluster, '') AS cluster, coalesce(service, '') AS service, count(*) AS n, min(starts_us) AS starts_us
    FROM reported WHERE starts_us <= {v.AT_US} AND over_us > {v.AT_US} GROUP BY ALL""", "alert_evals alerts", REPORTED)
def ag_alert_groups(spark, sf):
    heard = v.alert_evals(spark, sf).where(F.col("ts_us") <= v.AT_US).groupBy("instance", "severity").agg(F.max("ts_us").alias("updated_us"))
    return al.alert_groups(v.alerts(spark, sf).join(heard, ["instance", "severity"], "left"), v.AT_US, updated="updated_us")


# Annotation texts of the down rule.
TEMPLATES = {"summary": "Instance down", "description": "{{ $labels.instance }} is unreachable"}


@job("prj_alert_text", "SELECT alert_id, 'Instance down' AS summary, concat(instance, ' is unreachable') AS description FROM alerts", "alerts")
def prj_alert_text(spark, sf):
    return al.alert_text(v.alerts(spark, sf), TEMPLATES).select("alert_id", "summary", "description")
