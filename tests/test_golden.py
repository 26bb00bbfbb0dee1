"""Vectors worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetgauge.constants import HOUR, MINUTE, SECOND
from fleetgauge.functions import text as tx
from fleetgauge.operators import alerts, filters, health, labels, mailbox, normalize, rangevec, schedule
from fleetgauge.sources import exposition, logs, reports


def values(spark, items, kind, expr):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def test_metric_name(spark):
    got = values(spark, ["Disk./.Free", "Server.Trans.PerMinute", "a.b c", "a_b c", "Größe.x"], "string", tx.sanitized)
    assert got == ["Disk_C_Free", "Server_Trans_PerMinute", "a_b_c", "a_b_c", "Gr__e_x"]


def test_metric_name_prefix(spark):
    rows = spark.createDataFrame([("Server", "Users")], "facility string, stat string")
    assert normalize.metric_names(rows, "X").first()["metric"] == "X_Server_Users"
    assert normalize.metric_names(rows, None).first()["metric"] == "Server_Users"


def test_help_text(spark):
    assert values(spark, ["  a\tb   c ", "", "x\n\x01 y"], "string", tx.help_text) == ["ab c", "", "x y"]


def test_first_token(spark):
    assert values(spark, ["ab cd", "ab", " x"], "string", tx.first_token) == ["ab", "ab", ""]


def test_fixed_milli(spark):
    numbers = [0.0, 2.5, 1.2345, 0.0005, -1.5, 1234567.8915, 99.9996, -0.25]
    want = ["0.000", "2.500", "1.235", "0.001", "-1.500", "1234567.892", "100.000", "-0.250"]
    assert values(spark, numbers, "double", lambda c: tx.milli_text(tx.to_milli(c))) == want


def test_ms_to_seconds(spark):
    assert values(spark, [0, 7, 1234, 60000], "bigint", tx.milli_text) == ["0.000", "0.007", "1.234", "60.000"]


def test_duration_text(spark):
    want = ["59 seconds", "1.00 minutes", "1.50 minutes", "59.98 minutes", "1.50 hours", "23.99 hours", "1.15 days"]
    assert values(spark, [59, 60, 90, 3599, 5400, 86399, 100000], "bigint", tx.duration_text) == want


def test_epoch_values(spark):
    rows = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 0, 0, 1, 230000)), (2, dt.datetime(1899, 12, 31)), (3, dt.datetime(1970, 1, 1)),
         (4, dt.datetime(1969, 12, 31, 23, 59, 59))], "id int, ts timestamp_ntz")
    got = {r["id"]: (r["epoch_s"], r["iso_text"]) for r in normalize.epoch_values(rows).collect()}
    assert got == {1: (1704067201, "2024-01-01T00:00:01:23Z"), 4: (-1, "1969-12-31T23:59:59:00Z")}


def test_extent_number(spark):
    names = ["S0000123.TXN", "S12", "X5.TXN", "S1a.TXN", "S.TXN", "S0000000.TXN", "S" + "9" * 30]
    assert values(spark, names, "string", health.extent_number) == [123, 12, None, None, None, 0, None]


def test_extent_listing_and_summary(spark):
    rows = spark.createDataFrame([("a", "S1.TXN"), ("a", "S1.txn"), ("a", "X.TXN"), ("a", "S7.TXN")], "instance string, filename string")
    assert sorted(r["filename"] for r in health.extent_listing(rows).collect()) == ["S1.TXN", "S7.TXN", "X.TXN"]
    assert tuple(health.extent_summary(rows).first()) == ("a", 3, 1, 7)


@pytest.mark.parametrize("spec, days, valid", [
    ("1-5", {1, 2, 3, 4, 5}, True), ("5-1", {5, 6, 0, 1}, True), ("1-5,0", {0, 1, 2, 3, 4, 5}, True),
    ("7", set(), False), ("1,x,3", {1, 3}, False), ("-1", set(), False), ("2-2", {2}, True), ("", set(), True),
])
def test_weekdays(spark, spec, days, valid):
    config = spark.createDataFrame([("a", True, spec, None)], "instance string, calendar_on boolean, days string, hours string")
    none = spark.createDataFrame([], "instance string, weekday int, hours string")
    rows = schedule.calendar_from_spec(config, none).collect()
    assert len(rows) == 7 and {r["weekday"] for r in rows if r["is_business_day"]} == days
    assert {r["valid"] for r in rows} == {valid}
    assert {(r["start_s"], r["end_s"]) for r in rows} == {(21600, 64800)}


@pytest.mark.parametrize("spec, start, end, valid", [
    ("6-18", 21600, 64800, True), ("06:00-13:30", 21600, 48600, True), ("06:30:00-18:00:15", 23400, 64815, True),
    ("6:30-18", 21600, 0, False), ("soon", 0, 0, False), ("6-18:30", 21600, 64800, True),
])
def test_hours(spark, spec, start, end, valid):
    a, b, ok = schedule.hours_seconds(F.lit(spec))
    assert tuple(spark.range(1).select(a, b, ok).first()) == (start, end, valid)


def test_calendar_override_and_off(spark):
    config = spark.createDataFrame([("a", True, None, None), ("b", False, None, None)],
                                   "instance string, calendar_on boolean, days string, hours string")
    special = spark.createDataFrame([("a", 5, "6-13")], "instance string, weekday int, hours string")
    rows = {(r["instance"], r["weekday"]): r["end_s"] for r in schedule.calendar_from_spec(config, special).collect()}
    assert rows[("a", 5)] == 13 * 3600 and rows[("a", 4)] == 18 * 3600 and len(rows) == 7


def at(text):  # Monday 2024-01-01 is a weekday, Sunday 2023-12-31 is not
    return int(dt.datetime.fromisoformat(text + "+00:00").timestamp()) * SECOND


def hours_at(spark, calendar, instants):
    rows = spark.createDataFrame([("a", at(t)) for t in instants], "instance string, ts_us bigint")
    out = {r["ts_us"]: (r["business_day"], r["business_hours"]) for r in schedule.business_time(rows, calendar).collect()}
    return [out[at(t)] for t in instants]


def week(spark, days, start, end, zone=0, dst=0):
    return spark.createDataFrame(
        [("a", d, d in days, start, end, zone, dst) for d in range(7)],
        "instance string, weekday int, is_business_day boolean, start_s int, end_s int, zone int, dst int")


def test_business_time(spark):
    day = week(spark, {1, 2, 3, 4, 5}, 6 * 3600, 18 * 3600)
    got = hours_at(spark, day, ["2024-01-01T05:59:59", "2024-01-01T06:00:00", "2024-01-01T18:00:00", "2024-01-01T18:00:01", "2023-12-31T12:00:00"])
    assert got == [(1, 0), (1, 1), (1, 1), (1, 0), (0, 0)]
    night = week(spark, {0, 1, 2}, 22 * 3600, 6 * 3600)
    got = hours_at(spark, night, ["2024-01-01T22:00:00", "2024-01-01T06:00:00", "2024-01-01T06:00:01", "2024-01-03T01:00:00"])
    assert got == [(1, 1), (1, 1), (1, 0), (0, 0)]  # after midnight the new day counts
    local = week(spark, {1, 2, 3, 4, 5}, 6 * 3600, 18 * 3600, -1, 1)
    assert hours_at(spark, local, ["2024-01-01T04:00:00", "2024-01-01T03:59:59"]) == [(1, 1), (1, 0)]
    assert hours_at(spark, day.where("false"), ["2023-12-31T12:00:00"]) == [(1, 1)]


def test_maintenance_status(spark):
    rows = spark.createDataFrame([(i, t) for i in "abcd" for t in (0, 100 * MINUTE, 250 * MINUTE, 250 * MINUTE + SECOND)], "instance string, ts_us bigint")
    maint = spark.createDataFrame(
        [("a", 100 * MINUTE, 250 * MINUTE), ("a", 110 * MINUTE, 120 * MINUTE), ("b", 100 * MINUTE, None), ("c", 0, 900 * MINUTE), ("d", None, 100 * MINUTE)],
        "instance string, start_us bigint, end_us bigint")
    manual = spark.createDataFrame([("c",)], "instance string")
    out = schedule.maintenance_status(rows, maint, manual).orderBy("instance", "ts_us").collect()
    assert [r["maintenance_status"] for r in out] == [0, 3, 3, 0, 0, 3, 3, 3, 1, 1, 1, 1, 0, 0, 0, 0]


def test_maintenance_commands(spark):
    texts = ["off", "Clear", "on", "on 30", "on x", "start +10", "start +", "start 2024-01-01 10:00", "start later", "end +5", "end 2024-01-01 10:00:30", "nope"]
    rows = spark.createDataFrame([("a", i, 0, t) for i, t in enumerate(texts)], "instance string, seq bigint, ts_us bigint, cmd string")
    out = schedule.maintenance_commands(rows).orderBy("seq").collect()
    assert [r["action"] for r in out] == ["clear", "clear", "manual", "window", "manual", "start", "invalid", "start", "invalid", "end", "end", "invalid"]
    assert (out[3]["start_us"], out[3]["end_us"]) == (0, 30 * MINUTE)
    assert out[5]["start_us"] == 10 * MINUTE and out[7]["start_us"] == at("2024-01-01T10:00:00")
    assert out[9]["end_us"] == 5 * MINUTE and out[10]["end_us"] == at("2024-01-01T10:00:30")


def mail_at(spark, waits, scan):
    rows = [("a", i, "mail.box", scan - w * SECOND, "N", False) for i, w in enumerate(waits)]
    return spark.createDataFrame(rows, "instance string, note_id bigint, mailbox string, added_us bigint, delivery_priority string, has_send_at boolean")


def test_mail_age_buckets(spark):
    scan = at("2024-01-05T00:00:00")
    mail = mail_at(spark, [299, 300, 899, 900, 3599, 3600], scan)
    row = mailbox.age_buckets(mail, scan, scan, 300 * SECOND, min_wait_us=0).first()
    assert (row["lt_5m"], row["m5_15"], row["m15_60"], row["ge_60m"], row["avg_s"]) == (1, 2, 2, 1, 1599)
    row = mailbox.age_buckets(mail, scan, scan, 300 * SECOND).first()
    assert (row["lt_5m"], row["n"]) == (0, 5)


def test_mail_edges_and_errors(spark):
    scan, full = at("2024-01-05T00:00:00"), 72 * 3600
    mail = mail_at(spark, [full, full + 1, full - 1, 300, 299, -5], scan).unionByName(
        spark.createDataFrame([("a", 9, "mail.box", None, "N", False)], "instance string, note_id bigint, mailbox string, added_us bigint, delivery_priority string, has_send_at boolean"))
    row = mailbox.age_buckets(mail, scan, scan, 300 * SECOND).first()
    assert (row["n"], row["errors"], row["m5_15"], row["ge_60m"]) == (3, 1, 1, 2)
    assert sorted(r["wait_s"] for r in mailbox.pending(mail, scan).collect()) == [300, full - 1, full]


def test_empty_mail_queue_counts_zero(spark):
    scan = at("2024-01-05T00:00:00")
    servers = spark.createDataFrame([("a",), ("b",)], "instance string")
    out = mailbox.age_buckets(mail_at(spark, [400, 10], scan), scan, scan + 600 * SECOND, 300 * SECOND, servers=servers).collect()
    got = {(r["instance"], (r["scan_us"] - scan) // SECOND): (r["n"], r["avg_s"], r["errors"]) for r in out}
    assert got == {("a", 0): (1, 400, 0), ("a", 300): (2, 505, 0), ("a", 600): (2, 805, 0), ("b", 0): (0, 0, 0), ("b", 300): (0, 0, 0), ("b", 600): (0, 0, 0)}


def test_prefix_rules(spark):
    names = ["platform.cpu", "Platform.Network.Total.x", "traveler.push.x", "traveler.x", "Server.Users"]
    rows = spark.createDataFrame([tuple(n.split(".", 1)) for n in names], "facility string, stat string")

    def kept(df):
        return sorted(f"{r['facility']}.{r['stat']}" for r in df.collect())

    want = ["Platform.Network.Total.x", "Server.Users", "traveler.push.x"]
    assert kept(filters.prefix_rules(rows)) == want
    from fleetgauge.constants import DEFAULT_EXCLUDES, DEFAULT_INCLUDES
    sizes = []
    for n in (300, 10_000):  # the plan doesn't grow with the rules
        many = spark.createDataFrame([(p,) for p in DEFAULT_EXCLUDES] + [(f"nothing{i:05d}.",) for i in range(n)] + [(None,)], "prefix string")
        found = filters.prefix_rules(rows, DEFAULT_INCLUDES, many)
        assert kept(found) == want
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 200
    assert kept(filters.prefix_rules(rows, DEFAULT_INCLUDES, DEFAULT_EXCLUDES + [f"nothing{i}." for i in range(300)])) == want
    none = spark.createDataFrame([], "prefix string")
    assert len(kept(filters.prefix_rules(rows, none, none))) == 5
    assert kept(filters.prefix_rules(rows, none, spark.createDataFrame([("",)], "prefix string"))) == []


def test_missing_labels_are_empty(spark):
    rows = spark.createDataFrame([(1, {"op": "x"}), (2, {}), (3, {"op": "x\n"}), (4, {"op": ""})], "i int, labels map<string,string>")
    rows = rows.withColumn("series_key", F.to_json("labels"))

    def ids(df):
        return sorted(r["i"] for r in df.collect())

    assert ids(filters.label_match(rows, {"op": ""})) == [2, 4] and ids(filters.label_match(rows, {"op": "x"})) == [1]
    assert ids(filters.label_regex(rows, "op", ".*")) == [1, 2, 3, 4] and ids(filters.label_regex(rows, "op", "x")) == [1]
    series = filters.series_of(rows)
    for matcher, want in ((("op", "=", ""), [2, 4]), (("op", "!=", "x"), [2, 3, 4]), (("op", "=~", "x|"), [1, 2, 4]), (("op", "!~", "x.*"), [2, 4])):
        assert ids(filters.select_series(rows, series, [matcher])) == want, matcher
    assert ids(filters.select_series(rows, series, [])) == [1, 2, 3, 4]


def test_matchers_run_once_a_series(spark):
    """A thousand samples of three series: the regular expression sees three rows."""
    rows = spark.range(1000).select(F.col("id"), F.create_map(F.lit("op"), F.concat(F.lit("o"), F.col("id") % 3)).alias("labels"))
    rows = rows.withColumn("series_key", F.col("labels")["op"])
    out = filters.select_series(rows, filters.series_of(rows), [("op", "=~", "o[12]")])
    assert out.count() == 666
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    match, aggregate = (next(i for i, line in enumerate(plan) if x in line) for x in ("RLIKE", "Aggregate"))
    assert match < aggregate  # above the aggregate: after it


def test_rows_without_facility_or_target_stay(spark):
    rows = spark.createDataFrame([(1, "Own"), (2, "Other"), (3, None)], "i int, facility string")
    assert sorted(r["i"] for r in filters.drop_facility(rows, "OWN").collect()) == [2, 3]
    samples = spark.createDataFrame([("j", "a"), ("j", "b")], "job string, instance string")
    targets = spark.createDataFrame([("j", "a", "p", "n")], "job string, instance string, pod string, namespace string")
    assert sorted(map(tuple, labels.target_labels(samples, targets).collect())) == [("j", "a", "p", "n"), ("j", "b", "", "")]


def test_first_wins(spark):
    rows = spark.createDataFrame(
        [(1, 0, "a", "Server", "Users", 1), (2, 0, "a", "SERVER", "users", 2), (3, 0, "a", "x", "a.b", 3), (4, 0, "a", "x", "a_b", 4)],
        "event_id bigint, snapshot bigint, instance string, facility string, stat string, value_milli bigint")
    out = {r["key"]: (r["value"], r["n_dup"], r["n_collide"]) for r in normalize.first_wins(rows).collect()}
    assert out == {"server.users": (1, 1, 0), "x.a.b": (3, 0, 1), "x.a_b": (4, 0, 1)}


def test_storage_status(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 0, 1)], "instance string, store_on int, store_catalog_status int")
    out = {(r["instance"], r["metric"]): r["value"] for r in health.storage_status(rows).collect()}
    assert out[("a", "daos_catalog_not_synced")] == 0 and out[("b", "daos_catalog_not_synced")] == 1
    assert [k for k in out if k[0] == "c"] == [("c", "daos_status")]


def test_server_state(spark):
    rows = spark.createDataFrame(
        [("a", 0, "RESTRICTED", 9, None, 9), ("b", 0, "OTHER", 9, None, 9), ("c", 0, None, 5, None, 7), ("d", 0, None, 5, "OTHER", 7), ("e", 0, "UNAVAILABLE", 5, None, 7)],
        "instance string, ts_us bigint, ping_err string, ping_ms int, open_err string, open_ms int")
    out = {r["instance"]: (r["state"], r["ping_ms"], r["response_ms"]) for r in health.server_state(rows).collect()}
    assert out == {"a": (1, 0, None), "b": (3, None, None), "c": (0, 5, 7), "d": (3, None, None), "e": (2, 0, None)}


def test_bytes_to_mb(spark):
    assert values(spark, [1048576, 1572864, 0, 1049], "bigint", health.mega) == [1.0, 1.5, 0.0, 0.001]


def test_trans_report(spark):
    text = "x\r\nFunction  Count\r\n\r\n----\r\nOPEN DB  10 1 9 50 5\r\n  3 3 3 3 3\r\nCLOSE/X  1 2 3 4 5 trailing\r\nnot a row\r\nAFTER  1 1 1 1 1\r\n"
    rows = spark.createDataFrame([("a", "d", text), ("b", "d", "no table"), ("c", "d", "Function\nonly")], "instance string, d string, text string")
    out = [tuple(r)[2:] for r in reports.parse_captures(rows).collect()]
    assert out == [("OPEN_DB", 10, 1, 9, 50, 5), ("CLOSECX", 1, 2, 3, 4, 5)]


def test_trans_report_names(spark):
    long = "N" * 70
    text = f"Function\n\n--\n{long}a  1 1 1 1 1\n{long}b  1 1 1 1 1\nA  B  1 2 3 4 5\n"
    rows = reports.parse_captures(spark.createDataFrame([("a", "d", text)], "instance string, d string, text string"))
    assert [r["op"] for r in rows.collect()] == [f"{long}a", f"{long}b"]  # a name ends at the first two blanks
    assert {r["op"]: r["n"] for r in reports.totals_by_op(rows).collect()} == {f"{long}a": 1, f"{long}b": 1}


def test_totals_drop_equal_rows(spark):
    rows = spark.createDataFrame([("a", "d", "X", 1, 5), ("a", "d", "X", 1, 5), ("a", "d", "X", 2, 5)], "instance string, d string, op string, count bigint, total_ms bigint")
    assert tuple(reports.totals_by_op(rows).first()) == ("a", "d", "X", 3, 10)


def test_exposition_line(spark):
    rows = spark.createDataFrame([("s", "H_disk_free_bytes", {"path": "/d", "component": "DAOS"}, "42")], "f string, name string, labels map<string,string>, value_text string")
    fam = spark.createDataFrame([("H_disk_free_bytes", 1, "gauge", "Free disk space in bytes")], "name string, family_no int, type string, help string")
    lines = [r["line"] for r in exposition.render(rows, fam, ["f"]).orderBy("line_no").collect()]
    assert lines == ["# HELP H_disk_free_bytes Free disk space in bytes", "# TYPE H_disk_free_bytes gauge",
                     'H_disk_free_bytes{component="DAOS", path="/d"} 42']


def test_exposition_round_trip(spark, tmp_path):
    nasty = 'a\\b"c\nd,}='
    rows = spark.createDataFrame(
        [("s", "m", {"x": nasty, "op": "A"}, "1.5"), ("s", "m", {}, "-2"), ("s", "n", {"op": "B"}, "NaN")],
        "f string, name string, labels map<string,string>, value_text string")
    fam = spark.createDataFrame([("m", 1, "counter", "help  text"), ("n", 2, "gauge", "")], "name string, family_no int, type string, help string")
    exposition.write_exposition(exposition.render(rows, fam, ["f"]), str(tmp_path / "t"), ["f"])
    back = exposition.parse_samples(exposition.read_lines(spark, str(tmp_path / "t"), "f=([^/]+)")).collect()
    assert {(r["name"], tuple(sorted(r["labels"].items())), str(r["value"])) for r in back} == {
        ("m", (("op", "A"), ("x", nasty)), "1.5"), ("m", (), "-2.0"), ("n", (("op", "B"),), "nan")}
    full = exposition.read_exposition(spark, str(tmp_path / "t"), "f=([^/]+)").where("name = 'm'").first()
    assert (full["type"], full["help"], full["file"]) == ("counter", "help  text", "s")


def test_exposition_foreign_lines(spark):
    rows = spark.createDataFrame([("up 1",), ('x{a="1",b="2"} 3.5 1700000000000',), ("# a comment",), ("",), ("bad line here x",), ('y{a="1" 2',), ("z +Inf",)], "value string")
    out = {r["series_key"]: r["value"] for r in exposition.parse_samples(rows).collect()}
    assert out == {"up": 1.0, 'x{a="1", b="2"}': 3.5, "z": float("inf")}


def test_access_log(spark):
    lines = [
        '{"time":"2024-01-01T01:00:00+01:00","status":200,"method":"GET","uri":"/a","request_time":0.125,"bytes_sent":1}',
        '{"time":"2024-01-01T00:00:00Z","status":500', "plain text", '{"status":404,"method":"GET","uri":"/b"}',
    ]
    rows = logs.log_times(logs.parse_access_log(spark.createDataFrame(list(enumerate(lines)), "event_id int, line string")))
    out = {r["event_id"]: (r["ts_us"], r["status"], r["corrupt"]) for r in rows.collect()}
    assert out == {0: (at("2024-01-01T00:00:00"), 200, False), 1: (None, None, True), 2: (None, None, True), 3: (None, 404, False)}


def test_log_lines_are_numbered(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = logs.read_log(spark, str(tmp_path), "mail").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["job"], r["file"]) for r in rows} == {("mail", "a.log")}
    assert all(r["line"] == f"line {r['line_no']}" for r in rows) and len(rows) == 2000


def counter(spark, points):
    return spark.createDataFrame([("a", "x", i, t, v) for i, (t, v) in enumerate(points)],
                                 "instance string, op string, event_id bigint, ts_us bigint, count_total bigint")


def test_increase(spark):
    rows = counter(spark, [(10, 5), (20, 8), (30, 2), (40, 4), (500, 9)])
    out = {r["step_us"]: (r["inc"], r["n"]) for r in rangevec.increase(rows, 100, 100).collect()}
    assert out == {100: (7, 4)}
    assert {r["step_us"] for r in rangevec.irate(rows, 100, 100).collect()} == {100}
    assert rangevec.irate(rows, 100, 100).first()["irate"] == 2 * SECOND / 10
    resets = rangevec.counter_resets(rows).collect()
    assert [(r["ts_us"], r["before"], r["after"]) for r in resets] == [(30, 8, 2)]


def test_vector_match_by_zero(spark):
    left = spark.createDataFrame([("a", 1, 4.0), ("b", 1, 1.0), ("c", 1, 1.0)], "i string, step_us bigint, value double")
    right = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 0.0)], "i string, step_us bigint, value double")
    out = {r["i"]: r["value"] for r in rangevec.vector_match(left, right, "/", ["i", "step_us"]).collect()}
    assert out == {"a": 2.0, "b": None}


def test_max_points():
    assert rangevec.bounded_step(0, 30 * 24 * HOUR, 15 * SECOND) == 60 * SECOND
    assert rangevec.bounded_step(0, HOUR, 15 * SECOND) == 15 * SECOND


def test_alert_text(spark):
    rows = spark.createDataFrame([("p1", None)], "pod string, namespace string")
    out = alerts.alert_text(rows, {"t": "pod {{ $labels.pod }} in {{$labels.namespace}}."}).first()
    assert out["t"] == "pod p1 in ."


def test_inhibit(spark):
    rows = spark.createDataFrame(
        [("w1", "n", "warning", "a", 10, 20), ("c1", "n", "critical", "a", 19, 30), ("w2", "n", "warning", "a", 30, 40),
         ("w3", "m", "warning", "a", 10, 20), ("w4", "n", "warning", "a", 25, None), ("i1", "n", "info", "a", 20, 25),
         ("w5", "n", "warning", "a", 5, 19)],
        "alert_id string, alertname string, severity string, instance string, starts_us bigint, ends_us bigint")
    got = sorted((r["alert_id"], r["starts_us"], r["ends_us"]) for r in alerts.alert_inhibit(rows).collect())
    assert got == [("c1", 19, 30), ("i1", 20, 25), ("w1", 10, 19), ("w2", 30, 40), ("w3", 10, 20), ("w4", 30, None), ("w5", 5, 19)]


def test_inhibit_cuts_out_the_covered_time(spark):
    rows = spark.createDataFrame(
        [("w", "n", "warning", None, 0, 100), ("c1", "n", "critical", None, 10, 30), ("c2", "n", "critical", "", 20, 40), ("c3", "n", "critical", None, 60, 60),
         ("c4", "n", "critical", None, 70, 120)], "alert_id string, alertname string, severity string, instance string, starts_us bigint, ends_us bigint")
    got = sorted((r["starts_us"], r["ends_us"]) for r in alerts.alert_inhibit(rows).where("alert_id = 'w'").collect())
    assert got == [(0, 10), (40, 70)]


def test_suppress_keeps_the_rest(spark):
    day = at("2024-01-01T00:00:00")
    rows = spark.createDataFrame([("x", "a", day + 5 * HOUR, day + 15 * HOUR), ("y", "free", day, None), ("z", "off", day, day + HOUR)],
                                 "alert_id string, instance string, starts_us bigint, ends_us bigint")
    maint = spark.createDataFrame([("a", day + 8 * HOUR, day + 9 * HOUR - 1)], "instance string, start_us bigint, end_us bigint")
    manual = spark.createDataFrame([("off",)], "instance string")
    out = alerts.alert_suppress(rows, week(spark, {1, 2, 3, 4, 5}, 6 * 3600, 18 * 3600 - 1), maint, day + 24 * HOUR, manual)
    got = sorted((r["alert_id"], (r["starts_us"] - day) // HOUR, r["ends_us"] and (r["ends_us"] - day) // HOUR) for r in out.collect())
    assert got == [("x", 6, 8), ("x", 9, 15), ("y", 0, None)]


def test_window_without_end_in_sight(spark):
    rows = spark.createDataFrame([("a", 5 * HOUR)], "instance string, ts_us bigint")
    maint = spark.createDataFrame([("a", 0, 250_000_000_000_000_000)], "instance string, start_us bigint, end_us bigint")
    assert schedule.maintenance_status(rows, maint).first()["maintenance_status"] == 3


def test_two_calendar_rows_for_a_weekday(spark):
    cal = week(spark, {1, 2, 3, 4, 5}, 6 * 3600, 18 * 3600)
    assert hours_at(spark, cal.unionByName(cal.withColumn("is_business_day", F.lit(False))), ["2024-01-01T12:00:00"]) == [(1, 1)]


def test_missing_label_is_a_series(spark):
    rows = spark.createDataFrame([(None, 1, 0, 5), (None, 2, MINUTE, 3), ("a", 3, 0, 1)], "instance string, event_id bigint, ts_us bigint, count_total bigint")
    out = rangevec.counter_resets(rows, keys=["instance"]).collect()
    assert [(r["instance"], r["before"], r["after"]) for r in out] == [(None, 5, 3)]


def test_large_and_quoted_numbers(spark):
    assert values(spark, [1e16, -2e16], "double", lambda c: tx.milli_text(tx.to_milli(c))) == ["10000000000000000.000", "-20000000000000000.000"]
    rows = spark.createDataFrame([('{"status":"200","uri":"/a","request_time":"x"}',), ("no json",)], "line string")
    got = [(r["status"], r["uri"], r["request_time"], r["corrupt"]) for r in logs.parse_access_log(rows).collect()]
    assert got == [(200, "/a", None, False), (None, None, None, True)]


def test_staleness(spark):
    rows = spark.createDataFrame([("a", 5 * SECOND, False), ("a", 9 * SECOND, True), ("b", 9 * SECOND, False), ("b", 1, True)], "instance string, ts_us bigint, shutdown boolean")
    out = {r["instance"]: (r["age_s"], r["ended"]) for r in labels.staleness(rows, 10 * SECOND).collect()}
    assert out == {"a": (1, True), "b": (1, False)}


def test_resolve_timeout(spark):
    rows = spark.createDataFrame([("a", None, 10), ("b", 7, 10), ("c", None, None)], "alert_id string, ends_us bigint, updated_us bigint")
    out = {r["alert_id"]: r["ends_us"] for r in alerts.with_resolve_timeout(rows).collect()}
    assert out == {"a": 10 + 5 * MINUTE, "b": 7, "c": None}


def test_retention(spark):
    from fleetgauge.operators import store
    rows = spark.createDataFrame([(d, 40) for d in range(10) for _ in range(2)], "day bigint, bytes bigint")
    out = {r["day"]: r["keep"] for r in store.retention(rows, 9, 5, 330).collect()}
    assert sorted(d for d, keep in out.items() if keep) == [6, 7, 8, 9] and len(out) == 10
    out = {r["day"]: r["keep"] for r in store.retention(rows, 9, 2, 10_000).collect()}
    assert sorted(d for d, keep in out.items() if keep) == [7, 8, 9]


def test_latest_state(spark):
    from fleetgauge.operators import store
    cols = "package string, name string, value bigint, ts_us bigint, event_id bigint"
    rows = spark.createDataFrame([("p", "a", 1, 1, 1), ("p", "a", 2, 2, 2), ("p", "b", 3, 1, 3), ("p", "b", None, 2, 4), ("q", "a", 5, 1, 5), ("q", "a", 6, 9, 6), ("q", "b", 7, 1, 7)], cols)
    wipe = spark.createDataFrame([("q", 5, 9)], "package string, ts_us bigint, event_id bigint")
    assert sorted(map(tuple, store.latest_state(rows, wipe).collect())) == [("p", "a", 2), ("q", "a", 6)]


def test_publish_shows_only_complete_versions(spark, tmp_path):
    from fleetgauge.operators import store
    path = str(tmp_path / "snap")
    assert store.publish(spark.range(3), path) == 1
    assert store.publish(spark.range(5), path) == 2
    (tmp_path / "snap" / "v=3").mkdir()  # a write that never finished
    assert store.read_published(spark, path).count() == 5
    assert store.publish(spark.range(7), path) == 3 and store.read_published(spark, path).count() == 7


def test_panes_of_an_odd_range(spark):
    rng, step = 9 * HOUR, 60_000_163
    rows = spark.range(2000).select(F.lit("a").alias("instance"), F.lit("o").alias("op"), (F.col("id") * 7 * SECOND + 3).alias("ts_us"))
    panes = rows.select(rangevec.pane_end(F.col("ts_us"), rng, step).alias("p")).distinct().count()
    assert panes <= 2 * (2000 * 7 * SECOND // step + 2)


def test_rejected_lines_are_told(spark):
    text = ["# HELP a b", "# TYPE a gauge", 'a{x="1}"} 5', "a 7 1700000000", "a{", "", "9a 1", "a x", 'a{y="1",y="2"} 3', "b\t2"]
    lines = spark.createDataFrame([(t,) for t in text], "value string")
    assert sorted(r["value"] for r in exposition.rejected_lines(lines).collect()) == sorted(["a{", "9a 1", "a x", 'a{y="1",y="2"} 3'])
    assert sorted((r["series_key"], r["value"]) for r in exposition.parse_samples(lines).collect()) == [("a", 7.0), ('a{x="1}"}', 5.0), ("b", 2.0)]
