"""The format ``prom``: same rows as the text reader, cut anywhere, with only wanted families parsed."""

import random

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from fleetgauge.sources import exposition, prom

TEXT = (
    '# HELP a_total What a \\ counts\n# TYPE a_total counter\na_total{op="x",q="1"} 3\na_total{op="y\\"\\\\\\n"} 4.5e3 1700000000\r\n'
    "# a remark\n\nplain 7\nb_seconds{} NaN\nb_seconds +Inf\nbad\nbad x\n1bad 3\ntwice{a=\"1\",a=\"2\"} 1\nopen{a=\"1\" 2\n"
    "# TYPE b_seconds gauge\n# HELP b_seconds\na_total{op=\"é} 1 {\"} -2"
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "d=1").mkdir()
    (tmp_path / "d=1" / "one.prom").write_bytes(TEXT.encode())
    (tmp_path / "d=1" / "two.prom").write_bytes(b"")
    (tmp_path / "three.prom").write_bytes(b"a_total 1\n")
    (tmp_path / "_hidden").write_bytes(b"a_total 1\n")
    return str(tmp_path)


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_same_rows_as_the_text_reader(spark, folder):
    got = prom.read_samples(spark, folder, None, "([^/]+)$")
    want = exposition.read_exposition(spark, folder, "([^/]+)$")
    assert rows_of(got) == rows_of(want) and got.count() == 7
    names = prom.read_samples(spark, folder, ["a_total", "none"], "([^/]+)$")
    assert rows_of(names) == rows_of(want.where("name = 'a_total'"))
    many = ["a_total", *map(str, range(5000))]
    assert rows_of(prom.read_samples(spark, folder, many, "([^/]+)$")) == rows_of(names)


def read_all(options, *filters):
    reader = prom.QueryReader(options)
    left = list(reader.pushFilters(list(filters)))
    return left, [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("size", [1, 2, 7, 50, 10_000])
def test_cuts_change_nothing(folder, size):
    assert repr(read_all({"path": folder, "splitBytes": str(size)})) == repr(read_all({"path": folder}))


def test_lines_of_any_cut_are_each_given_once(tmp_path):
    rng = random.Random(3)
    data = "".join(rng.choice("ab\n\r") for _ in range(300)).encode()
    (tmp_path / "f").write_bytes(data)
    store, path = prom.opened(str(tmp_path / "f"))
    with store.open_input_file(path) as f:
        whole = list(prom.lines_of(f, 0, len(data)))
        lines = data.split(b"\n")
        assert [x for _, x in whole] == [x[:-1] if x.endswith(b"\r") else x for x in (lines[:-1] if not lines[-1] else lines)]
        for step in (1, 3, 64):
            assert [x for s in range(0, len(data), step) for x in prom.lines_of(f, s, min(s + step, len(data)), 5)] == whole


def test_only_wanted_lines_are_parsed(folder, monkeypatch):
    seen, parse = [], prom.parsed
    monkeypatch.setattr(prom, "parsed", lambda line, kind, name, start: seen.append((kind, name)) or parse(line, kind, name, start))
    left, rows = read_all({"path": folder}, EqualTo(("name",), "a_total"), In(("kind",), ("sample", "TYPE")), GreaterThan(("value",), 0))
    assert left == [GreaterThan(("value",), 0)]
    assert len(seen) == len(rows) == 5 and set(seen) == {("sample", "a_total"), ("TYPE", "a_total")}
    seen.clear()
    read_all({"path": folder}, StringStartsWith(("name",), "b_"), EqualTo(("name",), "a_total"))
    assert not seen


def test_options_and_conditions_of_the_query(spark, folder):
    lines = prom.load(spark, folder)
    assert lines.where("name = 'a_total'").count() == 6 and lines.count() == 11
    assert prom.load(spark, folder, starts=["b"], kinds=["sample"]).count() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = spark.read.format("prom").option("fromQuery", "true").load(folder).where("name = 'a_total' AND kind = 'sample'")
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert some.count() == 4 and "= a_total" not in plan, plan  # only NULLs are left to Spark
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_empty_and_missing_folders(spark, tmp_path):
    assert prom.load(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        read_all({"path": str(tmp_path / "none")})
