"""Metrics text files as the batch format ``prom``, with conditions on ``name`` and ``kind`` tested before parsing.

    lines = prom.load(spark, "/data/metrics", names=["mail_pending"], kinds=["sample"])
    rows = prom.read_samples(spark, "/data/metrics", ["mail_pending"])     # with type and help of the family

A row is a sample, a HELP or a TYPE line: file, at (the byte it begins at), kind, name, labels, value (samples), text
(HELP and TYPE). Conditions are tested on the first bytes of a line, before labels and numbers are parsed; other lines
cost no more than that. They come as options or, with the option ``fromQuery`` and the setting
``spark.sql.python.filterPushdown.enabled``, from the query: =, IN and LIKE 'x%' on name, = and IN on kind. Spark 4.1
keeps what it handed over with the loaded table, so with ``fromQuery`` load anew for every query and side of a join.

Files are planned by size: small ones share a task, large ones are cut at line ends, so one hot file is read by many
tasks. Any file system that pyarrow opens by URI serves. Lines end in a line feed (a carriage return before it is
dropped). What is neither sample, HELP nor TYPE gives no row, nor does a sample that names a label twice or has no
number (decimal, exponent, Inf or NaN). Bytes that are no UTF-8 become replacement characters; empty files and folders
give nothing. Hidden files (``_`` or ``.`` first) are left out.

Options: ``path``, ``names`` and ``kinds`` (JSON lists), ``starts`` (a JSON list of prefixes, all of which must
hold), ``fromQuery`` (default false), ``splitBytes`` (default 32 MB).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from fleetgauge.functions.text import series_key

ROWS = 8192  # rows of an Arrow batch
ARROW = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("kind", pa.string()), ("name", pa.string()),
    ("labels", pa.map_(pa.string(), pa.string())), ("value", pa.float64()), ("text", pa.string())])
SCHEMA = "file string, at bigint, kind string, name string, labels map<string, string>, value double, text string"

HEAD = re.compile(rb"(?:# (HELP|TYPE) )?([a-zA-Z_:][a-zA-Z0-9_:]*)")
TAIL = re.compile(rb"[ \t]+(\S+)(?:[ \t]+-?[0-9]+)?\s*\Z")
LABEL = re.compile(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"')
NUMBER = re.compile(rb"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?)\Z|nan\Z", re.I)
ESCAPE = re.compile(r"\\(.)", re.S)


def plain(text: str) -> str:
    return ESCAPE.sub(lambda m: {"\\": "\\", '"': '"', "n": "\n"}.get(m[1], m[0]), text)


def parsed(line: bytes, kind: str, name: str, start: int) -> tuple | None:
    """labels, value and text of a line whose kind and name are known and end at ``start``; None if it is not one."""
    if kind != "sample":
        rest = line[start:]
        return (None, None, rest[1:].decode("utf-8", "replace") if rest else None) if rest[:1] in (b"", b" ") else None
    labels: list[tuple[str, str]] = []
    if line[start:start + 1] == b"{":
        end = line.rfind(b"}")
        if end < start:
            return None
        labels = [(k, plain(v)) for k, v in LABEL.findall(line[start + 1:end].decode("utf-8", "replace"))]
        if len({k for k, _ in labels}) < len(labels):
            return None
        start = end + 1
    number = TAIL.match(line, start)
    return (labels, float(number[1]), None) if number and NUMBER.match(number[1]) else None


class Wanted:
    """Conditions on name and kind that lines must meet, all of them."""

    def __init__(self) -> None:
        self.names: set[str] | None = None
        self.kinds: set[str] | None = None
        self.starts: list[str] = []

    def take(self, condition: Filter) -> bool:
        """Whether the condition is one that parsing tests."""
        match condition:
            case EqualTo(attribute=("name" | "kind" as column,), value=str(value)):
                values = {value}
            case In(attribute=("name" | "kind" as column,), value=among):
                values = {x for x in among if x is not None}
            case StringStartsWith(attribute=("name",), value=start):
                self.starts.append(start)
                return True
            case _:
                return False
        before = self.names if column == "name" else self.kinds
        values = values if before is None else values & before
        if column == "name":
            self.names = values
        else:
            self.kinds = values
        return True

    def __call__(self, kind: str, name: str) -> bool:
        return (self.names is None or name in self.names) and (self.kinds is None or kind in self.kinds) and all(
            map(name.startswith, self.starts))


class Part(InputPartition):
    """Pieces of files: lines that begin in [start, end)."""

    def __init__(self, pieces: list[tuple[str, int, int]]) -> None:
        self.pieces = pieces


class PromSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PromReader:
        options = self.options.copy()  # looked up without regard to case, which a dict would not
        return QueryReader(options) if options.get("fromQuery", "false").lower() == "true" else PromReader(options)


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it (Spark writes ``file:/x`` for ``file:///x``)."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


class PromReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.most = max(1, int(options.get("splitBytes", 32 << 20)))
        self.wanted = Wanted()
        self.wanted.starts += json.loads(options.get("starts", "[]"))
        for column in ("name", "kind"):
            if f"{column}s" in options:
                self.wanted.take(In((column,), tuple(json.loads(options[f"{column}s"]))))

    def partitions(self) -> list[Part]:
        store, path = opened(self.path)
        info = store.get_file_info(path)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        url = urlparse(self.path)
        before = f"{url.scheme}://{url.netloc}" if url.scheme and url.scheme != "file" else "file://"
        parts, room = [], 0
        for f in sorted((f for f in found if f.is_file and f.size), key=lambda f: f.path):
            if any(p[:1] in ("_", ".") for p in f.path[len(path.rstrip("/")):].split("/")):
                continue
            name = f.path if f.path.startswith("/") else f"/{f.path}" if before == "file://" else f.path
            for start in range(0, f.size, self.most):
                end = min(f.size, start + self.most)
                if end - start > room:
                    parts.append(Part([]))
                    room = self.most
                parts[-1].pieces.append((f"{before}{name}", start, end))
                room -= end - start
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for file, start, end in partition.pieces:
            for row in self._rows(file, start, end):
                rows.append(row)
                if len(rows) == ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    def _rows(self, file: str, start: int, end: int) -> Iterator[tuple]:
        store, path = opened(file)
        with store.open_input_file(path) as f:
            for at, line in lines_of(f, start, end):
                head = HEAD.match(line)
                if head is None:
                    continue
                kind, name = (head[1] or b"sample").decode(), head[2].decode()
                if not self.wanted(kind, name):
                    continue
                found = parsed(line, kind, name, head.end())
                if found is not None:
                    yield file, at, kind, name, *found


class QueryReader(PromReader):
    """A reader that also takes the conditions of the query; those it cannot test go back to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for condition in filters:
            if not self.wanted.take(condition):
                yield condition


def lines_of(f: pa.NativeFile, start: int, end: int, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in [start, end), with the byte they begin at; the first may reach past ``end``."""
    at = max(0, start - 1)
    f.seek(at)
    rest = b""
    skip = start > 0  # up to the line feed at start - 1 or after it
    while True:
        more = f.read(block)
        lines = (rest + more).split(b"\n")
        rest = lines.pop() if more else b""
        for line in lines:
            if skip:
                skip = False
            elif at < end:
                yield at, line[:-1] if line.endswith(b"\r") else line
            at += len(line) + 1
            if at >= end:
                return
        if not more:
            return


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)


def load(
    spark: SparkSession, path: str, names: list[str] | None = None, kinds: list[str] | None = None,
    starts: list[str] | None = None, split_bytes: int = 32 << 20,
) -> DataFrame:
    """Lines of the metric files under ``path`` that are of these names, kinds and prefixes (None: all)."""
    spark.dataSource.register(PromSource)
    reader = spark.read.format("prom").option("splitBytes", split_bytes)
    for option, value in (("names", names), ("kinds", kinds), ("starts", starts)):
        if value is not None:
            reader = reader.option(option, json.dumps(sorted(set(value))))
    return reader.load(path)


def read_samples(spark: SparkSession, path: str, names: list[str] | None = None, file_part: str = "(.*)") -> DataFrame:
    """Samples of the families ``names`` (all, if None) with type and help, as ``exposition.read_exposition`` gives them.

    A family of a file brings its own HELP and TYPE lines along; of several the greatest text counts. The HELP and TYPE
    lines are aggregated before they meet the samples, so no window runs over a family."""
    part = F.regexp_extract("file", file_part, 1)
    samples = load(spark, path, names, ["sample"]).withColumn("file", part)
    about = load(spark, path, names, ["HELP", "TYPE"]).withColumn("file", part).groupBy("file", "name").agg(
        F.max(F.when(F.col("kind") == "TYPE", F.col("text"))).alias("type"),
        F.max(F.when(F.col("kind") == "HELP", F.col("text"))).alias("help"))
    return samples.join(about, ["file", "name"], "left").select(
        "file", "name", F.coalesce("type", F.lit("untyped")).alias("type"), F.coalesce("help", F.lit("")).alias("help"),
        series_key(F.col("name"), F.col("labels")).alias("series_key"), F.col("labels")["op"].alias("op"), "value")
