"""Growing log files as a stream: the data source ``tail``.

    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").load("/var/log/web")      # file, at, line

An offset holds, for each file of the folder, the bytes up to its last finished line and a mark of what these
bytes are (hashes of their head and of their end). A batch reads what lies between two offsets, in splits at line
ends, so a first run over large files is dealt over tasks and an appended line is read once. Files are recognised by
their bytes, not their names alone:

* a file whose marked bytes are unchanged goes on where it stood;
* one that is shorter, or holds other bytes, was cut or replaced, and is read from its start;
* one that is new under its name and begins with the marked bytes of a file that is gone from its own goes on where
  that stood, if it is the same file (renamed) or that was cut (copied away).

So appends, rotation by renaming, rotation by copy and truncation, cuts and restarts from a checkpoint each give
every finished line once. Lines end in a line feed (a carriage return before it is dropped); a last line without
one waits for it. Bytes that are no UTF-8 become replacement characters. Empty files give nothing.

Options: ``path`` (a folder or a file, of the driver's and executors' common file system), ``glob`` of file names
(default ``*``; hidden ones, ``_`` or ``.`` first, are left out), ``recursive`` (default true), ``splitBytes``
(default 32 MB), ``failOnDataLoss`` (default true: fail if planned bytes are gone before they are read, else skip
them). Limits: lines written and cut away between two triggers are never seen; a copy beside its uncut original, or
brought from another file system, is a file of its own.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

MARK = 256  # bytes of the head and of the end that tell a file
LOOK = 64 << 10  # bytes read at a time in search of a line end
BLOCK = 4 << 20  # bytes of lines given at a time


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


class Split(InputPartition):
    """Lines of ``file`` that begin in [start, end); the range [low, high) it is part of begins and ends at lines."""

    def __init__(self, file: str, start: int, end: int, low: int, high: int, mark: list) -> None:
        self.file, self.start, self.end, self.low, self.high, self.mark = file, start, end, low, high, mark


def mark_of(data, at: int) -> list:
    """What tells the first ``at`` bytes of an open file."""
    data.seek(0)
    head = data.read(min(MARK, at))
    data.seek(max(0, at - MARK))
    end = data.read(min(MARK, at))
    return [at, hashlib.sha256(head + b"|" + end).hexdigest()[:32]]


def _same(path: str, mark: list) -> bool:
    """Whether the file at ``path`` still begins with the marked bytes."""
    try:
        with open(path, "rb") as data:
            return os.fstat(data.fileno()).st_size >= mark[0] and mark_of(data, mark[0]) == mark
    except FileNotFoundError:
        return False


def finished(data, size: int, least: int = 0) -> int:
    """Bytes up to and with the last line feed before ``size``, given that ``least`` of them are known."""
    end = size
    while end > least:
        start = max(least, end - LOOK)
        data.seek(start)
        found = data.read(end - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return least


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        given = {k.lower(): v for k, v in options.items()}
        self.path = given["path"].removeprefix("file://")
        self.glob = given.get("glob", "*")
        self.recursive = given.get("recursive", "true").lower() == "true"
        self.split = int(given.get("splitbytes", 32 << 20))
        self.strict = given.get("failondataloss", "true").lower() == "true"
        self.known: dict[str, tuple] = {}  # path -> (size, mtime, id, mark): files that haven't changed aren't read

    def _files(self) -> Iterator[os.DirEntry]:
        folders = [self.path]
        while folders:
            with os.scandir(folders.pop()) as found:
                for entry in found:
                    if entry.name[0] in "._":
                        continue
                    if entry.is_dir():
                        if self.recursive:
                            folders.append(entry.path)
                    elif fnmatch.fnmatch(entry.name, self.glob):
                        yield entry

    def _snapshot(self) -> dict[str, list]:
        """path -> [id, bytes of finished lines, hash] of the files that hold a finished line."""
        files = [(self.path, os.stat(self.path))] if os.path.isfile(self.path) else []
        if not files and os.path.isdir(self.path):
            for entry in self._files():
                try:
                    files.append((entry.path, os.stat(entry.path)))
                except FileNotFoundError:
                    continue  # renamed meanwhile: the next offset has it
        out, known = {}, {}
        for path, stat in files:
            own = (stat.st_size, stat.st_mtime_ns, f"{stat.st_dev}:{stat.st_ino}")
            before = self.known.get(path)
            if before is None or before[:3] != own:
                try:
                    with open(path, "rb") as data:
                        grown = before is not None and before[2] == own[2] and before[0] <= own[0] and mark_of(data, before[3][0]) == before[3]
                        mark = mark_of(data, finished(data, stat.st_size, before[3][0] if grown else 0))
                except FileNotFoundError:
                    continue
                before = (*own, mark)
            known[path] = before
            if before[3][0]:
                out[path] = [before[2], *before[3]]
        self.known = known
        return out

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: {"id": i, "at": at, "mark": mark} for path, (i, at, mark) in sorted(self._snapshot().items())}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        # a batch that is planned again after a restart may find its files under other names
        where = {path: path for path in end}
        moved = [p for p, e in end.items() if start.get(p) != e and not _same(p, [e["at"], e["mark"]])]
        if moved:
            now = self._snapshot()
            for path in moved:
                e = end[path]
                fit = [p for p in now if _same(p, [e["at"], e["mark"]])]
                fit.sort(key=lambda p: (now[p][0] != e["id"], p in end, p))
                where[path] = fit[0] if fit else ""
        out = []
        for path, low in self._starts(start, end, where).items():
            e = end[path]
            if e["at"] <= low:
                continue
            if not where[path]:
                if self.strict:
                    raise RuntimeError(f"bytes {low} to {e['at']} of {path} are gone before they were read; set failOnDataLoss to false to go on without them")
                continue
            for at in range(low, e["at"], self.split):
                out.append(Split(where[path], at, min(at + self.split, e["at"]), low, e["at"], [e["at"], e["mark"]]))
        return out

    def _starts(self, start: dict, end: dict, where: dict[str, str]) -> dict[str, int]:
        """Where each file of ``end`` goes on from ``start``."""
        def goes_on(path: str, s: dict) -> bool:
            e = end[path]
            if e["at"] < s["at"]:
                return False
            return (e["at"], e["mark"]) == (s["at"], s["mark"]) or (bool(where[path]) and _same(where[path], [s["at"], s["mark"]]))

        out = {p: start[p]["at"] for p in end if p in start and goes_on(p, start[p])}
        gone = [p for p in start if p not in out]  # renamed, cut, replaced or deleted
        fresh = [p for p in end if p not in out]
        for old in sorted(gone, key=lambda p: -start[p]["at"]):
            s = start[old]
            # a renamed file keeps its id; of a copied one the original, now cut, keeps it
            cut = old in end and end[old]["id"] == s["id"]
            fit = [p for p in fresh if p not in out and p != old and (end[p]["id"] == s["id"] or cut) and goes_on(p, s)]
            fit.sort(key=lambda p: (end[p]["id"] != s["id"], p))
            if fit:
                out[fit[0]] = s["at"]
        return {p: out.get(p, 0) for p in end}

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        try:
            data = open(partition.file, "rb")
        except FileNotFoundError:
            data = None
        if data is None or mark_of(data, partition.mark[0]) != partition.mark:
            # a file renamed since it was planned: the batch fails and is planned again
            raise RuntimeError(f"{partition.file} changed while it was read")
        with data:
            at = partition.start
            if at > partition.low:  # begins after the line that the split before it ends with
                data.seek(at - 1)
                at += len(data.readline()) - 1
            data.seek(at)
            while at < partition.end:
                block = data.read(min(BLOCK, partition.end - at))
                if not block.endswith(b"\n"):
                    block += data.readline()  # within the range: it ends with a line
                yield _lines(partition.file, at, block)
                at += len(block)


def _lines(file: str, at: int, block: bytes) -> pa.RecordBatch:
    raw = block.split(b"\n")[:-1]
    starts, own = [], at
    for line in raw:
        starts.append(own)
        own += len(line) + 1
    try:
        text = pa.array(raw, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([line.decode("utf-8", "replace") for line in raw], pa.string())
    text = pc.replace_substring_regex(text, "\r$", "")
    return pa.RecordBatch.from_arrays([pa.array([file] * len(raw), pa.string()), pa.array(starts, pa.int64()), text], names=["file", "at", "line"])


def follow(spark, path: str, **options):
    """Lines of growing files under ``path``: file, at (the byte where a line begins), line."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").options(**options).load(path)
