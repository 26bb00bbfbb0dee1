"""Growing logs: every finished line once, through appends, rotation, cuts and restarts."""

import os
import shutil

import pytest

from fleetgauge.streaming import tail
from fleetgauge.streaming.tables import append_available


class Follower:
    """One folder of logs and the table of what was read; each ``read`` is a new query from the checkpoint."""

    def __init__(self, spark, folder, **options):
        self.spark, self.logs, self.out, self.options = spark, f"{folder}/logs", f"{folder}/out", options
        os.makedirs(self.logs)

    def write(self, name, text, mode="ab"):
        with open(f"{self.logs}/{name}", mode) as out:
            out.write(text if isinstance(text, bytes) else text.encode())

    def move(self, a, b):
        os.rename(f"{self.logs}/{a}", f"{self.logs}/{b}")

    def read(self):
        append_available(tail.follow(self.spark, self.logs, **self.options), f"{self.out}/table", f"{self.out}/checkpoint")
        if not os.path.isdir(f"{self.out}/table"):
            return []
        return sorted(r["line"] for r in self.spark.read.parquet(f"{self.out}/table").collect())


@pytest.fixture
def log(spark, tmp_path):
    return Follower(spark, str(tmp_path))


def test_appended_lines_come_once(log):
    log.write("a.log", "one\n")
    assert log.read() == ["one"]
    log.write("a.log", "two\nthr")
    assert log.read() == ["one", "two"]  # the last line is not finished
    assert log.read() == ["one", "two"]
    log.write("a.log", "ee\r\n\n")
    log.write("b.log", "one\n")  # begins as the other did, and is a file of its own
    assert log.read() == ["", "one", "one", "three", "two"]


def test_rotation_by_renaming(log):
    log.write("a.log", "1\n2\n")
    log.read()
    log.write("a.log", "3\n")
    log.move("a.log", "a.log.1")
    log.write("a.log.1", "4\n")  # the writer still holds the renamed file
    log.write("a.log", "5\n")
    assert log.read() == ["1", "2", "3", "4", "5"]
    log.write("a.log", "6\n")
    log.move("a.log.1", "a.log.2")
    log.move("a.log", "a.log.1")
    log.write("a.log", "7\n8\n9\n10\n")
    assert log.read() == sorted(map(str, range(1, 11)))
    os.unlink(f"{log.logs}/a.log.2")
    log.move("a.log.1", "a.log.2")
    log.move("a.log", "a.log.1")
    log.write("a.log", "11\n")  # may get the number of the file that went
    assert log.read() == sorted(map(str, range(1, 12)))


def test_cut_and_replaced_files(log):
    log.write("a.log", "1\n2\n")
    log.write("b.log", "x\ny\n")
    log.read()
    log.write("a.log", "3\n")
    shutil.copyfile(f"{log.logs}/a.log", f"{log.logs}/a.log.1")
    log.write("a.log", "4\n", "wb")  # copied and cut
    log.write("b.log", "other\nlines\nlonger than before\n", "wb")  # other bytes, and more of them
    assert log.read() == sorted(["1", "2", "3", "4", "x", "y", "other", "lines", "longer than before"])


def test_restart_between_plan_and_commit(log, spark, tmp_path):
    """A batch whose files are renamed before it is read again finds them; one whose bytes are gone says so."""
    log.write("a.log", "1\n2\n")
    reader = tail.TailReader({"path": log.logs})
    end = reader.latestOffset()
    log.move("a.log", "old.log")
    log.write("a.log", "3\n")
    again = tail.TailReader({"path": log.logs})
    splits = again.partitions({}, end)
    assert [(os.path.basename(s.file), s.start, s.end) for s in splits] == [("old.log", 0, 4)]
    log.write("old.log", "", "wb")
    with pytest.raises(RuntimeError, match="gone before they were read"):
        again.partitions({}, end)
    with pytest.raises(RuntimeError, match="changed while"):
        list(again.read(splits[0]))
    assert tail.TailReader({"path": log.logs, "failOnDataLoss": "false"}).partitions({}, end) == []


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_splits_give_each_line_once(spark, tmp_path, size):
    log = Follower(spark, str(tmp_path), splitBytes=size)
    lines = [f"{i} " + "x" * (i * 37 % 50) for i in range(40 if size == 1 else 200)]
    log.write("a.log", "\n".join(lines[:20]) + "\n")
    reader = tail.TailReader({"path": log.logs, "splitBytes": str(size)})
    first = reader.latestOffset()
    log.write("a.log", "\n".join(lines[20:]) + "\nopen")
    second = reader.latestOffset()
    for low, high, want in (({}, first, lines[:20]), (first, second, lines[20:]), ({}, second, lines), (second, second, [])):
        got = [x for s in reader.partitions(low, high) for b in reader.read(s) for x in b.column("line").to_pylist()]
        assert got == want


def test_bytes_at_and_odd_input(log, spark):
    log.write("a.log", b"\xff\xfe bad\nfine \xe2\x82\xac\r\n")
    log.write("empty.log", "")
    log.write(".hidden", "no\n")
    log.write("_SUCCESS", "no\n")
    os.makedirs(f"{log.logs}/deep/er")
    log.write("deep/er/c.log", "deep\n")
    assert log.read() == ["deep", "fine €", "�� bad"]
    rows = spark.read.parquet(f"{log.out}/table").collect()
    assert sorted((os.path.basename(r["file"]), r["at"]) for r in rows) == [("a.log", 0), ("a.log", 7), ("c.log", 0)]
    one = tail.TailReader({"path": f"{log.logs}/a.log"})
    assert len(one.latestOffset()) == 1 and tail.TailReader({"path": f"{log.logs}/none"}).latestOffset() == {}
    assert list(tail.TailReader({"path": log.logs, "glob": "c.*", "recursive": "false"}).latestOffset()) == []


def test_line_end_is_looked_for_in_steps(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "LOOK", 4)
    path = tmp_path / "a"
    path.write_bytes(b"ab\n" + b"c" * 50)
    with open(path, "rb") as data:
        assert tail.finished(data, 53) == 3 and tail.finished(data, 2) == 0 and tail.finished(data, 53, 3) == 3
