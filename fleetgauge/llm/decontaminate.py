"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Texts are lower-cased in A-Z and split into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Every run of ``window``
words of an item (the whole item if it is shorter) is a pattern; a document's words go once through
the automaton of all patterns, and the words inside any match are mapped back to the original text.

The items travel to the tasks only up to a checked size; a larger set is dealt into slices of about that size by
item and text, written to the shared folder, where the tasks read the slice of their automaton. A document's
matches of all slices are put together.

Null and empty texts have no words and no hits; items without words are no pattern; items that say the same
all count; repeated documents give equal rows; further columns are ignored; an empty table of documents gives
an empty table and an empty table of items leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import slices, text_or_empty
from fleetgauge.workdir import fresh_dir

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM_BYTES = 32 << 20  # items that one automaton may hold


def _to_words() -> bytes:
    table = bytearray(range(256))
    for b in range(128):
        low = bytes([b]).lower()
        table[b] = low[0] if low.isalnum() else 0x20
    return bytes(table)


TABLE = _to_words()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


@dataclass(frozen=True)
class Patterns:
    """Item numbers and their texts, here or in files; built into an automaton once a task."""

    items: tuple[tuple[str, bytes], ...]
    window: int
    files: tuple[str, ...] = ()

    def rows(self) -> Iterator[tuple[str, bytes]]:
        yield from self.items
        for uri in self.files:
            store, path = pyarrow.fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as f:
                for batch in pyarrow.parquet.ParquetFile(f).iter_batches(1024, columns=["item", "text"]):
                    for name, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                        yield name, text.encode()

    def automaton(self):
        """All patterns as words between blanks, a byte to a character; None without any."""
        owners: dict[bytes, set[str]] = {}
        for name, text in self.rows():
            words = words_of(text)
            size = min(self.window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                owners.setdefault(b" ".join(words[i:i + size]), set()).add(name)
        if not owners:
            return None
        found = ahocorasick.Automaton()
        for run, names in owners.items():
            found.add_word(f" {run.decode('latin-1')} ", (len(run) + 2, run.count(b" ") + 1, tuple(names)))
        found.make_automaton()
        return found


def matches(text: bytes, found) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, ranges of words hit (joined, in order) and the items hit."""
    words = words_of(text)
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    if found is None or not words:
        return len(words), ranges, items
    line = b" %b " % b" ".join(words)
    blanks = None
    for end, (length, size, names) in found.iter(line.decode("latin-1")):
        if blanks is None:  # the blank before each word
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        start = int(np.searchsorted(blanks, end + 1 - length))
        past = start + size
        items.update(names)
        while ranges and ranges[-1][1] >= start:
            start = min(start, ranges.pop()[0])
        ranges.append((start, past))
    return len(words), ranges, items


def char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Ranges of words as ranges of code points of the original text."""
    if not ranges:
        return []
    at = [m.span() for m in WORD.finditer(text.lower())]
    is_start = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(is_start)])
    return [{"start": int(chars[at[a][0]]), "end": int(chars[at[b - 1][1]])} for a, b in ranges]


SCHEMA = """n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>,
            ranges array<struct<first: long, past: long>>"""
ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("ranges", pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])))])


def _scan(docs: DataFrame, patterns: Patterns) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((patterns.items, patterns.window, patterns.files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Patterns(*shared.value).automaton()
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                n, ranges, items = matches(raw, found)
                out.append({"n_words": n, "n_hit": sum(b - a for a, b in ranges), "items": sorted(items),
                            "spans": char_spans(raw, ranges), "ranges": [{"first": a, "past": b} for a, b in ranges]})
            cols = pa.array(out, ARROW).flatten()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *cols],
                                             names=["doc_id", "key", *(f.name for f in ARROW)])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {key}, key long, {SCHEMA}")


def _slices(items: DataFrame, window: int, most: int) -> Iterator[Patterns]:
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // most))
    if parts == 1:
        yield Patterns(tuple((r["item"], r["text"].encode()) for r in items.toLocalIterator()), window)
        return
    path = fresh_dir(items.sparkSession, "decontaminate-items")
    dealt = items.distinct().withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    dealt.repartition("slice").write.partitionBy("slice").parquet(path)
    files: dict[str, list[str]] = {}
    for uri in items.sparkSession.read.parquet(path).inputFiles():
        files.setdefault(re.findall(r"/slice=(\d+)/", uri)[-1], []).append(uri)
    for i in sorted(files, key=int):
        yield Patterns((), window, tuple(sorted(files[i])))


def find_items(docs: DataFrame, items: DataFrame, window: int = 13, most_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit (words in any match), items (their item_ids as strings, sorted) and spans (code
    points of the original text, start inclusive, end exclusive) for every row of ``docs`` (doc_id, text)."""
    source = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty().alias("text"))
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    scans = [_scan(rows, p) for p in _slices(source, window, most_bytes)]
    if len(scans) == 1:
        return scans[0].drop("ranges", "key")
    return _together(scans, rows)


def _together(scans: list[DataFrame], rows: DataFrame) -> DataFrame:
    """One row per document of the matches of several automata; equal documents have equal matches."""
    every = scans[0]
    for more in scans[1:]:
        every = every.unionByName(more)
    hit = every.where("n_hit > 0").select("doc_id", "key", F.explode("ranges").alias("r"), "items").dropDuplicates()
    found = hit.groupBy("doc_id", "key").agg(F.collect_set("r").alias("r"), F.flatten(F.collect_set("items")).alias("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, ranges, items in zip(*(batch.column(c).to_pylist() for c in ("text", "r", "i"))):
                raw, joined = text.encode(), []
                for a, b in sorted((x["first"], x["past"]) for x in ranges or ()):
                    if joined and joined[-1][1] >= a:
                        joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
                    else:
                        joined.append((a, b))
                out.append({"n_words": len(words_of(raw)), "n_hit": sum(b - a for a, b in joined),
                            "items": sorted(set(items or ())), "spans": char_spans(raw, joined), "ranges": []})
            cols = pa.array(out, ARROW).flatten()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *(f.name for f in ARROW)])

    key = rows.schema["doc_id"].dataType.simpleString()
    a, b = rows.alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    return joined.select("a.doc_id", "a.text", "b.r", "b.i").mapInArrow(run, f"doc_id {key}, {SCHEMA}").drop("ranges")
