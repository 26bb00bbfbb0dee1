"""Line-first cleaning of documents.

Each line is judged on its own by punctuation, navigation and boilerplate rules; lines that fail go,
and a document that loses too much of its text is rejected. One pass over the rows, no shuffle.

Null and empty texts have no words and fail the base rule. Rows are judged one by one: repeated rows
give equal results, ties do not arise, further columns are ignored and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.llm.common import slices, text_or_empty

SYMBOLS = b"#*$%&|<>"
ENDINGS = (b".", b"!", b"?", b'"', b"'", b")", b":", b";", "…".encode(), "”".encode(), "。".encode())
BOILERPLATE = (
    b"cookie policy", b"privacy policy", b"terms of use", b"all rights reserved", b"lorem ipsum",
    b"enable javascript", b"subscribe to", b"sign up for", b"click here", b"share this",
)


@dataclass(frozen=True)
class Rules:
    """Limits in whole percent; a line is measured against its own words and characters."""

    min_words: int = 50  # base: fewer words fail
    max_repeat_pct: int = 50  # base: more words in repeated windows fail
    max_symbol_pct: int = 10  # line: symbols among the bytes of its words
    max_bars: int = 1  # line: vertical bars before it counts as navigation
    loose_words: int = 8  # line: fewer words and no sentence end is navigation
    min_kept_pct: int = 60  # document: words left after cleaning


SCHEMA = """n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
            base_failed boolean, n_words_left long, kept boolean, cleaned string"""


def symbols_in(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, every such window included."""
    windows = list(zip(words, words[1:], words[2:]))
    seen: set = set()
    again = set()
    for x in windows:
        if x in seen:
            again.add(x)
        else:
            seen.add(x)
    if not again:
        return 0
    count, covered = 0, 0
    for i, x in enumerate(windows):
        if x in again:
            count += i + 3 - max(covered, i)
            covered = i + 3
    return count


def line_fails(words: list[bytes], rules: Rules) -> bool:
    """Whether a line with words is navigation, markup or boilerplate."""
    line = b" ".join(words)
    size = len(line) - len(words) + 1
    if symbols_in(line) * 100 > rules.max_symbol_pct * size or line.count(b"|") > rules.max_bars:
        return True
    if len(words) < rules.loose_words and not line.endswith(ENDINGS):
        return True
    low = line.lower()
    return any(x in low for x in BOILERPLATE)


def judge(text: bytes, rules: Rules) -> tuple:
    """One row of SCHEMA without the last column, and the cleaned bytes."""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    repeats = repeated_words(words)
    left, dup, out, seen = 0, 0, [], set()
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            out.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if not again and not line_fails(own, rules):
            left += len(own)
            out.append(line)
    base = n < rules.min_words or 100 * repeats > rules.max_repeat_pct * n
    kept = not base and 100 * left >= rules.min_kept_pct * n
    return n, chars, symbols_in(text), dup, repeats, base, left, kept, b"\n".join(out)


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id with the columns of SCHEMA for every row: counts, verdict and the text without failed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [judge(x.encode(), rules) for x in batch.column("text").to_pylist()]
            columns = list(zip(*rows))
            longs = [pa.array(columns[i], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *longs, pa.array(columns[5], pa.bool_()), pa.array(columns[6], pa.int64()),
                 pa.array(columns[7], pa.bool_()), pa.array([x.decode("utf-8", "replace") for x in columns[8]], pa.string())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "n_words_left", "kept", "cleaned"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {key}, {SCHEMA}")
