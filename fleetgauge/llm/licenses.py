"""License statements in documents, by conditional compression.

Lines that speak of licences are the candidates. A statement is a stretch of words, over line ends and comment
marks, with a word on such a line: enough of a template's words must stand in it, in order, its numbers must be
the template's, names in capitals (MIT) must be there, its first and last word must count, and it may be little longer than the template. Every start is
tried against every template. Of stretches that overlap the one that says more of its template, less missing and
extra words, goes first; of equal ones that of which zstandard saves more with the template as raw dictionary.

One pass over whole texts, no shuffle; templates are a bounded parameter that travels with the job. Null and
empty texts have no candidates; matches alike in all this go by name, then place; repeated rows give equal rows;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from fleetgauge.llm.common import slices, text_or_empty
from fleetgauge.llm.license_texts import CUSTOMARY

#: Customary wordings of license statements.
PLAIN = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: A wording that is there under its plain name is not repeated.
TEMPLATES = {**{n: t for n, t in CUSTOMARY.items() if t not in PLAIN.values()}, **PLAIN}
CUE = re.compile(rb"licen[sc]e|copyright|permission|redistribut|creative[\s#*/;%-]+commons|spdx|public[\s#*/;%-]+domain", re.I)
WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+(?:[.-][A-Za-z0-9]+)*")
DIGIT = re.compile(rb"[0-9]")
MAX_TEMPLATES = 1000
CELLS = 1 << 20  # of one table of word matches


@dataclass(frozen=True)
class Template:
    name: str
    text: bytes
    words: list[bytes]
    numbers: list[bytes]
    names: frozenset[bytes]  # written in capitals, as MIT
    need: int  # words that must stand in a statement
    reach: int  # words that it may span
    press: zstandard.ZstdCompressor


def prepared(templates: dict[str, str], keep: float) -> list[Template]:
    if len(templates) > MAX_TEMPLATES:
        raise ValueError("too many templates for one pass")
    out = []
    for name in sorted(templates):
        text = templates[name].encode()
        words = WORD.findall(text.lower())
        if words:
            d = zstandard.ZstdCompressionDict(b" " * 8 + text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            numbers = [w for w in words if DIGIT.search(w)]
            names = frozenset() if text.isupper() else frozenset(w.lower() for w in WORD.findall(text) if len(w) > 1 and w.isupper())
            need = next((k for k in range(1, len(words)) if k / len(words) >= keep), len(words))
            out.append(Template(name, text, words, numbers, names, need, 2 + 11 * len(words) // 10, zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False)))
    return out


def regions(text: bytes, words: list[tuple[int, int]], reach: int) -> tuple[int, list[tuple[int, int]], np.ndarray]:
    """How many lines hold a cue, the ranges of words up to ``reach`` before and after such lines (joined), and how
    many words of such lines come before each word."""
    ends = np.array([m.start() for m in re.finditer(rb"\n", text)] + [len(text)], np.int64)
    lines = np.unique(np.searchsorted(ends, [m.start() for m in CUE.finditer(text)]))
    at = np.array([a for a, _ in words], np.int64)
    past = np.searchsorted(at, ends[lines])
    first = np.searchsorted(at, np.where(lines > 0, ends[lines - 1], 0))
    inside = np.zeros(len(words) + 1, np.int64)
    out: list[tuple[int, int]] = []
    for a, b in zip(first.tolist(), past.tolist()):
        inside[a + 1:b + 1] = 1
        a, b = max(0, a - reach), min(len(words), b + reach)
        if out and a <= out[-1][1]:
            a = out.pop()[0]
        out.append((a, b))
    return len(lines), out, np.cumsum(inside)


def in_order(template: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Of each row of ``block``, how many words of the template its first 0, 1, 2 ... words hold in order."""
    best = np.zeros((block.shape[0], block.shape[1] + 1), np.int32)
    for word in template:
        more = np.maximum(best[:, 1:], best[:, :-1] + (block == word))
        best[:, 1:] = np.maximum.accumulate(more, axis=1)
    return best


def matches(t: Template, block: list[bytes], places: list[int]) -> Iterator[tuple[int, int, int]]:
    """Start, end and number of words in order of each stretch that may state the template; ``places`` has the words of it."""
    at = np.array(places, np.int64)
    starts = at[np.searchsorted(at, at + t.reach) - np.arange(len(at)) >= t.need]
    if not len(starts):
        return
    ids = {w: i for i, w in enumerate(t.words)}
    own = np.array([ids[w] for w in t.words], np.int32)
    line = np.full(len(block) + t.reach, -1, np.int32)
    line[at] = [ids[block[i]] for i in places]
    step = max(1, CELLS // t.reach)
    for k in range(0, len(starts), step):
        some = starts[k:k + step]
        held = in_order(own, line[some[:, None] + np.arange(t.reach)])
        for row, size in zip(*np.nonzero((held[:, 1:] > held[:, :-1]) & (held[:, 1:] >= t.need))):
            yield int(some[row]), int(some[row] + size + 1), int(held[row, size + 1])


def first_counts(t: Template, stretch: list[bytes], held: int) -> bool:
    ids = {w: i for i, w in enumerate(t.words)}
    rest = np.array([[ids.get(w, -1) for w in stretch[1:]]], np.int32)
    return held > in_order(np.array([ids[w] for w in t.words], np.int32), rest)[0, -1]


def differences(template: list[bytes], stretch: list[bytes]) -> list[str]:
    found = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, template, stretch, autojunk=False).get_opcodes():
        if tag != "equal":
            found.append(f"-{b' '.join(template[a:b]).decode()} +{b' '.join(stretch[c:d]).decode('utf-8', 'replace')}")
    return found


def index(templates: list[Template]) -> dict[bytes, list[int]]:
    """The templates that hold a word."""
    out: dict[bytes, list[int]] = defaultdict(list)
    for i, t in enumerate(templates):
        for w in set(t.words):
            out[w].append(i)
    return dict(out)


def scan(text: bytes, templates: list[Template], holders: dict[bytes, list[int]], plain: zstandard.ZstdCompressor) -> tuple[int, list[dict]]:
    """How many lines with a cue, and the statements in their order."""
    if not CUE.search(text):
        return 0, []
    low = text.lower()
    at = [m.span() for m in WORD.finditer(low)]
    words = [low[a:b] for a, b in at]
    reach = max((t.reach for t in templates), default=0)
    count, areas, inside = regions(text, at, reach)
    ranked: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    for first, past in areas:
        places: dict[int, list[int]] = defaultdict(list)
        for i in range(first, past):
            for k in holders.get(words[i], ()):
                places[k].append(i - first)
        for k, own in places.items():
            if len(own) >= templates[k].need:
                for a, b, held in matches(templates[k], words[first:past], own):
                    if inside[first + b] > inside[first + a]:
                        differ = len(templates[k].words) + b - a - 2 * held
                        ranked[differ - held, differ].append((k, first + a, first + b))
    taken: list[tuple[int, int]] = []
    out = []
    for rank in sorted(ranked):
        alike = []
        for k, a, b in ranked[rank]:
            t = templates[k]
            if free(taken, a, b) and t.names.issubset(words[a:b]) and [w for w in words[a:b] if DIGIT.search(w)] == t.numbers:
                held = (len(t.words) + b - a - rank[1]) // 2
                if first_counts(t, words[a:b], held):
                    own = b" ".join(text[at[a][0]:at[b - 1][1]].split())
                    alike.append((len(t.press.compress(own)) / len(plain.compress(own)), t.name, a, b, t, held))
        for ratio, name, a, b, t, held in sorted(alike, key=lambda x: x[:4]):
            if free(taken, a, b):
                taken.insert(bisect_left(taken, (a, b)), (a, b))
                out.append((a, {"license": name, "line": text.count(b"\n", 0, at[a][0]), "saved": 1 - ratio,
                                "share": held / len(t.words), "changes": differences(t.words, words[a:b])}))
    return count, [found for _, found in sorted(out, key=lambda x: x[0])]


def free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a..b meets none of the sorted ranges."""
    i = bisect_left(taken, (a, b))
    return (i == len(taken) or taken[i][0] >= b) and (i == 0 or taken[i - 1][1] <= a)


FOUND = pa.list_(pa.struct([("license", pa.string()), ("line", pa.int64()), ("saved", pa.float64()), ("share", pa.float64()),
                            ("changes", pa.list_(pa.string()))]))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, keep: float = 0.8) -> DataFrame:
    """doc_id, n_candidates and ``found`` (license, line, saved, share, changes) for every row."""
    given = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, plain = prepared(given, keep), zstandard.ZstdCompressor(level=3, write_content_size=False)
        holders = index(known)
        for batch in slices(batches):
            rows = [scan(x.encode(), known, holders, plain) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([x for _, x in rows], FOUND)],
                names=["doc_id", "n_candidates", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"""doc_id {kind}, n_candidates long,
        found array<struct<license: string, line: long, saved: double, share: double, changes: array<string>>>"""
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
