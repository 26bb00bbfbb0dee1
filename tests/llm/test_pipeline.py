"""The pipeline's stages one after another over the whole small table, each against a plain version on its own input."""

import os
import re

import brute
import pytest
from test_queries import SF

import corpus_pipeline
from fleetgauge.llm.common import table
from fleetgauge.llm.components import stored

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

PHRASES = ["cookie policy", "privacy policy", "terms of use", "all rights reserved", "lorem ipsum", "enable javascript", "subscribe to",
           "sign up for", "click here", "share this"]


def cleaned(text):
    """The text without failed lines, or None if the document is rejected."""
    n = len(brute.words(text))
    out, seen, left = [], set(), 0
    for line in text.split("\n"):
        w = brute.words(line)
        if not w:
            out.append(line)
            continue
        joined = " ".join(w)
        bad = (len(re.findall(r"[#*$%&|<>]", joined)) * 100 > 10 * len("".join(w).encode()) or joined.count("|") > 1
               or len(w) < 8 and not re.search(r"[.!?\"'):;…”。]$", joined) or any(p in joined.lower() for p in PHRASES))
        if line not in seen and not bad:
            out.append(line)
            left += len(w)
        seen.add(line)
    return None if brute.quality(text)[-1] or 100 * left < 60 * n else "\n".join(out)


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before and after each stage."""
    docs, seen = table(spark, SF, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stored(stage(spark, docs, SF), f"test-{i}")
        seen.append((before, docs.collect()))
    return seen


def test_quality(steps):
    before, after = steps[0]
    want = {r["doc_id"]: cleaned(r["text"]) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == {d: t for d, t in want.items() if t is not None}
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicates(steps):
    before, after = steps[1]
    rows = [(r["doc_id"], brute.fingerprint(r["text"])) for r in before]
    group = dict(zip((d for d, _ in rows), brute.components(rows)))
    kept = [group[r["doc_id"]] for r in after]
    assert sorted(kept) == sorted(set(group.values())) and set(map(tuple, after)) <= set(map(tuple, before))


def test_repeated_passages(steps):
    before, after = steps[2]
    left = {}
    raw = [(r["doc_id"], r["text"].encode()) for r in before]
    seen = {}
    for _, b in raw:
        for i in range(len(b) - 199):
            seen[b[i:i + 200]] = seen.get(b[i:i + 200], 0) + 1
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\x01" * 200
        text = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if text.strip(" ") or not any(gone):
            left[d] = text
    assert {r["doc_id"]: r["text"] for r in after} == left


def test_benchmark(steps, spark):
    before, after = steps[3]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    bad = [x[-1] for x in brute.contamination([r["text"] for r in before], items)]
    assert set(map(tuple, after)) == {tuple(r) for r, x in zip(before, bad) if not x}


def test_packing(steps):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = steps[4]
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*model.encode(r["text"], add_special_tokens=False).ids, 0] for r in before}
    brute.check_packing([(r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in after], ids)


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == len(steps[4][1])
