"""Every registered document query over its whole small table against a brute-force version."""

import os
import zlib

import brute
import pytest
from test_queries import SF

from fleetgauge.llm import queries as q
from fleetgauge.llm.common import table

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def found(spark, job, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in q.JOBS[job](spark, SF).collect()}


def test_op1(spark, docs):
    got = found(spark, "op1_simhash", "fingerprint", "component_id")
    prints = [(d, brute.fingerprint(t)) for d, t in docs]
    assert got == {d: (f"{f:016x}", c) for (d, f), c in zip(prints, brute.components(prints))}


def test_op2(spark, docs):
    got = found(spark, "op2_quality_net", "held_out", "score", "predicted")
    label = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert set(got) == {d for d, _ in docs}
    for d, (held, score, predicted) in got.items():
        assert held == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == (score >= 0.3)
    judged = [(p, label[d]) for d, (held, _, p) in got.items() if held and d in label]
    assert sum(p == y for p, y in judged) >= 0.8 * len(judged)


def test_op3(spark, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = found(spark, "op3_token_counts", "n_bytes", "n_tokens", "over_limit")
    for d, t in docs:
        n = len(model.encode(t, num_threads=1))
        assert got[d] == (len(t.encode()), n, n > 4096)


def test_op4(spark, docs):
    got = found(spark, "op4_substrings", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == {d: x for (d, _), x in zip(docs, brute.substring_rows([t for _, t in docs]))}


def test_op5(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*model.encode(t, add_special_tokens=False).ids, 0] for d, t in docs}
    rows = q.op5_packing(spark, SF).collect()
    brute.check_packing([tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
                         for r in rows], ids)


def test_op6(spark, docs):
    got = found(spark, "op6_lm_scoring", "n_tokens", "loss_target", "loss_background", "score")
    label = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    assert {d: x[0] for d, x in got.items()} == {d: len(t.encode()) for d, t in docs}
    assert all(abs(x[3] - (x[2] - x[1])) < 1e-9 for x in got.values())
    mean = {y: [got[d][3] for d in got if label.get(d) == y] for y in (0, 1)}
    assert sum(mean[1]) / len(mean[1]) > sum(mean[0]) / len(mean[0])


def test_op7(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", q.FORGED), (-1, 1, "assistant", q.FORGED)]
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = brute.turns([r[1:] for r in rows if r[0] == c])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in q.op7_chat(spark, SF).collect()}
    assert got == want


def test_op8(spark, docs):
    got = {r["doc_id"]: r for r in q.op8_quality_rules(spark, SF).collect()}
    label = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    for d, t in docs:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(t)
        assert not (r["kept"] and r["base_failed"])
        if d in label and not r["base_failed"]:
            assert r["kept"] == bool(label[d]), t[:200]


def test_op9(spark, docs):
    got = {r["doc_id"]: [x["license"] for x in r["found"]] for r in q.op9_licenses(spark, SF).collect()}
    lines = {"MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
             "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
             "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    for d, t in docs:
        assert got[d] == [n for line in t.split("\n") for n, x in lines.items() if line == x]


def test_op10(spark, docs):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    got = found(spark, "op10_decontaminate", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == {d: x for (d, _), x in zip(docs, brute.contamination([t for _, t in docs], items))}
