"""Cross-tokenizer alignment against a token-by-token brute force with the tokenizers' own libraries."""

import hashlib
import os
from collections import Counter

import pytest
from test_queries import SF

from fleetgauge.llm import alignment
from fleetgauge.llm import queries as q
from fleetgauge.llm.common import table

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def paths():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.path("piece_bpe_32k.model")


def brute(texts):
    """Per text the columns, by whole encodings and a walk over byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    json_path, _, model_path = paths()
    first = Tokenizer.from_file(json_path)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=model_path)
    spell = {}
    extra = 0
    for b in range(256):
        shown = b in range(33, 127) or b in range(161, 173) or b in range(174, 256)
        spell[chr(b if shown else 256 + extra)] = b
        extra += not shown

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        want = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        in_a, in_b = [bytes(spell[c] for c in first.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
        if not text or b"".join(in_a) != want or b"".join(in_b) != want:
            found.append(None)
            continue
        spans = []
        for ids, parts in ((a, in_a), (b, in_b)):
            at, own = 0, []
            for i, p in zip(ids, parts):
                own.append((at, at + len(p), i))
                at += len(p)
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, links, till = [], [], [0, 0]
        for end in ends:
            ids = []
            for side, own in enumerate(spans):
                begin = till[side]
                while till[side] < len(own) and own[till[side]][1] <= end:
                    till[side] += 1
                ids.append(own[begin:till[side]])
            groups.append("|".join(",".join(str(x[2]) for x in own) for own in ids))
            links += [(x[2], y[2]) for x in ids[0] for y in ids[1] if x[0] < y[1] and y[0] < x[1]]
        found.append((len(a), len(b), groups, links))
    count = Counter(p for f in found if f for p in set(f[3]))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [
        (f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == most[p[0]] for p in f[3]), sum(count[p] for p in f[3]),
         hashlib.sha256(";".join(f[2]).encode()).hexdigest()) if f else (0, 0, 0, 0, 0, 0, "") for f in found]


def columns(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.withColumnRenamed("groups", "groups_sha256").orderBy("doc_id").collect()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op12(spark):
    texts = [r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    got = q.op12_alignment(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == brute(texts)


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "  a  b", "\n\nx \n y", "tab\tand\r\nmore", "sign ▁ inside", "▁", "<|endoftext|> stays <|endoftext|>text",
    "<s> </s> <unk> <0x41>", "naïve café — “quoted” 日本語 テスト 한국어 🙂🙃", "　wide　blank　", "don't we'll I'VE it's", "1234567 3.14 1e-9",
    "x" * 3000, "a b " * 500, "ünïcödé" * 50, " nbsp   thin", "\x00nul\x01", "é combining", "ﬁ ligature Ａ", "same words", "same words",
    "trailing   ", "...!!!???", "end of line \n next\n", "﻿bom", "zero​width", "🏳️‍🌈 flags 🇩🇪", "if (x<y) { return a[i]; }  // ok"]


def test_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(ODD)], "doc_id long, text string, n_a string").repartition(3)
    assert columns(alignment.align(df, *paths()).documents) == brute(ODD)
    # without the rank file and with the groups' text
    out = alignment.align(df, paths()[0], None, paths()[2], with_text=True)
    rows = out.documents.orderBy("doc_id").collect()
    want = brute(ODD)
    assert [hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "" for r in rows] == [w[6] for w in want]
    assert {r["pair"] for r in out.pairs.where("best").collect()} and out.pairs.where("n < 1").count() == 0


def test_long_texts_in_parts_and_small_blocks(spark):
    """Parts, blocks and the memo may end anywhere."""
    words = [f"w{i % 97}x{i % 13} {'é' if i % 7 else 'naïve'},  {i}" for i in range(4000)]
    texts = [" ".join(words), "no" * 9000, "sign ▁ at the end of a long text " * 500, " ".join(words[:50]), *ODD] + ["again and again"] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    want = brute(texts)
    for limits in (alignment.Limits(2000, 3000, 1000, 100), alignment.Limits(500, 1, 3, 10)):
        assert columns(alignment.align(df, *paths(), limits=limits).documents) == want


def test_ids_of_other_types_and_an_empty_table(spark):
    df = spark.createDataFrame([("b", "some text"), (None, "some text"), ("b", None)], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["n_a"], r["n_best"], r["count_sum"]) for r in alignment.align(df, *paths()).documents.collect())
    assert got == [("", 2, 2, 4), ("b", 0, 0, 0), ("b", 2, 2, 4)]
    assert alignment.align(df.limit(0), *paths()).documents.count() == 0
