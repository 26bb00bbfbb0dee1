"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetgauge.llm import chat, chunks, decontaminate, licenses, lm_scoring, packing, quality_net, quality_rules, simhash, substrings, token_counts

CLASH = "fp long, key long, queue string, n_words long, component_id long, h long, part long, kept string, items string, block long, _row string"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeiou") for _ in range(r.randint(2, 7))) for _ in range(n)) + "."


LONG = prose(60_000, 1)
TEXTS = [None, "", " \n\t ", "a", prose(120, 2), prose(120, 2), prose(90, 3) + "\n" + prose(120, 2)[20:500], LONG, "x" * 5000, "é" * 700,
         "Licensed under the Apache License, Version 2.0.\n" + prose(60, 4), "<|endoftext|> b\x00  ▁  c\n\n d " + prose(5, 5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, "s0" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[5], rows[5]]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df.repartition(3)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def all_texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_simhash(docs):
    rows = [(d, brute.fingerprint(t)) for d, t in all_texts(docs)]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute.components(rows))), key=repr)
    assert rows_of(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_groups(docs.where("false")).count() == 0


def test_golay_keys_lose_no_link(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base) | {0}
    for b in base:
        for n in (1, 2, 3, 3, 4):
            x = b
            for bit in r.sample(range(64), n):
                x ^= 1 << bit
            fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) * 2 for x in fps]
    got = {frozenset(map(int, row)) for row in simhash.links(spark.createDataFrame(signed, "fp long, part long")).collect()}
    flat = [x for x, _ in signed]
    want = {frozenset((a, b)) for a in flat for b in flat if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want and len(want) > 150


def test_golay_code_is_perfect():
    error, _ = simhash.golay()
    weights = np.array([bin(int(e)).count("1") for e in error])
    assert np.bincount(weights).tolist() == [1, 23, 253, 1771]


def test_substrings(docs):
    texts = all_texts(docs)
    want = sorted(((d, *x[:3]) for (d, _), x in zip(texts, brute.substring_rows([t for _, t in texts]))), key=repr)
    assert rows_of(substrings.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans") == want
    assert substrings.remove_repeats(docs.where("false")).count() == 0


@pytest.mark.parametrize("crowd", [2000, 1])
def test_substrings_at_random(spark, crowd, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_RUNS", crowd)
    r = random.Random(crowd)
    pool = [prose(30, i) for i in range(6)] + ["ab" * 150, "aaa" * 90, "é" * 130]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(r.randint(1, 5)):
            x = r.choice(pool)
            a = r.randrange(len(x))
            parts.append(x[a:a + r.randint(1, 300)] if r.random() < 0.6 else prose(r.randint(1, 30), r.random()))
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(x) for x in substrings.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).orderBy("doc_id").collect()]
    assert got == [(i, *x) for i, x in enumerate(brute.substring_rows(texts))]
    assert any(0 < x[2] < x[1] for x in got)


def test_suffix_array():
    r = random.Random(5)
    for n in (1, 2, 3, 4, 5, 7, 50, 500):
        for letters in (1, 2, 30):
            s = np.array([r.randrange(letters) for _ in range(n)])
            assert substrings.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_quality_rules(docs):
    want = sorted(((d, *brute.quality(t)) for d, t in all_texts(docs)), key=repr)
    got = quality_rules.clean(docs)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert quality_rules.clean(docs.where("false")).count() == 0


def test_lines_are_judged_one_by_one(spark):
    good = prose(30, 7)
    menu = "Home | News | About\nPrivacy policy and terms of use apply to all of this page here.\nClick\n" + "$$$ ### &&& %%% wins."
    df = spark.createDataFrame([(1, "\n".join([good, menu, prose(30, 8)])), (2, "\n".join([menu] * 8))], "doc_id long, text string")
    out = {r["doc_id"]: r for r in quality_rules.clean(df).collect()}
    assert out[1]["kept"] and out[1]["cleaned"] == good + "\n" + prose(30, 8) and not out[2]["kept"]


def test_token_counts(docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((d, len((t or "").encode()), len(model.encode(t or "", num_threads=1))) for d, t in all_texts(docs)), key=repr)
    assert rows_of(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.count_tokens(docs.where("false"), path).count() == 0


SNIPPETS = [" ", "  ", "\n", "\t", "a", "Bc", ".", ",", "'s", "12", "é", "▁", " ", "　", "<|endoftext|>", "</s>", "\x00", "…", "漢字", "|", "$$"]


def test_cuts_change_no_id():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    r = random.Random(9)
    texts = ["".join(r.choice(SNIPPETS) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    rows = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for ranks in (None, public_tokenizers.path("byte_bpe_50k.tiktoken")):
        e = chunks.byte_encoder(public_tokenizers.path("byte_bpe_50k.json"), ranks)
        codes, firsts, _ = e.chunks(data, rows)
        ids, begins = e.ids()
        for i, t in enumerate(texts):
            own = [int(x) for c in codes[firsts[i]:firsts[i + 1]] for x in ids[begins[c]:begins[c + 1]]]
            assert own == model.encode(t, add_special_tokens=False).ids, repr(t)
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    whole, fit = token_counts.piece_model(public_tokenizers.path("piece_bpe_32k.model"))
    assert fit
    e = token_counts.piece_encoder(whole, fit)
    got = token_counts.counts(e, whole, data, rows)
    assert got.tolist() == [len(piece.encode(t, num_threads=1)) for t in texts]


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_packing(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer())
    rows = packing.pack(docs, tokenizer(), sequence=64, window_sequences=4).collect()
    texts = all_texts(docs)
    tokens = {}
    for d, t in texts:
        tokens.setdefault(d, []).append([*model.encode(t or "", add_special_tokens=False).ids, 0])
    assert sum(len(r["ids"]) for r in rows) == 4 * sum(len(x) for xs in tokens.values() for x in xs)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for s, parts in by_seq.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == 64 or s == max(by_seq)
    once = [d for d, xs in tokens.items() if len(xs) == 1]
    for d in once:
        own = b"".join(r["ids"] for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"]))
        assert own == np.array(tokens[d][0], "<u4").tobytes()
    assert packing.pack(docs.where("false"), tokenizer()).count() == 0


def test_mixture_follows_its_targets():
    totals = [("a", 7000), ("b", 1000), ("c", 2000)]
    m = packing.mixture(totals, 100, {"b": 0.5})
    early = [b - a for a, b in zip(m.served(3), m.served(4))]
    assert abs(early[1] - 50) <= 1 and sum(m.served(4)) in range(397, 401)
    assert m.served(100) == (7000, 1000, 2000)
    for q in range(3):
        for place in (0, 1, 500, totals[q][1] - 1):
            w = m.window_of(q, place, m.served)
            assert m.served(w)[q] <= place < m.served(w + 1)[q]


def test_quality_net(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    net = quality_net.fit(docs, labels, F.col("doc_id") % 5 == 0, per_label=5)
    got = {(r["doc_id"], r["score"]) for r in quality_net.score(docs, net).collect()}
    assert all(0 <= s <= 1 for _, s in got)
    nothing = quality_net.fit(docs.where("false"), labels.where("false"), F.lit(False))
    assert quality_net.score(docs, nothing).count() == docs.count() and quality_net.score(docs.where("false"), net).count() == 0


def test_scores_do_not_depend_on_neighbours():
    net = quality_net.fresh()
    raw = [(t or "").encode() for t in TEXTS]
    rows = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    together = quality_net.probabilities(net, np.frombuffer(b"".join(raw), np.uint8), rows)
    alone = [quality_net.probabilities(net, np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in raw]
    assert np.allclose(together, alone, atol=1e-5)


def test_lm_scoring(docs):
    target = docs.select("doc_id").where("doc_id IN (6, 7)")
    out = lm_scoring.score(docs, target).collect()
    assert sorted((r["n_tokens"] for r in out)) == sorted(len((t or "").encode()) for _, t in all_texts(docs))
    assert all(r["score"] == 0 for r in out if r["n_tokens"] == 0)
    assert lm_scoring.score(docs.where("false"), target).count() == 0
    assert lm_scoring.score(docs, target.where("false")).count() == docs.count()


def test_lm_losses_by_hand(spark):
    texts = ["abab", "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["loss_background"], r["loss_target"]) for r in lm_scoring.score(df, spark.createDataFrame([(0,)], "doc_id long")).collect()}

    def loss(text, corpus):
        grams = {}
        for t in corpus:
            s = "\0" * 4 + t
            for i in range(4, len(s)):
                for k in range(1, 6):
                    grams[s[i + 1 - k:i + 1]] = grams.get(s[i + 1 - k:i + 1], 0) + 1
        total, s = 0.0, "\0" * 4 + text
        for i in range(4, len(s)):
            p = 1 / 256
            for k in range(1, 6):
                ctx = s[i + 1 - k:i]
                after = {g: n for g, n in grams.items() if len(g) == k and g[:-1] == ctx}
                if after:
                    p = (after.get(s[i + 1 - k:i + 1], 0) + len(after) * p) / (sum(after.values()) + len(after))
            total -= np.log(p)
        return total / len(text)

    for i, t in enumerate(texts):
        assert np.allclose(got[i], (loss(t, texts), loss(t, texts[:1])))


def test_licenses(docs, spark):
    got = rows_of(licenses.find_licenses(docs), "doc_id", "n_candidates", "found")
    assert [(d, n, [x["license"] for x in f]) for d, n, f in got if n] == [(10, 1, ["Apache-2.0"])]
    assert licenses.find_licenses(docs.where("false")).count() == 0
    assert all(not f for _, _, f in rows_of(licenses.find_licenses(docs, {}), "doc_id", "n_candidates", "found"))
    near = "Released under the MIT Licence\nThis work is licensed under the GNU General Public License, version 2.\nlicense to kill"
    out = licenses.find_licenses(spark.createDataFrame([(1, near)], "doc_id long, text string")).first()
    assert [x["license"] for x in out["found"]] == ["MIT", "GPL-2.0"] and out["n_candidates"] == 3


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_decontaminate(docs, spark, most):
    item = " ".join(prose(120, 2).split()[5:40])
    items = [(1, item), (10, "A"), (2, item.upper()), (3, None), (4, ""), (None, "zz qq xx")]
    df = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_items(docs, df, most_bytes=most)
    texts = all_texts(docs)
    want = sorted(((d, *x[:3]) for (d, _), x in zip(texts, brute.contamination([t for _, t in texts], [(n if n is not None else "", t) for n, t in items]))), key=repr)
    assert rows_of(out.withColumn("n", F.size("items").cast("long")), "doc_id", "n_words", "n_hit", "n") == want
    hit = out.where("doc_id = 5").first()
    assert all(TEXTS[5][s["start"]:s["end"]].lower().split()[0] in item for s in hit["spans"]) and hit["spans"]
    assert decontaminate.find_items(docs.where("false"), df).count() == 0
    assert decontaminate.find_items(docs, df.where("false")).where("n_hit > 0").count() == 0


EVENT = "conv_id long, seq long, kind string, turn long, role string, text string, extra string"


def conversations(spark, rows):
    out = chat.render(chat.fold(spark.createDataFrame([(*r, "x") for r in rows], EVENT)))
    out = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("m"), chat.learned(F.col("formatted"), F.col("loss")).alias("l"))
    return {r["conv_id"]: ([tuple(x) for x in r["m"]], r["l"], r["formatted"]) for r in out.collect()}


def test_chat_folds_events(spark):
    rows = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "a"), (1, 2, "delta", 1, "assistant", "b"), (1, 3, "message", 2, "user", "more"),
        (1, 4, "edit", 0, "user", "hello"), (1, 5, "regenerate", 1, "assistant", None), (1, 6, "delta", 1, "assistant", "c"), (1, 7, "delta", 1, "assistant", "d"),
        (2, 0, None, None, None, None), (None, None, "message", 0, "assistant", "%25 %3C| <|im_end|>\n% <|"), (3, 0, "regenerate", 0, "assistant", None),
        (4, 0, "message", 0, "user", "same"), (4, 0, "message", 0, "user", "same"), (5, 0, "delta", 0, "assis\ntant|<|", "x"),
    ]
    got = conversations(spark, rows)
    assert got[1][:2] == ([("user", "hello"), ("assistant", "cd")], "cd")
    assert got[2][:2] == ([("", "")], "") and 3 not in got
    assert got[None][:2] == ([("assistant", "%25 %3C| <|im_end|>\n% <|")], "%25 %3C| <|im_end|>\n% <|")
    assert got[4][0] == [("user", "same")] * 2 and got[5][0] == [("assis\ntant|<|", "x")]
    assert got[None][2].count(chat.START) == got[None][2].count(chat.END) == 1
    assert conversations(spark, rows[:1])[1][0] == [("user", "hi")]
    assert chat.render(chat.fold(spark.createDataFrame([], EVENT))).count() == 0


def test_pipeline_stages(docs, spark):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns and out.schema["doc_id"] == docs.schema["doc_id"]
        rows = out.collect()
        assert rows, name
        assert stage(spark, docs.where("false"), sf).count() == 0
        ids = {r["doc_id"] for r in rows}
        if name == "quality rules":
            assert ids >= {5, 7} and not ids & {0, 1, 2, 3, 8}
        if name == "simhash near-dedup":
            groups = brute.components([(i, brute.fingerprint(t)) for i, (_, t) in enumerate(all_texts(docs))])
            assert len(rows) == len(set(groups))
        if name == "suffix-array dedup":
            assert not ids & {5} and 6 in ids  # all copies of a repeat go


def test_crc_of_held_out():
    assert zlib.crc32(b"15") % 5 in range(5)
