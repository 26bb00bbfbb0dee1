"""A queue per source: a small source beside large ones has its share of every window."""

import collections

import pytest

from fleetgauge.llm import packing


@pytest.mark.parametrize("targets", [None, {"#7": 0.01}])
def test_small_source_beside_a_large_one(spark, targets):
    import public_tokenizers
    from pyspark.sql import functions as F

    names = spark.range(2000).select(F.concat(F.lit("s"), F.col("id")).alias("s"))
    hashed = names.withColumn("q", F.pmod(F.xxhash64("s"), F.lit(packing.QUEUES))).groupBy("q").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    large, small = hashed.where("a <> b").orderBy("q").select("a", "b").first()
    rows = [(f"{s}/{i}", "a b c d e f g", s) for s, n in ((large, 300), (small, 30), ("#7", 40), ("", 10)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), sequence=64, window_sequences=4, targets=targets).collect()
    taken = collections.defaultdict(collections.Counter)
    for r in out:
        taken[r["sequence_id"] // 4][r["doc_id"].split("/")[0]] += r["length"]
    whole = sum(taken.values(), collections.Counter())
    assert len(taken) >= 4
    for w in range(len(taken) - 3):  # then the first sources run dry
        assert sum(taken[w].values()) == 256
        for s in (small, large):
            rest = sum(whole.values()) - whole["#7"] if targets else sum(whole.values())
            share = (0.99 if targets else 1) * whole[s] / rest
            assert abs(taken[w][s] - 256 * share) <= 2
        if targets:
            assert abs(taken[w]["#7"] - 2.56) <= 2


def test_many_sources_share_queues(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(packing.QUEUES + 40)], "doc_id long, text string, source string")
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), sequence=64, window_sequences=4).collect()
    assert len({r["doc_id"] for r in out}) == packing.QUEUES + 40
