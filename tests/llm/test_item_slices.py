"""Benchmark items beyond one automaton stay out of the driver."""

import random
from unittest import mock

from pyspark.sql import DataFrame

from fleetgauge.llm import decontaminate


def test_slices_are_files_of_bounded_size(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(20)) for _ in range(300)]
    items = spark.createDataFrame([(7 if i % 3 else i, t) for i, t in enumerate(texts)] + [(7, texts[1])] * 200, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"a b {t} c") for i, t in enumerate(texts)] + [(-1, "a b c")], "doc_id long, text string")
    want = sorted(map(tuple, decontaminate.find_items(docs, items).collect()))
    rows = items.selectExpr("CAST(item_id AS string) AS item", "text")
    with mock.patch.object(type(items), "toLocalIterator", side_effect=AssertionError), mock.patch.object(DataFrame, "toLocalIterator", side_effect=AssertionError):
        parts = list(decontaminate._slices(rows, 13, 4000))
        assert all(sum(len(t) for _, t in p.rows()) < 3 * 4000 and not p.items for p in parts)
        assert sorted(x for p in parts for x in p.rows()) == sorted({(r["item"], r["text"].encode()) for r in rows.collect()})
        assert sorted(map(tuple, decontaminate.find_items(docs, items, most_bytes=20_000).collect())) == want
