"""Whitening and top-k search against brute force, on the test tables and on odd small ones."""

import math
import os
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import SF

from fleetgauge.llm import queries as q
from fleetgauge.llm import topk, whitening
from fleetgauge.llm.common import table

INF, NAN = float("inf"), float("nan")


def integers(vector, scale=64.0):
    if vector is None or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return [math.floor(scale * c) for c in vector]


def frame(spark, rows):
    """Rows (vec_id, embedding) with a further column whose name the operators use themselves."""
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")


def brute_top(rows, k, is_query):
    own = [(i, integers(v)) for i, v in rows]
    out = defaultdict(list)
    for a, (i, x) in enumerate(own):
        if x is None or i is None or not is_query(i):
            continue
        found = [(-sum(p * r for p, r in zip(x, y)), j is None, j) for b, (j, y) in enumerate(own) if b != a and y is not None and len(y) == len(x)]
        found.sort(key=lambda t: (t[0], t[1], t[2] or 0))
        out[i].append([(n + 1, j, -s) for n, (s, _, j) in enumerate(found[:k])])
    return {i: sorted(map(str, lists)) for i, lists in out.items()}


def grouped(rows):
    """Rows of a result by query; lists of repeated queries can't be told apart, so they are compared as one bag."""
    out = defaultdict(list)
    for r in rows:
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {i: sorted(map(str, found)) for i, found in out.items()}


def flat(lists):
    return {i: sorted(str(t) for x in own for t in eval(x)) for i, own in lists.items() if any(eval(x) for x in own)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op13(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    got = grouped(q.op13_top_k(spark, SF).collect())
    assert got == flat(brute_top(rows, 20, lambda i: i % 20 == 0))


ODD = [
    (0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5, -0.5]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [NAN, 1.0]), (5, [INF, 1.0]),
    (None, [1.0, 2.0]), (6, []), (40, []), (7, [3.0]), (60, [2.0]), (8, [0.0, 0.0]), (9, [1e-3, -1e-3]), (-20, [-4.0, 1.0]), (80, None)]


def test_top_k_of_odd_rows(spark):
    df = frame(spark, ODD)
    for k in (1, 3, 20):
        got = grouped(topk.top_k(df, F.col("vec_id") % 20 == 0, k=k).collect())
        assert got == flat(brute_top(ODD, k, lambda i: i % 20 == 0)), k
    none = topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0)
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0


def test_top_k_through_a_grid_of_cells(spark, monkeypatch):
    """Small shards, blocks and cells, many ties: the same rows as from one product."""
    for name, value in (("SHARD", 16), ("BLOCK", 8), ("CELL_BYTES", (64, 256)), ("FAN", 2)):
        monkeypatch.setattr(topk, name, value)
    make = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in make.integers(-2, 3, 4)]) for i in make.permutation(700)] + [(1000 + i, [1.0] * 4) for i in range(300)]
    got = grouped(topk.top_k(frame(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, k=7).collect())
    assert got == flat(brute_top(rows, 7, lambda i: i % 20 == 0))


def test_products_are_exact():
    make = np.random.default_rng(3)
    for bits in (3, 20, 26, 29, 40, 61):
        a, b = (make.integers(-(1 << bits), 1 << bits, (n, 5)) for n in (7, 9))
        exact = [[max(topk.NONE, min(-topk.NONE, sum(int(x) * int(y) for x, y in zip(p, r)))) for r in b] for p in a]
        assert topk.products(a, b).tolist() == exact
        for k in (1, 4, 9):
            score = topk.products(a, b)
            want = [sorted(range(9), key=lambda c: (-row[c], c))[:k] for row in exact]
            assert [sorted(r) for r in topk.best(score, k).tolist()] == [sorted(w) for w in want]


def brute_whitening(rows, components):
    """Covariance and deviations in fractions, the rest in doubles."""
    own = [(i, integers(v)) for i, v in rows]
    own = [(i, [c + 1_000_000 for c in x]) for i, x in own if x]
    sizes = defaultdict(int)
    for _, x in own:
        sizes[len(x)] += 1
    width = max(sizes, key=lambda w: (sizes[w], w))
    own = [(i, x) for i, x in own if len(x) == width]
    n, x = len(own), np.array([x for _, x in own], dtype=object)
    total = x.sum(axis=0)
    centred = x * n - total
    exact = [[Fraction(int((centred[:, i] * centred[:, j]).sum()), n**3) for j in range(width)] for i in range(width)]
    value, vector = np.linalg.eigh(np.array([[float(c) for c in row] for row in exact]))
    value, vector = value[::-1], vector[:, ::-1]
    white = (centred.astype(float) / n) @ vector / np.sqrt(np.where(value > 1e-9, value, np.nan))
    deviation = (centred * centred).sum(axis=1).tolist()
    keep = [c for c in range(min(width, components)) if value[c] > 1e-9]
    return n, {i: (d, w[keep]) for (i, _), d, w in zip(own, deviation, white)}, value[keep] / value.sum()


def check_whitening(got, rows, components=32):
    n, want, explained = brute_whitening(rows, components)
    found = defaultdict(dict)
    for r in got:
        assert r["n"] == n and r["deviation"] == want[r["vec_id"]][0] and r["identity_error"] <= 1e-9
        assert abs(r["explained"] - explained[r["component"] - 1]) <= 1e-9 * explained[r["component"] - 1]
        found[r["vec_id"]][r["component"]] = r["whitened"]
    assert set(found) == set(want) and all(sorted(f) == list(range(1, len(explained) + 1)) for f in found.values())
    mine = np.array([[found[i][c + 1] for c in range(len(explained))] for i in want])
    theirs = np.array([w for _, w in want.values()])
    signs = np.sign((mine * theirs).sum(axis=0))
    assert np.abs(mine * signs - theirs).max() < 1e-6


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op11(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    got = q.op11_whitening(spark, SF).collect()
    assert len(got) == 32 * len(rows)
    check_whitening(got, rows)


def test_whitening_of_odd_rows(spark):
    make = np.random.default_rng(5)
    rows = [(i, [float(x) for x in make.normal(size=3) * (1, 5, 100)]) for i in range(50)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [NAN, 0.0, 0.0]), (103, [0.0, INF, 0.0]), (104, []), (105, [1.0]), (106, [1.0, 2.0])]
    check_whitening(whitening.whiten(frame(spark, rows)).collect(), rows)
    check_whitening(whitening.whiten(frame(spark, rows), components=2).collect(), rows, 2)
    flat_dim = [(i, [v[0], 7.0, v[1]]) for i, v in rows[:50]]  # no variance in the middle: two components
    got = whitening.whiten(frame(spark, flat_dim)).collect()
    assert {r["component"] for r in got} == {1, 2}
    check_whitening(got, flat_dim)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4, [(1, None), (2, [NAN])]):
        out = whitening.whiten(frame(spark, rows))
        assert out.columns[0] == "vec_id" and out.count() == 0


def test_sums_of_squares_are_exact():
    make = np.random.default_rng(1)
    for bits in (5, 25, 33, 50):
        y = make.integers(-(1 << bits), 1 << bits, (40, 4))
        t = [[int(v) for v in row] for row in y]
        for i, values in enumerate(whitening.squares(y)):
            assert values[0] == sum(r[i] ** 2 for r in t)
            assert list(values[1:]) == [sum((r[i] + r[j]) ** 2 for r in t) for j in range(i + 1, 4)]


def test_repeated_rows_count_each(spark):
    make = np.random.default_rng(9)
    rows = [(1, [float(x) for x in make.normal(size=2)]) for _ in range(9)] * 2
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 2 * 18 and {r["n"] for r in got} == {18}
