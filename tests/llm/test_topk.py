"""Exact top-k against all scores."""

import math

import numpy as np

from pointlake.llm import topk


def plain(vectors, queries, k):
    out, scored = [], {}
    for q, v in queries:
        scored.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
    for q, found in scored.items():
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_equals_all_scores_with_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(0)
    values = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(300)] + [(400 + i, rng.integers(-9, 9, 2).tolist()) for i in range(4)]
    values += [(500, [0] * 6), (501, [2**40, 0, 0, 0, 0, 1]), (502, [2**20, 5, 0, 0, 0, 0]), (503, [])]
    rows = values + values[:50] + values[200:203] * 9 + [(7, [3] * 6), (None, [9] * 6)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, v array<long>, score int").repartition(4)
    rows = [r for r in rows if r[0] is not None]
    asked = [(i, v) for i, v in rows if i % 10 == 0]
    got = topk.exact_top_k(df, df.where("vec_id % 10 = 0"), k=5)
    assert sorted(map(tuple, got.collect())) == plain(rows, asked, 5)


def test_integer_vectors_leave_out_what_is_not_finite(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [None, 1.0]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (None, [1.0, 1.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.v for r in topk.integer_vectors(df).collect()}
    assert got == {1: [128, -1], 6: []}
    none = topk.integer_vectors(df).where("false")
    assert topk.exact_top_k(none, none).collect() == []


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(2)
    matrix = rng.integers(-5, 6, (5000, 4))
    matrix[:20] *= 50
    lists = topk.Lists(np.arange(5000), matrix)
    seen = []
    order = lists.order

    class Watch:
        def __getitem__(self, key):
            seen.append(key[1].stop - key[1].start)
            return order[key]

    lists.order = Watch()
    for q in matrix[:5]:
        ids, scores = lists.top(None, q, 5)
        all_scores = matrix @ q
        want = np.lexsort((np.arange(5000), -all_scores))[:5]
        assert ids.tolist() == want.tolist() and scores.tolist() == all_scores[want].tolist()
    assert sum(seen) < 5 * 2 * 5000 / 4
