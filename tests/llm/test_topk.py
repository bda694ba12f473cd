from __future__ import annotations

import math
import random

from tenderscope.llm.topk import exact_top_k, grid_vectors


def brute(rows, k):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            g = [math.floor(64 * x) for x in v]
            seen[i] = min(seen.get(i, g), g)
    out = []
    for q in sorted(seen):
        if q % 20:
            continue
        scores = sorted((-max(min(sum(a * b for a, b in zip(seen[q], seen[c])), 2**63 - 1), -(2**63)), c) for c in seen if c != q)[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    return out


def answer(spark, rows, k=5, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    g = grid_vectors(df, "vec_id", "embedding")
    return sorted(tuple(r) for r in exact_top_k(g.where("id % 20 = 0"), g, k=k, **sizes).collect())


def test_against_brute_force_with_odd_rows(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(10)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 240)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 10), (303, [float("inf")] * 10), (304, []), (305, [2.0] * 12), (None, [1.0] * 10)]
    rows += [(40, [0.5] * 10), (41, rows[41][1])]  # repeated ids
    assert answer(spark, rows, block_dims=3, tile_rows=40, query_rows=4) == sorted(brute(rows, 5))


def test_components_beyond_doubles_and_few_rows(spark):
    rows = [(0, [1e9, 3.0]), (1, [2e9, 1.0]), (20, [1e14, 1e14])]
    assert answer(spark, rows) == sorted(brute(rows, 5))
    assert answer(spark, []) == []
    assert answer(spark, [(20, [1.0])]) == []
