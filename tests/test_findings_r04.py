from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest

from tenderscope.operators import boosting, matching as mt
from tests.test_boosting import rows_of


def random_tree(r, sizes, classes, depth):
    shape = classes, (1 << depth) - 1
    feature = r.integers(0, len(sizes), shape).astype(np.int16)
    cut = np.where(r.random(shape) < 0.2, 255, r.integers(0, np.array(sizes)[feature])).astype(np.int16)
    return boosting.Tree(feature, cut, (feature == len(sizes) - 1) & (cut < 255))


@pytest.mark.parametrize("depth", [1, 3, 6, 8])
def test_f1_codes_lead_to_the_nodes_of_a_walk(depth):
    r = np.random.default_rng(depth)
    sizes = [33, 40, 5, 13, 70]
    bins = np.stack([r.integers(0, n, 3000) for n in sizes], axis=1).astype(np.uint8)
    codes, tree = boosting.Codes(sizes), random_tree(r, sizes, 2, depth)
    rows = [c.astype(np.intp) for c in codes.of(bins)]
    assert len(rows) < len(sizes)
    for k in range(2):
        got = boosting.Walk(codes, tree, k, depth).nodes(rows)
        assert (got == tree.reach(k, bins, depth) - (1 << depth) + 1).all()


@pytest.mark.parametrize("alike", [False, True])
def test_f1_only_wanted_nodes_are_added_up(alike):
    r = np.random.default_rng(7)
    sizes, n, level = [33, 40, 5, 13, 70], 5000, 3
    bins = np.stack([r.integers(0, s, n) for s in sizes], axis=1).astype(np.uint8)
    codes, tree = boosting.Codes(sizes), random_tree(r, sizes, 3, level)
    label, weight = r.integers(0, 3, n).astype(np.uint8), (r.random(n) * 9).astype(np.float32)
    count = r.integers(1, 50, n).astype(np.int32) if alike else None
    margin = r.normal(size=(3, n)).astype(np.float32)
    wanted = np.array([[0, -1, -1, 1, -1, -1, 3, -1]] * 3)
    (got,) = boosting._sums(iter([(codes.of(bins), label, weight, count, margin)]), codes, tree, level, wanted, 70)
    times = np.ones(n) if count is None else count
    p = boosting.probabilities(margin.astype(float))
    want = np.zeros((3, 3, 4, len(sizes), 70))
    for k in range(3):
        node = tree.reach(k, bins, level) - (1 << level) + 1
        for place, of in ((0, 0), (1, 3), (3, 6)):
            here = node == of
            for i, x in enumerate(((p[k] - (label == k)) * weight * times, p[k] * (1 - p[k]) * weight * times, times)):
                for f in range(len(sizes)):
                    want[i, k, place, f] = np.bincount(bins[here, f], x[here], minlength=70)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3) and (got[2] == want[2]).all()


def test_f1_alike_rows_are_one_row_and_no_checkpoint_stays(spark, monkeypatch):
    _, df = rows_of(spark)
    several = df.unionByName(df).unionByName(df)
    few = boosting.fit(df, "label", ["x"], ["z"], rounds=boosting.CHECKPOINT + 2, depth=2)
    folder = spark.sparkContext.getCheckpointDir()
    held = [f for f in os.listdir(folder.removeprefix("file:")) if f.startswith("rdd-")]
    monkeypatch.setattr(boosting, "LEAST", 3 * boosting.LEAST)
    many = boosting.fit(several, "label", ["x"], ["z"], rounds=2, depth=2)
    assert held == []
    for a, b in zip(few.trees, many.trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, atol=1e-6)


def unit_rows(spark, n, dim=24, seed=3):
    r = np.random.default_rng(seed)
    vectors = r.standard_normal((n, dim))
    vectors[n // 2 : n // 2 + n // 8] = vectors[0]  # a large group of one vector
    vectors[5] = 0
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    frame = pd.DataFrame({"id": np.arange(n), "vector": list(vectors)})
    df = spark.createDataFrame(frame).selectExpr("id", "cast(null as array<string>) as terms", "cast(null as array<double>) as weights", "vector", "0.0D as bonus")
    return vectors, df.withColumnRenamed("id", "q").drop("bonus"), df


def brute(vectors, k):
    score = np.round(vectors @ vectors.T, 6)
    np.fill_diagonal(score, -9)
    ids = np.arange(len(vectors))
    return {(q, rank + 1): i for q in ids for rank, i in enumerate(np.lexsort((ids, -score[q]))[:k].tolist())}


@pytest.mark.parametrize("name", ["grid_top_k", "pruned_top_k"])
def test_f2_f3_no_vector_is_copied(spark, name):
    vectors, q, pool = unit_rows(spark, 1200)
    options = {"w_vector": 1.0, "w_terms": 0.0, "clip": False, "skip_same": True, "block_rows": 40, "shard_rows": 60}
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorList(False).apply(0).totalShuffleWrite()
    top = getattr(mt, name)(q, pool, 5, **options)
    top = top if name == "grid_top_k" else top[0]
    assert "explode(" not in top._jdf.queryExecution().analyzed().toString()
    got = {(r["q"], r["rank"]): r["id"] for r in top.collect()}
    moved = store.executorList(False).apply(0).totalShuffleWrite() - before
    assert got == brute(vectors, 5)
    assert moved < 16 * vectors.nbytes  # before, each of 30 blocks had its own copy of the pool


def test_f2_f3_single_precision_keeps_ties_and_own_ids():
    r = np.random.default_rng(1)
    v = np.round(r.standard_normal((700, 3)), 1)  # many equal scores
    ids = r.permutation(700) // 2  # every id twice
    of, best, emb = mt._nearest(ids[:90], v[:90], ids, v, 4, True, 1.0)
    for j in range(90):
        score = np.round(v @ v[j], 6)
        score[ids == ids[j]] = -99
        assert best[of == j].size == 4
        assert [(-score[i], ids[i]) for i in best[of == j]] == [(-score[i], ids[i]) for i in np.lexsort((ids, -score))[:4]]
    assert np.allclose(emb, (v[of] * v[best]).sum(1))
    assert len(mt._nearest(ids[:3], v[:3], ids[:3], v[:3], 9, False, 1.0)[0]) == 9
