"""Exact order statistics against brute force, including one value holding a third of the rows."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tenderscope.operators import learning, ranks, stats


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [("a" if i % 3 else "b", 500.0 if i % 3 == 0 else round(rng.lognormvariate(6, 2), 2)) for i in range(n)]


def test_percentiles_match_numpy(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p1": 0.01, "med": 0.5, "p995": 0.995, "top": 1.0}
    got = {r["k"]: r for r in ranks.exact_percentiles(df, "v", probs, ["k"]).collect()}
    for k in ("a", "b"):
        values = [v for kk, v in rows if kk == k]
        for name, p in probs.items():
            assert np.isclose(got[k][name], np.percentile(values, p * 100))


def test_percentiles_keep_null_key_and_negative_values(spark):
    df = spark.createDataFrame([(None, -5.0), (None, 0.0), (None, 7.5), ("x", 1.0)], "k string, v double")
    got = {r["k"]: r["m"] for r in ranks.exact_percentiles(df, "v", {"m": 0.5}, ["k"]).collect()}
    assert got == {None: 0.0, "x": 1.0}


def test_running_totals_match_sorted_cumsum(spark):
    rows = [(i, float((i * 37) % 101) - 20) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, v double")
    got = {r["id"]: r["c"] for r in ranks.running_totals(df, "v", ["id"], {"c": "v"}).collect()}
    total = 0.0
    for i, v in sorted(rows, key=lambda t: (-t[1], t[0])):
        total += v
        assert abs(got[i] - total) < 1e-9


def test_mode_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None), ("k", None), ("k", None)], "k string, v string")
    assert ranks.mode_per(df, ["k"], "v", "m").collect()[0]["m"] == "a"


def test_auc_and_average_precision_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), 0.5 if i % 3 == 0 else round(rng.random(), 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(learning.auc(df, "y", "s").collect()[0]["auc_roc"] - wins) < 1e-6
    ap, tp, seen = 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        here = [y for y, v in rows if v == s]
        tp, seen = tp + sum(here), seen + len(here)
        ap += sum(here) / len(pos) * tp / seen
    assert abs(learning.average_precision(df, "y", "s").collect()[0]["auc_pr"] - ap) < 1e-6


def test_chi2_tail_known_values(spark):
    df = spark.createDataFrame([(3.841458820694124, 1), (19.67513757268249, 11), (18.307038053275146, 10)], "x double, d int")
    got = [r[0] for r in df.select(stats.chi2_tail("x", "d")).collect()]
    assert all(abs(p - 0.05) < 1e-9 for p in got)


def test_spearman_matches_ranks_of_small_table(spark):
    rows = [(1.0, 3.0), (2.0, 1.0), (2.0, 2.0), (5.0, 9.0), (7.0, 9.0)]
    rx, ry = [1, 2.5, 2.5, 4, 5], [3, 1, 2, 4.5, 4.5]
    got = stats.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").collect()[0]["rho"]
    assert abs(got - np.corrcoef(rx, ry)[0, 1]) < 1e-6


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 0)], "k string, v int")
    got = ranks.shares_within(df, ["k"], "v", "s").groupBy("k").agg(F.sum("s").alias("t")).collect()
    assert {r["k"]: r["t"] for r in got} == {"a": 1.0, "b": None}


def test_running_totals_where_a_third_of_the_rows_have_one_value(spark, monkeypatch):
    import random

    from tenderscope.operators import ranks

    r = random.Random(8)
    rows = [(f"s{i:04d}", "k" if i % 2 else None, 500 if i % 3 == 0 else r.randint(1, 900)) for i in range(1500)]
    df = spark.createDataFrame(rows, "name string, k string, v long").repartition(4)
    ranges = ranks.order_ranges(df, "v", ["name"], ["k"], most=40)
    sizes = [x["count"] for x in ranges.groupBy("k", "_b", "_s").count().collect()]
    assert sum(sizes) == 1500 and max(sizes) <= 80  # 250 rows of each key have one value
    monkeypatch.setattr(ranks, "RANGE_ROWS", 40)
    got = {(x["k"], x["name"]): x["run"] for x in ranks.running_totals(df, "v", ["name"], {"run": "v"}, ["k"]).collect()}
    for k in (None, "k"):
        total = 0
        for name, _, v in sorted((x for x in rows if x[1] == k), key=lambda x: (-x[2], x[0])):
            total += v
            assert got[k, name] == total
