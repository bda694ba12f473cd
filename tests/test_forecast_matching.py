"""Forecasts and rankings against brute force on small fixtures."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tenderscope.operators import forecast as fc, matching as mt
from tenderscope.streaming import streams


def series(spark, ys):
    return spark.createDataFrame([("k", [float(v) for v in ys])], "key string, y array<double>")


def run(spark, model, ys, h=6):
    return series(spark, ys).select(model(F.col("y"), h)).collect()[0][0]


Y = [50 + 10 * math.sin(i / 2) + i % 7 for i in range(40)]


def test_seasonal_models(spark):
    n, y = len(Y), np.array(Y)
    f = [y[m::12].mean() for m in range(12)]
    assert np.allclose(run(spark, fc.naive, Y, 14), [y[n - 12 + k % 12] for k in range(14)])
    assert np.allclose(run(spark, fc.level, Y), [y[-12:].mean() * f[(n + k) % 12] / np.mean(f) for k in range(6)])
    assert np.allclose(run(spark, fc.anchored, Y), [y[-1] * f[(n + k) % 12] / f[(n - 1) % 12] for k in range(6)])
    assert np.allclose(run(spark, fc.seasonal_median, Y), [np.median(y[(n + k) % 12 :: 12]) for k in range(6)])


def test_short_and_zero_series(spark):
    assert run(spark, fc.level, [3.0, 4.0], 2) == [4.0, 4.0]
    assert run(spark, fc.seasonal_ar, Y[:29]) is None
    zero = Y[:-1] + [0.0]
    assert np.allclose(run(spark, fc.anchored, zero), run(spark, fc.level, zero))


def test_backtest_never_reads_past_its_origin(spark):
    cut = fc.cut_at_origins(series(spark, Y), 6).collect()
    assert sorted(r["origin"] for r in cut) == [28, 34]
    for r in cut:
        assert r["y"] == Y[: r["origin"]] and r["test"] == Y[r["origin"] : r["origin"] + 6]
    short = fc.cut_at_origins(series(spark, Y[:25]), 6).collect()
    assert [r["origin"] for r in short] == [19]


def test_custom_forecaster(spark):
    got = fc.with_custom_forecaster(series(spark, Y), ["key"], lambda y, h: np.full(h, y.max()), 3, "max").collect()
    assert [(r["model"], r["step"]) for r in got] == [("max", 1), ("max", 2), ("max", 3)]
    assert all(abs(r["pred"] - max(Y)) < 1e-9 for r in got)


def test_holt_winters_follows_a_clean_season(spark):
    y = [100 + 20 * (i % 12 == 0) + i for i in range(60)]
    got = series(spark, y).select(fc.holt_winters(F.col("y"), 6).alias("f")).collect()[0]["f"]
    assert max(abs(p - (100 + 20 * ((60 + k) % 12 == 0) + 60 + k)) for k, p in enumerate(got["pred"])) < 15
    assert all(lo <= p <= hi for lo, p, hi in zip(got["lo"], got["pred"], got["hi"]))


def test_grid_equals_brute_force_for_any_cell_size(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(12)]

    def row(i, same):
        ts = [] if same else sorted(rng.sample(words, 4))
        return (i, ts or ["w1"], [0.5] * (len(ts) or 1), [rng.random() for _ in range(3)])

    # a third of the pool are copies of one person
    pool = [row(i, i % 3 == 0) + (0.1 * (i % 4),) for i in range(90)]
    for i in range(0, 90, 3):
        pool[i] = (i, ["w1"], [0.5], [0.1, 0.2, 0.3], 0.2)
    asked = [row(i, False) for i in range(7)] + [(7, None, None, None)]
    p = spark.createDataFrame(pool, "id long, terms array<string>, weights array<double>, vector array<double>, bonus double")
    q = spark.createDataFrame(asked, "q long, terms array<string>, weights array<double>, vector array<double>")

    def score(a, b):
        t = sum(x * y for s, x in zip(a[1] or [], a[2] or []) for u, y in zip(b[1], b[2]) if s == u)
        raw = 0.85 * sum(x * y for x, y in zip(a[3], b[3])) + 0.15 * t if a[3] else t
        return round(min(1, max(0, min(1, max(0, raw)) + b[4])), 6)

    want = {a[0]: [b[0] for b in sorted(pool, key=lambda b: (-score(a, b), b[0]))[:5]] for a in asked}
    for block, shard in ((256, 8192), (2, 11)):
        got: dict = {}
        for r in mt.grid_top_k(q, p, 5, block_rows=block, shard_rows=shard).orderBy("q", "rank").collect():
            got.setdefault(r["q"], []).append(r["id"])
        assert got == want


def test_rescore_falls_back_to_terms_and_bonus_uses_first_category(spark):
    rows = [(1, 1, 0.0, 0.4, False, None, 0), (1, 2, 0.0, 0.3, True, "Investigador Senior emérito", 6)]
    df = spark.createDataFrame(rows, "q int, id int, score_emb double, score_tfidf double, has_cv boolean, category string, n_areas int")
    got = mt.rescore(df).orderBy("rank").collect()
    assert got[0]["id"] == 2 and abs(got[0]["boost"] - 0.38) < 1e-9 and abs(got[1]["score_raw"] - 0.4) < 1e-9


def test_stream_counts_equal_batch(spark, data):
    from tenderscope.plans.catalog import QUERIES

    got = QUERIES["stream_counts"](spark, data)
    batch = spark.read.parquet(f"{data}/events.parquet").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    joined = got.join(batch.withColumnRenamed("n", "m"), (F.to_date("start") == F.col("day")) & (got.event_type == batch.event_type))
    assert got.count() == joined.where("n = m").count() > 0


def test_mark_incomplete(spark):
    df = spark.sql("select timestamp_ntz'2024-01-02 00:00:00' as end union all select timestamp_ntz'2024-01-03 00:00:00'")
    got = [r["complete"] for r in streams.mark_incomplete(df, "2024-01-02 12:00:00").orderBy("end").collect()]
    assert got == [True, False]


def _plain_path(z, h, twice, lag, slope):
    import numpy as np

    s = [b - a for a, b in zip(z, z[12:])]
    d = [b - a for a, b in zip(s, s[1:])] if twice else list(s)
    x, w = (d[:-lag], d[lag:]) if slope else ([], d)
    if not w:
        return None
    b = 0.0
    if slope:
        sxx = sum((v - np.mean(x)) ** 2 for v in x)
        b = sum((v - np.mean(x)) * (u - np.mean(w)) for v, u in zip(x, w)) / sxx if sxx else 0.0
    a = np.mean(w) - b * (np.mean(x) if slope else 0.0)
    z, last = list(z), s[-1]
    for _ in range(h):
        d.append(a + b * d[-lag])
        last = last + d[-1] if twice else d[-1]
        z.append(z[-12] + last)
    return z[-h:]


def test_the_candidate_with_the_least_error_on_the_held_months_is_used(spark):
    import numpy as np

    from tenderscope.operators import forecast as fc

    r = np.random.default_rng(3)
    rows, want, winners = [], {}, set()
    for i in range(40):
        n = int(r.integers(26, 70))
        kind = i % 4
        gaps = np.cumsum(r.normal(0, 0.1, n)) if kind == 1 else r.normal(0.1, 0.2, n)
        z = list(3 + r.normal(0, 0.3, 12))
        for t in range(12, n):
            z.append(z[t - 12] + (gaps[t] if kind != 3 else -0.9 * (z[t - 12] - z[t - 24] if t >= 24 else gaps[t])))
        y = [float(max(np.expm1(v), 0)) for v in z]
        z = [float(np.log1p(v)) for v in y]
        rows.append((i, y))
        if n >= 30:
            errors = []
            for c in fc.AR_CANDIDATES:
                p = _plain_path(z[:-6], 6, *c)
                errors.append(np.inf if p is None else np.mean([(u - v) ** 2 for u, v in zip(p, z[-6:])]))
            best = int(np.argmin(errors))
            winners.add(best)
            want[i] = [max(np.expm1(v), 0) for v in _plain_path(z, 8, *fc.AR_CANDIDATES[best])]
    got = {x["i"]: x["p"] for x in spark.createDataFrame(rows, "i int, y array<double>").select("i", fc.seasonal_ar(F.col("y"), 8).alias("p")).collect()}
    assert len(winners) >= 3
    for i, _ in rows:
        assert got[i] is None if i not in want else np.allclose(got[i], want[i], rtol=1e-6)


def test_pruned_search_finds_the_same_and_leaves_cells_shut(spark):
    r = np.random.default_rng(5)
    heads = r.standard_normal((12, 16))

    def rows(n, seed, names):
        g = np.random.default_rng(seed)
        out = []
        for i in range(n):
            v = heads[i % 12] + 0.15 * g.standard_normal(16)
            v = None if i % 41 == 7 else (v / np.linalg.norm(v)).tolist()
            t = sorted(g.choice(["a", "b", "c", "d", "e"], 2, replace=False).tolist()) if i % 5 else None
            row = (i, t, None if t is None else [0.6, 0.8], v)
            out.append(row + (float(g.choice([0.0, 0.05, 0.1])),) if "bonus" in names else row)
        return spark.createDataFrame(out, names)

    pool = rows(600, 1, "id bigint, terms array<string>, weights array<double>, vector array<double>, bonus double")
    queries = rows(60, 2, "q bigint, terms array<string>, weights array<double>, vector array<double>")
    for options in ({}, {"clip": False, "skip_same": True, "w_terms": 0.0}, {"need_overlap": True}):
        want = mt.grid_top_k(queries, pool, 6, **options).collect()
        got, cells = mt.pruned_top_k(queries, pool, 6, pivots=24, block_rows=5, shard_rows=30, **options)
        key = lambda x: (x["q"], x["rank"], x["id"], round(x["score_final"], 6))
        assert sorted(map(key, got.collect())) == sorted(map(key, want))
        if not options.get("need_overlap"):
            assert cells["first"] <= cells["opened"] < 0.6 * cells["cells"], cells
        print(options, cells)


def test_evidence_falls_back_to_shared_runs_where_no_term_survives(spark):
    rows = [(1, 1, "größen1 übermut größen2 übermut", "übermut größen3"), (1, 2, "red green", "green"), (2, 1, "x1", None)]
    got = mt.term_evidence(spark.createDataFrame(rows, "q long, id long, call_text string, person_text string")).collect()
    found = {(x["q"], x["id"], x["term"]): (x["weight"], x["rank"]) for x in got}
    assert found[1, 1, "bermut"] == (2.0, 1) and {k[:2] for k in found} == {(1, 1), (1, 2)} and (1, 2, "green") in found
