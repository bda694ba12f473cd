from __future__ import annotations

import math

import numpy as np
import pytest

from tenderscope.llm import whitening
from tenderscope.llm.whitening import fit, integer_blocks, leading_pairs, minres, whiten


def plain(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(max(-(2.0**53), min(2.0**53, 64 * c))) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [min(sum((n * a - b) ** 2 for a, b in zip(r, s)), 2**63 - 1) for r in x]
    c = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in kept], n, deviation, c, e[::-1], u[:, ::-1]


def answer(spark, rows, components=32):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, ids string, x long").repartition(3)
    blocks = integer_blocks(df, "vec_id", "embedding")
    model = fit(blocks, components)
    return whiten(blocks, model).collect(), model


def check(spark, rows, components=32, distinct=True, error=1e-8):
    got, model = answer(spark, rows, components)
    ids, n, deviation, c, e, u = plain(rows)
    k = model.values.size
    assert len(got) == n * k and model.identity_error <= error
    assert np.allclose(model.values, e[:k], rtol=max(error, 1e-9))
    want = {}
    for i, d, z in zip(ids, deviation, c @ u[:, :k] / np.sqrt(e[:k])):
        want.setdefault((i, d), []).append(z)
    seen = {(r["id"], r["deviation"]) for r in got}
    assert seen == set(want)
    trace = (c * c).sum() / n
    for r in got:
        assert r["n"] == n and abs(r["explained"] / (e[r["component"] - 1] / trace) - 1) < 1e-6
        if distinct and len(want[r["id"], r["deviation"]]) == 1:
            assert abs(abs(r["whitened"]) - abs(want[r["id"], r["deviation"]][0][r["component"] - 1])) < 1e-5
    return model


def test_against_dense_decomposition_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 40)) * np.linspace(3, 0.3, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 40), (303, [float("-inf")] * 40), (7, rows[7][1]), (304, rows[9][1]), (305, []), (306, [0.5] * 3), (None, [0.25] * 40)]
    check(spark, rows)


def test_fewer_dimensions_than_components_and_wanted_ones_only(spark):
    r = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate((r.standard_normal((50, 5)) * [5, 4, 3, 2, 1]).tolist())]
    assert check(spark, rows).values.size == 5
    assert check(spark, rows, components=2).values.size == 2


def test_hot_vector_and_equal_eigenvalues(spark):
    r = np.random.default_rng(3)
    signs = [[3.0 * s if d == k else 0.0 for d in range(6)] for k in range(6) for s in (1, -1)]  # a sixfold eigenvalue
    check(spark, [(i, v) for i, v in enumerate(signs)], distinct=False)
    hot = [(i, [1.0, 2.0, -1.0]) for i in range(400)] + [(400 + i, v) for i, v in enumerate((r.standard_normal((100, 3)) * [4, 2, 1]).tolist())]
    check(spark, hot, distinct=False)


def test_components_without_variance_are_left_out(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    assert check(spark, flat).values.size == 1
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)], [(1, []), (2, [])]):
        assert answer(spark, rows) == ([], None)


def test_large_entries_stay_exact(spark):
    r = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate((r.standard_normal((30, 3)) * [1e9, 1e7, 1e5]).tolist())]
    check(spark, rows, error=1e-6)  # eigenvalues 10^8 apart
    rows += [(99, [1e300, 0.0, -1e300])]
    got, model = answer(spark, rows)
    assert {(x["id"], x["deviation"]) for x in got} == set(zip(plain(rows)[0], plain(rows)[2]))


@pytest.mark.parametrize("dims, want", [(64, 32), (300, 12), (200, 1)])
def test_pairs_reach_double_precision_without_the_whole_space(dims, want):
    r = np.random.default_rng(dims)
    q = np.linalg.qr(r.standard_normal((dims, dims)))[0]
    e = np.sort(np.concatenate([r.uniform(0, 1, dims - 20), r.uniform(2, 9, 19), [2.0]]))[::-1]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    used = []
    values, axes, left = leading_pairs(lambda v: (used.append(v.shape[1]), a @ v)[1], dims, want)
    assert np.allclose(values, e[:want], rtol=1e-12) and left.max() <= 64 * 2.3e-16 * np.sqrt(dims) * e[0] * 4
    assert np.abs(axes.T @ axes - np.eye(want)).max() < 1e-12
    assert np.linalg.norm(a @ axes - axes * values, axis=0).max() < 1e-11
    assert len(used) < 200


def test_minres_solves_indefinite_systems_side_by_side():
    r = np.random.default_rng(5)
    a = np.diag([5.0, 3.0, -2.0, 0.5, -7.0])
    b = r.standard_normal((5, 3))
    shift = np.array([1.0, 0.0, 2.0])
    x = minres(lambda v: a @ v - v * shift, b, 5, 0.0)
    assert np.abs(a @ x - x * shift - b).max() < 1e-9


def test_registered_query(spark, data):
    from tenderscope.llm.catalog import QUERIES

    rows = QUERIES["op12_whitening"](spark, data).collect()
    assert len(rows) == 500 * 32 and rows[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    z = np.zeros((500, 32))
    for r in rows:
        z[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(z.T, bias=True) - np.eye(32)).max() < 1e-8 and rows[0]["identity_error"] < 1e-8
