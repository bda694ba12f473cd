from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tenderscope.llm import hidden_markov as hm


def small_model(classes=5, states=3):
    r = np.random.default_rng(3)
    start, step, emit = r.random(states), r.random((states, states)), r.random((classes, states))
    return hm.Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def paths(model, seq):
    """(probability, path) over all state paths."""
    for path in itertools.product(range(model.start.size), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for (a, b), c in zip(zip(path, path[1:]), seq[1:]):
            p *= model.step[a, b] * model.emit[c, b]
        yield p, path


def test_forward_and_expected_counts_equal_all_paths():
    model = small_model()
    seqs = [[0], [1, 2], [4, 4, 3, 0, 2], [2, 2, 2, 1], [3]]
    cls = np.array(sum(seqs, []), dtype=np.uint16)
    length = np.array([len(s) for s in seqs])
    begin = np.cumsum(length) - length
    want = [math.log10(sum(p for p, _ in paths(model, s))) for s in seqs]
    assert np.allclose(hm.log10_forward(model, cls, begin, length), want)
    starts, steps, emits, loglik = hm.expected_counts(model, cls, begin, length)
    a, b, c = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        total = sum(p for p, _ in paths(model, s))
        for p, path in paths(model, s):
            a[path[0]] += p / total
            for x, y in zip(path, path[1:]):
                b[x, y] += p / total
            for x, k in zip(path, s):
                c[k, x] += p / total
    assert np.allclose(starts, a, atol=1e-4) and np.allclose(steps, b, atol=1e-4) and np.allclose(emits, c, atol=1e-4)
    assert abs(loglik / math.log(10) - sum(want)) < 1e-3


def tokens(t):
    return [*(t or "").encode().lower().split(), b"\n"]


def test_counts_base_scores_and_training(spark, docs_of, prose):
    docs = [(i, " ".join(prose(i, 50) if i % 2 else [w[::-1] for w in prose(i, 50)])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " ".join(prose(5, 3000))), (103, docs[3][1]), (103, docs[3][1]), (104, "unheard of"), (None, "kana")]
    df = docs_of(docs).withColumnRenamed("lang", "id").repartition(3)
    learn = F.col("doc_id") % 5 != 4
    corpus = hm.encode(df, learn=learn)
    count = Counter()
    for i, t in docs:
        if i is None or i % 5 != 4:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    assert (corpus.tokens, corpus.distinct, corpus.single) == (n, v, sum(c == 1 for c in count.values()))
    model, trail = hm.train(corpus, states=2, rounds=4)
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(trail[1:], trail[2:])) and np.allclose(model.emit.sum(0), 1)
    rows = hm.score(corpus, model).collect()
    assert len(rows) == len(docs)
    texts = {str(i): t for i, t in docs if i is not None} | {None: "kana"}
    for r in rows:
        t = tokens(texts[r["id"]])
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(w in count for w in t) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r["score"] < 0
    held = [r for r in rows if r["id"] and int(r["id"]) < 60 and int(r["id"]) % 5 == 4]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_word_probabilities_of_a_state_add_up(docs_of, prose):
    df = docs_of([(i, " ".join(prose(i, 40))) for i in range(20)])
    corpus = hm.encode(df)
    model, _ = hm.train(corpus, states=2, rounds=2)
    inside = corpus.form_tokens > 0
    assert abs(model.emit[: hm.FORMS][inside].sum(0) + model.emit[hm.FORMS :].sum(0) - 1).max() < 0.01


def test_nothing_to_learn_and_no_rows(docs_of):
    df = docs_of([(1, "a b"), (2, None)])
    corpus = hm.encode(df, learn=F.lit(False))
    model, trail = hm.train(corpus)
    rows = hm.score(corpus, model).collect()
    assert corpus.tokens == 0 and trail == [] and {r["n_known"] for r in rows} == {0} and all(math.isfinite(r["score"]) for r in rows)
    none = hm.encode(df.limit(0))
    assert hm.score(none, hm.train(none)[0]).collect() == []
