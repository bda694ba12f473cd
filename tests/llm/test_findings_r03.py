from __future__ import annotations

import math
import pickle
import tracemalloc

import numpy as np

from tenderscope.llm import toxicity
from tenderscope.llm.decontaminate import clean


def test_texts_are_not_shuffled_for_a_few_hits(spark, docs_of, prose):
    items = spark.createDataFrame([(1, " ".join(prose(1, 25)))], "item_id long, text string")
    kept = clean(docs_of([(i, " ".join(prose(i, 40))) for i in range(4)] + [(9, None)]), items)
    plan = kept._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 9]


def test_searches_of_one_group_share_their_products():
    terms = toxicity.Terms(np.arange(1, 301, dtype=np.uint64))
    rng = np.random.default_rng(3)
    examples = []
    for i in range(400):
        t = tuple(sorted({0, *rng.integers(1, 300, 5).tolist()}))
        examples.append((t, (1,) * len(t), i % 2, 1, i))
    index = toxicity.Index(terms, np.ones(300), examples)
    index.terms.of = lambda text: (np.array([0, int(text)]), np.array([1, 1]))
    made, chunk = [], index._chunk
    index._chunk = lambda *a: made.append(len(a[0])) or chunk(*a)
    got = index.judge([str(1 + i % 299) for i in range(299)] * 3)
    assert len(got) == 897 and len(made) == math.ceil(299 / 64)
    wide = index.search([index.terms.of("7")])[0]
    dense = np.array([[(k in e[0]) / math.sqrt(len(e[0])) for k in range(300)] for e in examples])
    best = np.sort(dense[:, [0, 7]].sum(1) / math.sqrt(2))[::-1]
    assert np.allclose(np.sort(wide[1])[::-1][:64], best[:64])


def test_the_index_is_built_in_little_memory():
    n, size = 200, 20_000
    rng = np.random.default_rng(1)
    examples = [(np.sort(rng.choice(size, 5_000, replace=False)).astype(np.int32), np.ones(5_000, dtype=np.int32), i % 2, 1, i) for i in range(n)]
    sent = pickle.dumps(toxicity.Index(toxicity.Terms(np.arange(1, size + 1, dtype=np.uint64)), np.ones(size), examples))
    tracemalloc.start()
    index = pickle.loads(sent)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(index.share, 1 / math.sqrt(5_000)) and peak / index.term.size < 32  # bytes a posting
