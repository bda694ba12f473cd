from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from tenderscope.llm import near_dup


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i == j or (a and b and 100 * len(a & b) >= 75 * len(a | b)):
            x, y = label[i], label[j]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return label


def changed(words, r, share):
    return " ".join(r.choice(("neu", "alt", w)) if r.random() < share else w for w in words)


@pytest.fixture
def rows(prose):
    r = random.Random(11)
    out = [(i, " ".join(prose(i, 120))) for i in range(40)]
    for base in range(6):
        out += [(100 * (base + 1) + k, changed(prose(base, 120), r, 0.012 * k)) for k in range(8)]
    shared = " ".join(prose(77, 60))
    out += [(900 + k, shared + " " + " ".join(prose(900 + k, 60))) for k in range(30)]  # a passage in common is no link
    out += [(1000, out[0][1]), (1001, out[0][1].upper()), (1002, None), (1003, ""), (1004, " \t\n"), (1005, "two words"), (1006, "Two  Words"), (1007, "words two")]
    out += [(1008, out[5][1]), (1008, out[6][1])]  # one id, two texts
    return out


def answer(df):
    return {r["id"]: r["component_id"] for r in near_dup.classes(df).collect()}


def test_against_brute_force(docs_of, rows):
    assert answer(docs_of(rows)) == brute(rows)


def test_large_nodes_branch_and_are_dealt(docs_of, rows, monkeypatch):
    """With tiny bounds nodes recurse to the full depth and groups are compared node by node."""
    monkeypatch.setattr(near_dup, "MOST_DOCS", 4)
    monkeypatch.setattr(near_dup, "DEPTH", 3)
    assert answer(docs_of(rows)) == brute(rows)


def test_keep_one_and_empty(docs_of):
    df = docs_of([(5, "a b c d e f g"), (3, "A b c d e f g"), (9, "other words here"), (9, "other words here"), (None, "a b c d e f g"), (7, None), (8, "")])
    df = df.withColumnRenamed("lang", "id")
    assert sorted(str(r["doc_id"]) for r in near_dup.keep_one(df).collect()) == ["3", "7", "8", "9", "None"]
    assert near_dup.keep_one(df.limit(0)).collect() == []
    assert near_dup.classes(docs_of([])).collect() == []


def test_a_very_long_text(docs_of, prose):
    long = " ".join(prose(1, 60_000))
    got = answer(docs_of([(1, long), (2, long + " end"), (3, " ".join(prose(2, 60_000)))]))
    assert got == {1: 1, 2: 1, 3: 3}


def test_confirmed_is_a_spanning_forest():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 2**60, 100).astype(np.uint64))
    sets = [np.sort(np.concatenate((base[k:], r.integers(0, 2**60, k).astype(np.uint64)))) for k in (0, 1, 2, 3, 60, 61)]
    links = near_dup.confirmed(sets, 75)
    assert len(links) == 3 and {x for p in links for x in p} == {0, 1, 2, 3}


def test_keep_one_of_a_repeated_id_whatever_the_order(spark, prose):
    from tenderscope.llm.near_dup import keep_one

    a, b = " ".join(prose(80, 30)), " ".join(prose(81, 30))
    rows = [(1, max(a, b), "x", 1), (1, min(a, b), "y", 2), (2, min(a, b) + " more", "z", 3), (None, a, "n", 4), (None, a, "n", 5)]
    for parts in (1, 3):
        got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, stay__ string, nth__ int").repartition(parts)).collect()
        assert sorted((r["doc_id"] or 0, r["stay__"]) for r in got) == [(0, "n"), (0, "n"), (1, "y")]


def test_no_two_members_of_a_large_node_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "MOST_DOCS", 4)
    monkeypatch.setattr(near_dup, "DEPTH", 2)
    sketch = near_dup.sketch_of(np.arange(1, 50, dtype=np.uint64))
    reps = spark.createDataFrame([(i, 49, bytearray(sketch)) for i in range(300)], "rep long, n long, sketch binary")
    nodes = near_dup.tree_nodes(reps).toPandas().groupby("node")["rep"].agg(list)
    assert nodes.map(len).max() < 30
    together = {p for m in nodes for p in itertools.combinations(sorted(set(m)), 2)}
    assert len(together) == 300 * 299 // 2
