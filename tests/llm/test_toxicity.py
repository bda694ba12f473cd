from __future__ import annotations

import random

import numpy as np

from tenderscope.llm import toxicity


def labelled(prose, n=240):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        w, bad = prose(i, 60), i % 4 == 0
        if bad:
            w.insert(r.randint(0, 60), r.choice(("grumblax", "grumblaxen", "snorf")))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def brute_nearest(index, terms, counts, examples):
    def vec(t, c):
        v = np.zeros(index.idf.size)
        v[list(t)] = (1 + np.log(np.array(c, dtype=float))) * index.idf[list(t)]
        return v / np.linalg.norm(v)

    mine = vec(terms, counts)
    scores = sorted(((float(mine @ vec(e[0], e[1])), e[4], e[3]) for e in examples if e[0]), reverse=True)
    out, covered, last = {}, 0, 0.0
    for s, i, n in scores:
        if s <= 1e-12 or (covered >= toxicity.NEAREST and s < last - 1e-9):
            break
        out[i] = s
        covered += n
        if covered >= toxicity.NEAREST and not last:
            last = s
    return out


def test_nearest_are_exact():
    r = random.Random(9)
    terms = toxicity.Terms(np.array(sorted(r.getrandbits(63) for _ in range(40)), dtype=np.uint64))
    examples = {}
    for i in range(900):
        t = tuple(sorted(r.sample(range(40), r.randint(0, 6))))
        c = tuple(r.randint(1, 3) for _ in t)
        examples.setdefault((t, c), (t, c, r.randint(0, 1), 1, i))
    examples = list(examples.values())
    index = toxicity.Index(terms, 1 + np.random.default_rng(0).random(40), examples)
    for _ in range(150):
        t = np.array(sorted(r.sample(range(40), r.randint(1, 6))))
        c = np.array([r.randint(1, 3) for _ in t])
        found, cosines = index.nearest(t, c)
        got = {index.ids[i]: s for i, s in zip(found, cosines)}
        want = brute_nearest(index, t, c, examples)
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_held_out_accuracy_and_odd_rows(spark, docs_of, prose):
    docs, labels = labelled(prose)
    docs += [(500, None), (501, ""), (502, "snorf " * 40_000), (503, docs[4][1]), (503, docs[4][1]), (None, "snorf")]
    labels += [(500, 1, None), (503, None, 1), (9999, 1, 1), (8, 1, 0), (None, 1, 1)]
    df = docs_of(docs).withColumnRenamed("lang", "score")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    index = toxicity.fit(df, y, learn=df.where("doc_id % 5 <> 0"))
    rows = toxicity.score(df, index).collect()
    assert len(rows) == len(docs)
    got = {r["doc_id"]: r["score"] for r in rows}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(0, 240, 5))
    assert got[500] == got[501] < 0.3 < got[502] and all(0 <= s <= 1 for s in got.values())
    near = next(r for r in rows if r["doc_id"] == 20)["evidence"]
    assert near and 0.3 < near[0]["cosine"] < 1 and near[0]["id"] % 4 == 0  # plain cosine: labels do not enter it


def test_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs_of([(1, "a b"), (2, None)])
    assert {r["score"] for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.5}
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), none)).collect() == []
    ones = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] > 0.5 for r in toxicity.score(df, toxicity.fit(df, ones)).collect()} == {True}


def test_rare_words_same_contexts_and_copies_count(spark, docs_of, prose):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(300):
        w, bad = prose(i, 60), False
        if i < 3:  # a toxic word in three examples only
            w.insert(r.randint(1, 59), "zwackelig")
            bad = True
        elif i < 43:  # one that always follows the same word
            w[30:30] = ["du", "bratzkopf"]
            bad = True
        elif i == 43:  # no telling word at all
            bad = True
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    fresh = [(900, " ".join([*prose(900, 30), "zwackelig", *prose(901, 30)])), (901, " ".join([*prose(902, 30), "du", "bratzkopf", *prose(903, 30)]))]
    fresh += [(902, docs[43][1]), (903, " ".join(prose(904, 60))), (904, docs[200][1])]
    df = docs_of(docs + fresh)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    index = toxicity.fit(df, y)
    got = {x["doc_id"]: x for x in toxicity.score(df.where("doc_id >= 900"), index).collect()}
    assert got[902]["evidence"][0]["id"] == 43 and abs(got[902]["evidence"][0]["cosine"] - 1) < 1e-9
    assert got[904]["evidence"][0]["id"] == 200 and abs(got[904]["evidence"][0]["cosine"] - 1) < 1e-9
    assert {e["id"] for e in got[900]["evidence"]} >= {0, 1}  # the third shares fewer of its other words
    assert all(3 <= e["id"] < 43 for e in got[901]["evidence"]) and len(got[901]["evidence"]) == 3
    clean = got[903]["score"], got[904]["score"]
    assert got[901]["score"] > 0.3 > max(clean) and got[900]["score"] > max(clean), got


def test_pruned_search_is_exact():
    r = random.Random(8)
    size = 400
    terms = toxicity.Terms(np.array(sorted(r.getrandbits(63) for _ in range(size)), dtype=np.uint64))
    examples = {}
    for i in range(3000):  # few frequent terms, many rare ones
        t = tuple(sorted({min(int(size * r.random() ** 4), size - 1) for _ in range(30)}))
        examples.setdefault(t, (t, tuple(r.randint(1, 4) for _ in t), r.randint(0, 1), r.randint(1, 2), i))
    examples = list(examples.values())
    idf = 0.05 + np.linspace(0, 1, size) ** 2 * 9
    index = toxicity.Index(terms, idf, examples)
    for _ in range(60):
        t = np.array(sorted({min(int(size * r.random() ** 4), size - 1) for _ in range(30)}))
        c = np.array([r.randint(1, 4) for _ in t])
        found, cosines = index.nearest(t, c)
        got = {index.ids[i]: s for i, s in zip(found, cosines)}
        want = brute_nearest(index, t, c, examples)
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_blocks_of_other_languages_stay_closed():
    r = random.Random(3)
    terms = toxicity.Terms(np.array(sorted(r.getrandbits(63) for _ in range(600)), dtype=np.uint64))
    examples = {}
    for i in range(3000):  # three sets of words, a few words in all of them
        at = 200 * (i % 3)
        t = tuple(sorted({*range(at, at + 8), *r.sample(range(at + 8, at + 190), 12), *r.sample(range(590, 600), r.randint(0, 2))}))
        examples.setdefault(t, (t, tuple(r.randint(1, 4) for _ in t), r.randint(0, 1), r.randint(1, 2), i))
    examples = list(examples.values())
    index = toxicity.Index(terms, 0.5 + np.random.default_rng(1).random(600), examples)
    texts = []
    for i in range(90):
        at = 200 * (i % 3)
        t = np.array(sorted({*range(at, at + 8), *r.sample(range(at + 8, at + 190), 12), *r.sample(range(590, 600), 1)}))
        texts.append((t, np.array([r.randint(1, 4) for _ in t])))
    texts.append((np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)))
    for (t, c), (found, cosines) in zip(texts, index.search(texts)):
        got = {index.ids[i]: s for i, s in zip(found, cosines)}
        want = brute_nearest(index, t, c, examples) if len(t) else {}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    assert index.opened < 0.5 * index.looked


def brute_vote(index, terms, counts, examples):
    """The vote by its definition, over ``brute_nearest``."""
    near = brute_nearest(index, terms, counts, examples)
    own = index.vector(terms, counts)
    toxic = total = covered = 0.0
    for e in examples:
        if e[4] in near and e[0]:
            w = (1 + np.log(np.array(e[1], dtype=float))) * index.idf[list(e[0])]
            w /= np.linalg.norm(w)
            part = dict(zip(e[0], w))
            told = sum(g * part.get(t, 0) * index.strength[t] for t, g in zip(terms.tolist(), own))
            weight = told / near[e[4]] / (1.05 - min(near[e[4]], 1))
            toxic, total, covered = toxic + weight * e[2], total + weight * e[3], covered + e[3]
    missing = max(toxicity.NEAREST - covered, 1) * toxicity.FLOOR / 1.05
    return (toxic + missing * index.background) / (total + missing)


def test_votes_equal_their_definition():
    r = random.Random(12)
    size = 500
    terms = toxicity.Terms(np.array(sorted(r.getrandbits(63) for _ in range(size)), dtype=np.uint64))
    examples = {}
    for i in range(900):
        t = tuple(sorted({min(int(size * r.random() ** 3), size - 1) for _ in range(r.choice((0, 5, 20)))}))
        examples.setdefault(t, (t, tuple(r.randint(1, 4) for _ in t), r.randint(0, 1), 1, i))
    examples = list(examples.values())
    draw = np.random.default_rng(2)
    strength = np.where(draw.random(size) < 0.2, 1 + draw.random(size), toxicity.FLOOR)
    index = toxicity.Index(terms, 0.2 + draw.random(size), examples, strength)
    for _ in range(40):
        t = np.array(sorted({min(int(size * r.random() ** 3), size - 1) for _ in range(20)}))
        c = np.array([r.randint(1, 3) for _ in t])
        assert abs(index.votes([(t, c)])[0][0] - brute_vote(index, t, c, examples)) < 1e-9


def test_very_long_examples(spark, docs_of, prose):
    docs = [(i, " ".join(prose(i, 4000)) + (" snorf" * 40 if i % 4 == 0 else "")) for i in range(200)]
    df = docs_of(docs)
    y = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(df, y, learn=df.where("doc_id >= 20"))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(df, index, keep=["doc_id"]).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(20))


def test_sent_index_is_lean_and_finds_the_same():
    import pickle

    r = random.Random(21)
    size = 2000
    terms = toxicity.Terms(np.array(sorted(r.getrandbits(63) for _ in range(size)), dtype=np.uint64))
    examples = [(t := tuple(sorted(r.sample(range(size), 120))), tuple(r.randint(1, 9) for _ in t), r.randint(0, 1), 1, i) for i in range(2500)]
    index = toxicity.Index(terms, 0.2 + np.random.default_rng(5).random(size), examples)
    here = pickle.loads(pickle.dumps(index))
    postings = 120 * len(examples)
    held = sum(v.nbytes for v in here.__dict__.values() if isinstance(v, np.ndarray) and v.size == postings)
    assert held <= 4 * postings  # every worker of an executor holds the lists: no second copy, no doubles
    term, code = here.by_example()
    for i in (0, 7, 2499):
        at, e = slice(here.begin[i], here.begin[i + 1]), examples[here.ids[i]]
        assert tuple(term[at]) == e[0] and tuple(here.counts[code[at]]) == e[1]
    texts = [(np.array(sorted(r.sample(range(size), 90))), np.array([r.randint(1, 3) for _ in range(90)])) for _ in range(30)]
    for (t, c), mine, sent in zip(texts, index.search(texts), here.search(texts)):
        assert (mine[0] == sent[0]).all() and (mine[1] == sent[1]).all()
        want = brute_nearest(index, t, c, examples)
        assert set(here.ids[i] for i in sent[0]) == set(want)
