from __future__ import annotations

import re

from tenderscope.llm.decontaminate import build_index, clean, find


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items, window, stretch):
    out = []
    for i, t in docs:
        d, hit, found, near = words(t), set(), set(), set()
        for item, text in items:
            w = words(text)
            if item is None or not w:
                continue
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                for p in range(len(d) - n + 1):
                    if d[p : p + n] == w[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
            size = int(stretch * len(w))
            if any(set(w) <= set(d[p : p + size]) for p in range(len(d))):
                near.add(str(item))
        out.append((str(i), len(d), len(hit), sorted(found), sorted(near)))
    return sorted(out)


def test_against_brute_force(spark, docs_of, prose):
    items = [(i, " ".join(prose(i, 25))) for i in range(6)] + [(7, "Solo Réponse"), (8, ""), (9, None), (None, "kana"), (10, " ".join(prose(1, 25)))]
    docs = [(i, ", ".join(prose(50 + i, 80))) for i in range(12)]
    docs += [
        (20, "x " + items[0][1].upper() + " y " + items[0][1]),
        (21, " ".join(prose(2, 25)[5:17])),
        (22, " ".join(prose(3, 25)[:9])),
        (23, "so... SOLO -- réponse!"),
        (24, None),
        (25, ""),
        (26, " ".join(reversed(prose(4, 25)))),
        (26, " ".join(reversed(prose(4, 25)))),
        (27, " ".join(prose(99, 4000)) + " " + items[5][1]),
    ]
    want = brute(docs, items, 10, 2)
    table = spark.createDataFrame(items, "item_id long, text string")
    for block, slice_words in ((1 << 20, 1 << 20), (300, 20)):
        index = build_index(docs_of(docs), block_bytes=block)
        got = find(index, table, proximity=2.0, slice_words=slice_words)
        assert sorted((r["id"], r["n_words"], r["n_hit"], sorted(r["items"]), sorted(r["near_items"])) for r in got.collect()) == want
    kept = clean(docs_of(docs).withColumnRenamed("lang", "id"), table)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(int(w[0]) for w in want if not w[2])


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of([(1, "a b c")])
    assert [r["n_hit"] for r in find(build_index(docs), none).collect()] == [0]
    assert find(build_index(docs.limit(0)), none).collect() == []
    assert clean(docs, none).count() == 1


def test_clean_rows_without_id_and_columns_of_any_name(spark, prose):
    from tenderscope.llm.decontaminate import clean

    item = " ".join(prose(70, 14))
    bad = " ".join([*prose(71, 20), item, *prose(72, 20)])
    rows = [(None, bad, "a", "n", 1), (None, " ".join(prose(73, 40)), "b", "n", 1), (4, bad, "c", "n", 1), (5, " ".join(prose(74, 40)), "d", "n", 1), (None, None, "e", "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hit__ string, name string, id int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = clean(df, items)
    assert got.columns == df.columns and sorted(r["hit__"] for r in got.collect()) == ["b", "d", "e"]
