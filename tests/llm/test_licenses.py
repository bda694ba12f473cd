from __future__ import annotations

import itertools
import random

from tenderscope.llm.licenses import TEMPLATES, Scanner, align, increasing, scan


def test_increasing_is_longest():
    r = random.Random(2)
    for _ in range(300):
        v = r.sample(range(9), r.randint(0, 7))
        got = [v[i] for i in increasing(v)]
        best = max((len(c) for n in range(len(v) + 1) for c in itertools.combinations(v, n) if list(c) == sorted(c)), default=0)
        assert got == sorted(got) and len(got) == best


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignments_are_common_subsequences():
    r = random.Random(5)
    for _ in range(500):
        a = [r.randint(0, 12) for _ in range(r.randint(0, 15))]
        b = [x for x in a if r.random() < 0.8] or [1]
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(set(pairs))
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b)
        if len(set(a)) == len(a):
            assert len(pairs) == lcs(a, b)  # unique words only: patience finds the longest


def test_planted_notices_and_odd_rows(docs_of, prose):
    mit, apache = TEMPLATES["MIT"], TEMPLATES["Apache-2.0"]
    rows = [
        (1, " ".join(prose(1, 500)) + f"\n{mit}.\n" + " ".join(prose(2, 500))),
        (2, f"{apache}. {apache.upper()}! {mit}"),
        (3, "the license of this work is under version 2"),
        (4, None),
        (5, ""),
        (6, apache.replace("Version", "version number")),
        (7, (" ".join(prose(3, 50)) + " " + TEMPLATES["GPL-3.0"] + " ") * 200),
        (8, " ".join(prose(4, 3000)) + " the released"),
    ]
    df = docs_of(rows).withColumnRenamed("lang", "licenses")
    got = {r["doc_id"]: [(x["name"], x["start"], x["end"]) for x in r["licenses"]] for r in scan(df).collect()}
    assert got[1] == [("MIT", 500, 505)]
    assert got[2] == [("Apache-2.0", 0, 8), ("Apache-2.0", 8, 16), ("MIT", 16, 21)]
    assert got[3] == got[4] == got[5] == got[8] == []
    assert got[6] == [("Apache-2.0", 0, 9)] and len(got[7]) == 200
    assert scan(df.limit(0)).collect() == [] and Scanner({}).scan("mit license") == (2, [])
