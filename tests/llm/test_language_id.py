from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tenderscope.llm import language_id
from tenderscope.llm.language_id import BUCKETS, bucket_counts, fit, letters_of, predict, train

ALPHABET = {"aa": "abcdeo ", "bb": "uvwxyz ", "cc": "ßäöüñé ", "dd": "日本語文字 "}


def text(r, lang, n):
    return "".join(r.choice(ALPHABET[lang]) for _ in range(n)) + ALPHABET[lang][0]


def plain_counts(t):
    out = np.zeros(BUCKETS, dtype=np.int64)
    words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
    line = [0, *[c for w in words for c in [*map(ord, w), 0]]]
    for n in range(1, 5):
        for i in range(len(line) - n + 1):
            run = line[i : i + n]
            if 0 in run[1:-1] or run == [0]:
                continue
            v = 0
            for k, c in enumerate(run):
                v = (v * 0x9E3779B97F4A7C15 + c + k + 1) & (2**64 - 1)
            out[(((v ^ (v >> 29)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)) >> 50] += 1
    return out


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    docs = [(lang, text(r, lang, r.randint(5, 200))) for lang in ALPHABET for _ in range(120)]
    pairs = []
    for _, t in docs:
        c = bucket_counts(letters_of(t))
        pairs.append((np.flatnonzero(c), c[c > 0].astype(np.float32)))
    return train(pairs, [lang for lang, _ in docs], np.arange(len(docs)) % 5 == 0)


def test_counts_equal_the_plain_definition_in_slices_of_any_size(monkeypatch):
    r = random.Random(2)
    texts = ["", "a", "A b", "é1ü", "İ", "12 --", "x" * 50, " ".join("ab" * r.randint(1, 3) for _ in range(40)), "日本 語"]
    texts += ["".join(r.choice("aB é1-ñ") for _ in range(r.randint(1, 60))) for _ in range(60)]
    for size in (1 << 18, 7, 3, 1):
        monkeypatch.setattr(language_id, "SLICE", size)
        for t in texts:
            assert (bucket_counts(letters_of(t)) == plain_counts(t)).all(), (size, t)


def test_held_out_accuracy_short_texts_and_rejection(model):
    r = random.Random(3)
    for n in (6, 40, 3000):
        found = [(lang, model.score(text(r, lang, n))) for lang in ALPHABET for _ in range(40)]
        assert np.mean([lang == p for lang, (p, _, _) in found]) > 0.98
        assert all(0 <= s <= 1 for _, (_, s, _) in found)
    whole = [model.score(text(r, lang, 80)) for lang in ALPHABET for _ in range(100)]
    assert np.mean([a for *_, a in whole]) > 0.95
    strange = [model.score("".join(r.choice("жщфюъ ηθλ") for _ in range(80))) for _ in range(50)]
    assert np.mean([a for *_, a in strange]) < 0.3  # letters of no learned language


def test_scores_are_calibrated():
    r = np.random.default_rng(4)
    y = r.integers(0, 3, 4000)
    said = np.where(r.random(4000) < 0.8, y, r.integers(0, 3, 4000))  # right in 87 of 100
    logits = 30.0 * np.eye(3)[said] + r.normal(0, 0.5, (4000, 3))
    p = language_id._softmax(logits / language_id._temperature(logits, y))
    assert abs(p.max(1).mean() - (said == y).mean()) < 0.02


def test_odd_rows_and_names(spark):
    r = random.Random(5)
    rows = [(i, text(r, lang, 60), lang, "s", 0.5, 1) for i, lang in enumerate(["aa", "bb"] * 200)]
    rows += [(900, None, "aa", "s", 0.1, 2), (901, "", "aa", None, 0.1, 2), (902, "123 --", "bb", "s", None, 2), (903, text(r, "aa", 30), None, "s", 0.1, 2)]
    rows += [(None, text(r, "bb", 30), "bb", "s", 0.1, 2), rows[0], rows[0], (904, text(r, "bb", 400_000), "bb", "s", 0.1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, h long").repartition(4)
    m = fit(df)
    assert m.langs == ["aa", "bb"]
    got = [tuple(x) for x in df.select("doc_id", "text", "lang", predict(spark, m, df["text"]).alias("p")).select("doc_id", "text", "lang", "p.*").collect()]
    assert len(got) == len(rows)
    for i, t, lang, p, s, a in got:
        if not t or not any(c.isalpha() for c in t):
            assert (p, s, a) == ("und", 0.0, False)
        else:
            assert p == ("aa" if i == 903 else lang or "aa") and 0.5 < s <= 1
    again = fit(df.repartition(2))
    assert (again.weights == m.weights).all() and (again.temperature, again.threshold) == (m.temperature, m.threshold)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, "123", "en")], "doc_id long, text string, lang string")
    for part in (df, df.limit(0)):
        m = fit(part)
        assert m.langs == [] and m.score("some text") == ("und", 0.0, False)


def test_one_row_holding_a_third_of_the_table_keeps_the_sample_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 64)
    r = random.Random(6)
    rows = [(i, text(r, lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)] + [(7, "uvw xyz", "bb")] * 90
    m = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == ["aa", "bb", "cc"] and m.score(text(r, "cc", 50))[0] == "cc"


def test_registered_query_on_held_out_documents(spark, data):
    import pandas as pd

    from tenderscope.llm.catalog import QUERIES

    docs = pd.read_parquet(f"{data}/documents.parquet").set_index("doc_id")
    rows = QUERIES["op11_language_id"](spark, data).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in docs.index if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([docs.lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
