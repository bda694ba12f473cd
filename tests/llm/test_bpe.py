from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tenderscope.llm.bpe import Bpe, encode_decode, load

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return Bpe(PATH), Tokenizer.from_file(PATH)


def test_equals_the_library_on_odd_texts(both):
    mine, library = both
    r = random.Random(7)
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x130, 0x1E9E, 0x2028, 0x200B, 0x3000, 0x4E00, 0xAC00, 0x1F600, 0x301, 0xFB01]]
    pool += ["<|startoftext|>", "<|endoftext|>", "'s", "'LL", "ΑΣ ", "the", "ing ", " ", "\x1c"]
    letters = "etaoinshrdlu" * 3 + "éçßqz"
    texts = ["", " ", "x" * 5000, "ab " * 20000, "".join(r.choice(letters) for _ in range(20_000))]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(40, 120))) for _ in range(300)] + ["".join(r.choice(pool) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        got = mine.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert mine.decode(got).decode() == library.decode(ids, skip_special_tokens=False)


def test_no_token_spans_a_cut(both):
    mine, _ = both
    assert any(len(mine.cut(w.encode())) > 1 for w in ("qzxj", "éßø"))
    for name, i in list(zip(mine.names, range(len(mine.names))))[:20000]:
        word = name.removesuffix(mine.end)
        if word.isascii() and i not in mine.special.values():
            assert len(mine.cut(word.encode())) == 1


def test_rows_nulls_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Hello there", "c"), (3, "Hello there", "c")], "doc_id long, text string, n_tokens string")
    rows = encode_decode(df, PATH).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [0, 0, 2, 2]
    assert rows[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == rows[1]["decoded_sha256"]
    assert rows[2]["decoded"] == "hello</w> there</w>" and rows[2]["text"] == "Hello there"
    assert encode_decode(df.limit(0), PATH).collect() == []


def test_a_worker_keeps_no_memory_of_earlier_tasks(spark):
    df = spark.createDataFrame([(i, f"word{i} other{i % 7}") for i in range(200)], "doc_id long, text string").repartition(4)
    assert encode_decode(df, PATH).agg({"n_tokens": "sum"}).first()[0] > 400

    def held(batches):
        for batch in batches:
            yield batch.assign(id=len(load(PATH).chunks) + len(load(PATH).fragments))

    # the same workers, whatever they do next
    assert spark.range(0, 64, 1, 8).mapInPandas(held, "id long").agg({"id": "max"}).first()[0] == 0
