from __future__ import annotations

import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from tenderscope.llm.catalog import QUERIES
from tests.llm.test_near_dup import brute


@pytest.fixture
def folder(spark, docs_of, prose, tmp_path):
    item = " ".join(prose(900, 30))
    rows = [(i, " ".join(prose(i, 60)) + (" grumblax" if i % 4 == 0 else "")) for i in range(160)]
    rows += [
        (200, " ".join(prose(1, 60)[:58])),  # near copy of 1
        (201, " ".join(prose(3, 60))),  # copy of 3
        (202, "so " + item),  # holds a test item
        (203, "mail ka@lo.mi or +1 (212) 555-0100 " + " ".join(prose(203, 30))),
        (204, None),
        (205, ""),
        (206, " ".join(prose(206, 20_000))),
        (None, "kana"),
    ]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_stages_take_effect_and_leave_clean_rows(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "tokens":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(seen[name])
    toxic = {i for i, _ in rows if i is not None and i < 160 and i % 4 == 0}
    assert set(seen["toxicity"]) == {i for i, _ in rows} - toxic
    left = [(i, t) for i, t in rows if i in seen["toxicity"]]
    keep = {i for i, c in brute(left).items() if i == c} | {None}
    assert set(seen["near_duplicates"]) == keep and not keep & {200, 201}
    assert set(seen["decontamination"]) == keep - {202}
    hidden = seen["personal_data"]
    assert set(hidden) == keep - {202} and hidden[203]["text"].startswith("mail [email] or [phone] ")
    assert hidden[203]["n_chars"] == len(hidden[203]["text"]) and hidden[5]["text"] == dict(rows)[5] and hidden[204]["text"] is None
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in seen["tokens"].items():
        ids = library.encode(hidden[i]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids"] == b"".join(x.to_bytes(4, "little") for x in ids)


def test_run_equals_the_stages_and_empty_tables(spark, folder, tmp_path):
    path, rows = folder
    assert corpus_pipeline.run(spark, path).count() == len(rows) - 40 - 3
    empty = f"{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_a_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
