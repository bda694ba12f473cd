"""Encoding and decoding of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tenderscope.llm.bpe import encode_decode
from tenderscope.llm.common import read_table
from tenderscope.llm.registry import query


@query("op5_bpe_round_trip")
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_decode(read_table(spark, sf_dir, "documents"), path, keep=["doc_id"], outputs=())
