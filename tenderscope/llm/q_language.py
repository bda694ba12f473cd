"""Language-model scores of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.llm.common import read_table
from tenderscope.llm.hidden_markov import encode, score, train
from tenderscope.llm.registry import query


@query("op8_hidden_markov")
def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    corpus = encode(read_table(spark, sf_dir, "documents"), learn=~held_out)
    model, _ = train(corpus)
    found = score(corpus, model).withColumn("doc_id", F.col("id").cast("long"))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
