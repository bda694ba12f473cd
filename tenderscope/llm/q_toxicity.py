"""Toxicity of ``documents``, learned from ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.llm.common import read_table
from tenderscope.llm.registry import query
from tenderscope.llm.toxicity import fit, score

#: Score from which a document counts as toxic.
CUT = 0.3


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    index = fit(docs, read_table(spark, sf_dir, "labels"), learn=docs.where(~held_out))
    scored = score(docs, index, keep=["doc_id"], evidence=False)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
