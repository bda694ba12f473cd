"""Languages of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.llm.common import read_table
from tenderscope.llm.language_id import fit, predict
from tenderscope.llm.registry import query


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language, learned from the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), predict(spark, model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.accepted")
