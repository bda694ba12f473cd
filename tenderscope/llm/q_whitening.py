"""Whitened ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderscope.llm.common import read_table
from tenderscope.llm.registry import query
from tenderscope.llm.whitening import fit, integer_blocks, whiten


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on up to 32 components of their covariance, scaled to variance 1."""
    blocks = integer_blocks(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return whiten(blocks, fit(blocks)).withColumnRenamed("id", "vec_id")
