"""Personal data in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderscope.llm.common import read_table
from tenderscope.llm.pii import fit, search
from tenderscope.llm.q_secrets import span_digests
from tenderscope.llm.registry import query


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return span_digests(search(docs, fit(docs), keep=["doc_id"], outputs=("found",)), ("email", "ip", "card", "phone"))
