"""Licenses in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.llm.common import read_table
from tenderscope.llm.licenses import scan
from tenderscope.llm.registry import query


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(listed, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"),
    )
