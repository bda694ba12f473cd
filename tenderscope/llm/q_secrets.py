"""Secrets in ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.llm.common import read_table
from tenderscope.llm.registry import query
from tenderscope.llm.secret_scan import fit, scan


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_digests(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""

    def of_kinds(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("found", lambda x: x["kind"].isin(*kinds))
    return df.select(
        "doc_id",
        *[of_kinds(k).alias(f"n_{k}") for k in kinds],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return span_digests(scan(docs, fit(docs), keep=["doc_id"]), ("assign", "access", "hex"))
