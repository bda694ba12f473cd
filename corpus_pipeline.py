"""A corpus from documents to tokens, in five stages; each works on all that the one before it kept.

1. toxicity: documents that score as toxic go.
2. near duplicates: one document of each class stays.
3. decontamination: documents that hold a passage of a test item go.
4. personal data: spans are replaced by their kind in brackets; ``n_chars`` follows.
5. tokens: every text as token ids, with the digests of ids and of the decoded text.

All stages but the last return the columns of ``documents`` (and whatever other columns
came along). Null texts pass the filters and are empty token sequences; empty tables
give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.llm import bpe, decontaminate, near_dup, pii, toxicity
from tenderscope.llm.common import cut_lineage, free_name, read_table
from tenderscope.llm.q_toxicity import CUT


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(spark, index, F.col("text")) < CUT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden = free_name(docs.columns, "hidden__")
    found = docs.withColumn(hidden, pii.redacted_column(pii.fit(docs), F.col("text")))
    changed = ~F.col(hidden).eqNullSafe(F.col("text"))
    size = F.when(changed, F.length(hidden).cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col(hidden).alias("text"), "n_chars": size.alias("n_chars")}
    return found.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], outputs=("ids",))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("personal_data", hide_personal),
    ("tokens", tokens),
]

#: No SQL states the scores of the first and the spans of the fourth stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next.

    The stage tables stay until ``session.clear_scratch`` is called, which may be done once the result has been stored.
    """
    docs = read_table(spark, sf_dir, "documents")
    for _name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
