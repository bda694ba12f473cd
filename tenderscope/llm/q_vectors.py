"""Exact top-k over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.llm.common import read_table
from tenderscope.llm.registry import query
from tenderscope.llm.topk import exact_top_k, grid_vectors

SQL = """
with g as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from g q join g c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""


@query("op4_exact_top_k", SQL)
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = grid_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_top_k(vectors.where(F.col("id") % 20 == 0), vectors, k=20)
