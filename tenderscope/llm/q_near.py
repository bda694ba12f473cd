"""Near-duplicate classes of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.llm.common import read_table
from tenderscope.llm.near_dup import classes
from tenderscope.llm.registry import query

SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as x
  from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from d where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by 1),
l as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select x, y from l join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)
), reach as (
  select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x
), c as (select x, min(y) as m from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) as component_id,
       d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) as kept
from d left join n using (doc_id) left join c on c.x = d.doc_id
"""


@query("op9_near_duplicates", SQL)
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
