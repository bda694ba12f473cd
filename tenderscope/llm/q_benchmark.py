"""Test items in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.llm.common import read_table
from tenderscope.llm.decontaminate import build_index, find
from tenderscope.llm.registry import query

#: Stretch of words, in item lengths, in which all words of an item count as near.
STRETCH = 2.0

SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select item, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i, w from b where len(w) > 0
), win as (select distinct item, size, array_to_string(w[i:i + size - 1], ' ') as s from bw),
sizes as (select distinct size from win),
dw as (select doc_id, size, unnest(range(1, len(w) - size + 2)) as i, w from d, sizes where len(w) >= size),
occ as (
  select dw.doc_id, dw.i, dw.size, win.item from dw join win on win.size = dw.size and win.s = array_to_string(dw.w[dw.i:dw.i + dw.size - 1], ' ')
), hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + size)) as p from occ) group by 1),
it as (select doc_id, count(distinct item) as n, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from occ) group by 1),
near0 as (
  select d.doc_id, b.item, len(b.w) as size, list_distinct(b.w) as terms, d.w from d, b
  where len(b.w) > 0 and len(list_filter(list_distinct(b.w), lambda x: not list_contains(d.w, x))) = 0
), near as (
  select doc_id, count(distinct item) as n from (
    select doc_id, item, size, terms, w, unnest(range(1, len(w) + 1)) as i from near0)
  where len(list_filter(terms, lambda x: not list_contains(w[i:i + 2 * size - 1], x))) = 0 group by 1
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(it.n, 0) as n_items,
       sha256(coalesce(it.s, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated, coalesce(near.n, 0) as n_near
from d left join hit using (doc_id) left join it using (doc_id) left join near using (doc_id)
"""


@query("op2_decontaminate", SQL)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(read_table(spark, sf_dir, "documents"))
    found = find(index, read_table(spark, sf_dir, "benchmark"), proximity=STRETCH)
    return found.select(
        F.col("id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )
