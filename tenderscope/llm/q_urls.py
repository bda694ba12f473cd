"""Verdicts on every url of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderscope.llm.common import read_table
from tenderscope.llm.registry import query
from tenderscope.llm.url_filter import judge

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Links in this SQL: absolute canonical links and refresh targets, in one tag each.
SQL = r"""
with recursive p as (
  select page_id, url, html, coalesce(lower(regexp_extract(url, '://([^/?#]*)', 1)), '') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path,
         regexp_extract(url, '://[^/?#]*([^#]*)', 1) as rest
  from pages
), n as (
  select *, case when host <> '' then host || case when rest = '' then '/' else rest end end as node from p
), t as (
  select node as source, unnest(regexp_extract_all(html, '(?is)(<(?:link|meta)\b[^>]*>)', 1)) as tag from n
), h as (
  select source, case when regexp_matches(tag, '(?i)^<link')
    then regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    else regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) end as link
  from t where regexp_matches(tag, '(?is)rel\s*=\s*["'']?\s*canonical|http-equiv\s*=\s*["'']?\s*refresh')
), e as (
  select source, lower(regexp_extract(link, '://([^/?#]*)', 1)) || coalesce(nullif(regexp_extract(link, '://[^/?#]*([^#]*)', 1), ''), '/') as target
  from h where link like '%://%' and source is not null
), b as (
  select source as x, target as y from e where source <> target union select target, source from e where source <> target
), reach as (
  select x as id, x as other from b union select reach.id, b.y from reach join b on reach.other = b.x
), d(kind, rh, rp) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), al as (
  select id, other, regexp_extract(other, '^([^/?#]*)', 1) as host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) as path from reach
), alv as (
  select al.id, al.other, arg_max(kind, length(rh || rp)) as kind
  from al join d on (al.host = rh or ends_with(al.host, '.' || rh)) and starts_with(al.path, rp) group by 1, 2
), said as (
  select id, case when bool_or(kind = 'allow') then 'allow' when bool_or(kind = 'block') then 'block' end as said from alv group by 1
), sizes as (select id, count(distinct other) as n from reach group by 1),
own as (
  select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(kind, length(rh || rp)) as kind
  from n join d on (n.host = rh or ends_with(n.host, '.' || rh)) and starts_with(n.path, rp) group by 1
)
select n.page_id, n.host, n.path, own.rule, coalesce(own.kind, said.said, 'allow') as verdict, coalesce(sizes.n, 1) as n_aliases
from n left join own using (page_id) left join said on said.id = n.node left join sizes on sizes.id = n.node
"""


@query("op1_url_filter", SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = judge(read_table(spark, sf_dir, "pages"), RULES)
    return pages.select("page_id", "host", "path", "rule", "verdict", "n_aliases")
