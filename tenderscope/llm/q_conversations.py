"""Shared prefixes of rebuilt ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.llm.common import cut_lineage, read_table
from tenderscope.llm.prefix_trie import ordered_turns, trie
from tenderscope.llm.registry import query

#: Conversations that share the first turns of the first of them.
FAMILY = 20

SQL = r"""
with t as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, role, text
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), crc as (
  -- CRC-32 of the decimal id, folded bit by bit
  select c, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: case when y % 2 = 1 then xor(y >> 1, 3988292384::bigint) else y >> 1 end)) as v
  from (select distinct c from t)
), h as (select c, c - c % 20 as b, xor(v, 4294967295) % 4 as h from crc),
r0 as (
  select h.c, 0 as part, t.pos, t.role, t.text from h join t on t.c = h.b and t.pos <= h.h
  union all select h.c, 1, t.pos, t.role, t.text from h join t on t.c = h.c and t.pos > h.h
), r as (select *, row_number() over (partition by c order by part, pos) as d from r0),
s as (select h.c, list([r.role, r.text] order by d) filter (where r.d is not null) as s from h left join r using (c) group by 1),
e as (select c, coalesce(s, []) as s, coalesce(len(s), 0) as n from s),
p as (select c, n, d, s[1:d] as k from (select *, unnest(range(0, n + 1)) as d from e)),
node as (
  select d, k, min(c) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where n = d), '')) as ends_sha256,
         case when d = 0 then 0 else len(regexp_extract_all(k[d][2], '[^\x20\x09-\x0D]+')) end as w
  from p group by d, k
), link as (select b.d, b.k, a.conv_id as parent from node b join node a on a.d = b.d - 1 and a.k = b.k[1:b.d - 1]),
kids as (select d - 1 as d, k[1:d - 1] as k, count(*) as n from node where d > 0 group by 1, 2),
up as (select d as d0, k as k0, unnest(range(0, d + 1)) as d, k, w, n_convs from node),
sub as (
  select up.d, up.k[1:up.d] as k, sum((n_convs - 1) * w) as saved, count(*) filter (where kids.n is null) as leaves
  from up left join kids on kids.d = up.d0 and kids.k = up.k0 group by 1, 2
)
select conv_id, cast(node.d as bigint) as depth, link.parent as parent_conv_id, n_convs, coalesce(kids.n, 0) as n_children,
       cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, ends_sha256
from node left join link using (d, k) left join kids using (d, k) join sub using (d, k)
"""


def rebuild(conversations: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations: the first h of the family's first conversation, then the own ones after the first h."""
    turns = cut_lineage(ordered_turns(conversations))
    h = F.crc32(F.col("conv").cast("string")) % 4
    convs = turns.where("pos = 1").select("conv")
    heads = turns.where((F.col("pos") <= 3) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("first"), "pos", "turn_hash", "words")
    shared = convs.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("first"), h.alias("h")).where("h > 0").join(heads, "first").where("pos <= h")
    own = turns.where(F.col("pos") > h)
    return (
        convs.select("conv", F.lit(-1).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("turn_hash"), F.lit(0).alias("words"))
        .unionByName(shared.select("conv", F.lit(0).alias("part"), "pos", "turn_hash", "words"))
        .unionByName(own.select("conv", F.lit(1).alias("part"), "pos", "turn_hash", "words"))
    )


@query("op13_prefix_trie", SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    nodes = trie(rebuild(read_table(spark, sf_dir, "conversations")))
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")
    )
