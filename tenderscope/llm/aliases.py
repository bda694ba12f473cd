"""Connected components of aliases: the smallest node that each node reaches.

Every round hands a node's larger neighbours to the least node it knows (large star),
then its smaller ones (small star). Both steps keep the components and bring nodes closer
to their least; rounds grow with the logarithm of the longest path. Minima are combined
before the shuffle and joined back, so a node with very many aliases is no task of its own,
and no component is ever gathered. Each round is written to the shared folder.

Defined cases
- Null ends and links of a node to itself join nothing (the node of a self link is still listed).
- Repeated links count once; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderscope.llm.common import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def alias_groups(links: DataFrame) -> DataFrame:
    """``id, component`` for every node of ``source, target``."""
    links = cut_lineage(links.select("source", "target").where("source is not null and target is not null").distinct())
    edges = links.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut_lineage(both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    nodes = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).distinct()
    return nodes.join(edges.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
