"""Network tables over the award lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderscope.functions.text import node_slug
from tenderscope.operators import cleaning as cl, network as nw
from tenderscope.plans import inputs as inp
from tenderscope.plans.inputs import with_views
from tenderscope.plans.registry import query
from tenderscope.session import cut_lineage

#: Processes from which a buyer's concentration counts (over its edges).
NICHE_PROCESSES = 20
CAPS = nw.SampleCaps()
SUPPLIER = "^Supplier#0*7$"
BUYER = "^Customer#0*7$"

inp.add_view(
    "edges",
    "awards",
    """net_lines as (select * from awards where awarded or line_no = 3),
    seg as (select buyer_name, supplier_id, segment, row_number() over (partition by buyer_name, supplier_id order by count(*) desc, segment) as r from net_lines group by 1, 2, 3),
    dep as (select buyer_name, supplier_id, department, row_number() over (partition by buyer_name, supplier_id order by count(*) desc, department) as r from net_lines group by 1, 2, 3),
    edges as (select e.*, seg.segment, dep.department from (
      select buyer_name as buyer, supplier_id, min(supplier_name) as supplier_name, sum(value) as value, count(distinct process_id) as n_processes
      from net_lines group by 1, 2) e
      join seg on seg.buyer_name = e.buyer and seg.supplier_id = e.supplier_id and seg.r = 1
      join dep on dep.buyer_name = e.buyer and dep.supplier_id = e.supplier_id and dep.r = 1)""",
)
_SLUG = "':' || coalesce(nullif(substr(regexp_replace(upper({c}), '[^A-Z0-9]+', '_', 'g'), 1, 48), ''), 'X')"
_E, _P = "'e' || " + _SLUG.format(c="buyer"), "'p' || " + _SLUG.format(c="supplier_id")
inp.add_view(
    "sample",
    "edges",
    f"""marked as (select *, regexp_matches(supplier_name, '{SUPPLIER}') or regexp_matches(buyer, '{BUYER}') as anchor,
        sum(value) over (partition by buyer) as buyer_total, sum(value) over (partition by supplier_id) as supplier_total from edges),
    niche_ok as (select buyer from edges group by 1 having sum(n_processes) >= {NICHE_PROCESSES}),
    niche as (select buyer from (select buyer, sum(s * s) as h from (select buyer, cast(value as double) / cast(buyer_total as double) as s from marked)
        group by 1 having buyer in (select buyer from niche_ok) order by round(h * 10000, 6) desc, buyer limit {CAPS.niches})),
    seeds as (select buyer from (select buyer from edges group by 1 order by sum(value) desc, buyer limit {CAPS.seed_buyers})
        union select buyer from edges where regexp_matches(buyer, '{BUYER}') union select buyer from niche),
    hub as (select supplier_id from edges group by 1 order by sum(value) desc, supplier_id limit {CAPS.hub_suppliers}),
    kept as (select * from (
        select buyer, supplier_id from (select *, row_number() over (partition by buyer order by value desc, supplier_id) as r from edges where buyer in (select buyer from seeds)) where r <= {CAPS.suppliers_per_buyer}
        union select buyer, supplier_id from (select *, row_number() over (partition by supplier_id order by value desc, buyer) as r from edges where supplier_id in (select supplier_id from hub)) where r <= {CAPS.buyers_per_hub}
        union select buyer, supplier_id from marked where anchor) join marked using (buyer, supplier_id)
      order by anchor desc, value desc, buyer, supplier_id limit {CAPS.edges}),
    all_nodes as (select {_E} as id, max(buyer_total) as value, bool_or(anchor) as safe from kept group by 1
      union all select {_P}, max(supplier_total), bool_or(anchor) from kept group by 1),
    ok_nodes as (select id from (select *, row_number() over (order by safe desc, value desc, id) as r, count(*) filter (where safe) over () as ns from all_nodes)
      where r <= greatest({CAPS.nodes}, ns)),
    sample as (select {_E} as source, {_P} as target, cast(value as double) as value, n_processes, greatest(cast(value as double) / 1e9, 0.05::double) as weight,
        round(100 * cast(value as double) / cast(supplier_total as double), 1) as dependence_pct,
        round(100 * cast(value as double) / cast(buyer_total as double), 1) as buyer_share_pct, segment, department, anchor
      from kept where {_E} in (select id from ok_nodes) and {_P} in (select id from ok_nodes)),
    sample_nodes as (select id, count(*) as degree from (select source as id from sample union all select target from sample) group by 1)""",
)


def net_lines(spark: SparkSession, d: str, columns: Sequence[str] = nw.EDGE_COLUMNS) -> DataFrame:
    """Award lines as the network reads them: ids with leading zeros, some flags missing."""
    modes = [a for a in nw.MODES if a in columns]
    lines = inp.awards(spark, d, "buyer_name", "supplier_id", "supplier_name", "awarded", "line_no", "value", "process_id", *modes)
    text = F.when(F.col("awarded"), "Si").when(F.col("line_no") != 3, "No")
    return lines.select(
        F.col("buyer_name").alias("buyer"),
        F.concat(F.lit("00"), F.col("supplier_id"), F.when(F.col("line_no") % 2 == 0, ".0").otherwise("")).alias("_raw"),
        "supplier_name", "value", "process_id", *modes,
        cl.flag_lenient(text).alias("keep"),
    ).withColumn("tax_id", F.regexp_replace("_raw", r"^00(\d+)\.0$", "$1.0")).drop("_raw")


def edges(spark: SparkSession, d: str, columns: Sequence[str] = nw.EDGE_COLUMNS) -> DataFrame:
    return nw.build_edges(net_lines(spark, d, columns), columns)


@query(
    "network_edges",
    with_views("edges", "select buyer, supplier_id, supplier_name, cast(value as double) as value, n_processes, segment, department from edges"),
)
def network_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).withColumn("value", F.col("value").cast("double"))


@query("edge_mode_attrs", with_views("edges", "select buyer, supplier_id, segment, department from edges"))
def edge_mode_attrs(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("buyer", "supplier_id", "segment", "department")


@query(
    "network_nodes",
    with_views(
        "edges",
        """select 'entidad' as kind, buyer as node, cast(sum(value) as double) as value, count(*) as degree from edges group by 2
        union all select 'proveedor', supplier_id, cast(sum(value) as double), count(*) from edges group by 2""",
    ),
)
def network_nodes(spark: SparkSession, d: str) -> DataFrame:
    t = nw.node_totals(edges(spark, d, ["supplier_name"]))
    return t.select("kind", "node", F.col("value").cast("double").alias("value"), "degree")


def edge_table(spark: SparkSession, d: str, columns: Sequence[str] = ("supplier_name", "n_processes")) -> DataFrame:
    """The edges, written once to the checkpoint folder: composites read them many times, but need segment
    and department of a few edges at most."""
    return cut_lineage(edges(spark, d, columns))


def niches(totals: nw.Totals) -> DataFrame:
    """The most concentrated buyers among those with enough processes."""
    return totals.buyers.where(F.col("_n") >= NICHE_PROCESSES).orderBy(F.desc("_h"), "buyer").limit(CAPS.niches)


def sample(spark: SparkSession, d: str, lines: DataFrame | None = None) -> tuple[nw.Totals, DataFrame]:
    """Totals of the whole network's nodes and links of the sample, with segment and department if ``lines`` are given."""
    e = edge_table(spark, d)
    totals = nw.end_totals(e)
    return totals, cut_lineage(nw.sample_links(e, SUPPLIER, BUYER, niches(totals), CAPS, lines, totals))


@query("network_sample", with_views("sample", "select * from sample"))
def network_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample(spark, d, net_lines(spark, d))[1]


@query(
    "network_hubs",
    with_views(
        "sample",
        f"""select id, degree, cast(value as double) as value, row_number() over (order by degree desc, value desc, id) as palace from sample_nodes
        join (select {_E} as id, sum(value) as value from edges group by 1) using (id) where id like 'e:%' order by palace limit 12""",
    ),
)
def network_hubs(spark: SparkSession, d: str) -> DataFrame:
    totals, links = sample(spark, d)
    return nw.hubs(nw.sample_nodes(links, nw.named_totals(totals))).select("id", "degree", "value", "palace")


@query(
    "largest_component",
    with_views(
        "sample",
        """, arcs as (select source as a, target as b from sample union select target, source from sample),
        reach as (select * from (with recursive r(a, b) as (select a, b from arcs union select r.a, arcs.b from r join arcs on r.b = arcs.a) select * from r)),
        comp as (select a as id, least(a, min(b)) as component from reach group by a)
        select id, component from comp where component = (select component from comp group by 1 order by count(*) desc, component limit 1)""",
    ),
)
def largest_component(spark: SparkSession, d: str) -> DataFrame:
    return nw.largest_component(sample(spark, d)[1])


@query(
    "network_components",
    with_views(
        "edges",
        f""", arcs as (select {_E} as a, {_P} as b from edges), near as (select distinct x.b as a, y.b as b from arcs x join arcs y using (a)),
        reach(a, b) as (select a, b from near union select r.a, n.b from reach r join near n on n.a = r.b),
        parts as (select a, min(b) as p from reach group by 1),
        ids as (select b as id, p from arcs join parts on parts.a = arcs.b union select arcs.a, p from arcs join parts on parts.a = arcs.b),
        least as (select p, min(id) as component from ids group by 1)
        select id, component from ids join least using (p)""",
    ).replace("with ", "with recursive ", 1),
)
def network_components(spark: SparkSession, d: str) -> DataFrame:
    """The component of every node of the whole network."""
    # the distinct pairs are found there
    ids = nw.edge_lines(net_lines(spark, d, ())).select(node_slug("e", F.col("buyer")).alias("source"), node_slug("p", F.col("supplier_id")).alias("target"))
    return nw.components(ids)


@query(
    "neighborhood",
    with_views(
        "sample",
        """, picked as (select id from sample_nodes where id like 'e:%' and id like '%7%'),
        near as (select id from picked union select target from sample where source in (select id from picked)
                 union select source from sample where target in (select id from picked))
        select source, target, value from sample where source in (select id from near) and target in (select id from near)""",
    ),
)
def neighborhood(spark: SparkSession, d: str) -> DataFrame:
    totals, links = sample(spark, d)
    nodes = nw.sample_nodes(links, nw.named_totals(totals))
    return nw.neighbourhood(links, nodes, "entidad", "7").select("source", "target", "value")


# --- ego ------------------------------------------------------------------

inp.add_view(
    "ego",
    "edges",
    f"""mine as (select * from edges where regexp_matches(supplier_name, '{SUPPLIER}')),
    ego_b as (select buyer, cast(m.value as double) as value, m.n_processes,
        round(100 * cast(m.value as double) / (select cast(sum(value) as double) from mine), 1) as income_pct,
        round(100 * cast(m.value as double) / cast(t as double), 2) as wallet_pct, cast(t as double) as buyer_total, segment, department
      from mine m join (select buyer, sum(value) as t from edges group by 1) using (buyer)),
    ego_r as (select e.supplier_id, min(e.supplier_name) as supplier_name, count(*) as n_shared, array_to_string((list(e.buyer order by e.buyer))[1:5], ';') as examples,
        cast(sum(e.value) as double) as rival_value, cast(sum(m.value) as double) as anchor_value,
        round(cast(sum(e.value) as double) / cast(sum(m.value) as double), 2) as ratio, cast(any_value(t) as double) as total_value,
        regexp_matches(min(e.supplier_name), '{inp.PEER}') as is_peer
      from edges e join mine m on e.buyer = m.buyer join (select supplier_id, sum(value) as t from edges group by 1) s on s.supplier_id = e.supplier_id
      where not regexp_matches(e.supplier_name, '{SUPPLIER}') group by 1 order by n_shared desc, rival_value desc, 1 limit 25),
    ego_p as (select supplier_id, min(supplier_name) as supplier_name, cast(sum(value) as double) as value, count(*) as n_buyers,
        round(100 * cast(sum(value) as double) / (select cast(sum(value) as double) from mine), 1) as vs_anchor_pct
      from edges where regexp_matches(supplier_name, '{inp.PEER}') and not regexp_matches(supplier_name, '{SUPPLIER}') group by 1
      order by sum(value) desc, supplier_id limit 20)""",
)


def _peer() -> Column:
    return F.col("supplier_name").rlike(inp.PEER)


@query("ego_buyers", with_views("ego", "select * from ego_b"))
def ego_buyers(spark: SparkSession, d: str) -> DataFrame:
    return nw.ego_buyers(edge_table(spark, d), SUPPLIER, net_lines(spark, d))


@query("ego_rivals", with_views("ego", "select * from ego_r"))
def ego_rivals(spark: SparkSession, d: str) -> DataFrame:
    return nw.ego_rivals(edge_table(spark, d, ["supplier_name"]), SUPPLIER, _peer())


@query("ego_peers", with_views("ego", "select * from ego_p"))
def ego_peers(spark: SparkSession, d: str) -> DataFrame:
    return nw.ego_peers(edge_table(spark, d, ["supplier_name"]), SUPPLIER, _peer())


@query(
    "ego_profile",
    with_views(
        "ego",
        f"""select (select supplier_id from mine limit 1) as supplier_id, cast(sum(value) as double) as value, count(*) as n_buyers, sum(n_processes)::bigint as n_processes,
          (select count(distinct supplier_id) from edges where buyer in (select buyer from mine) and not regexp_matches(supplier_name, '{SUPPLIER}')) as n_rivals,
          1 + (select count(*) from (select supplier_id, sum(value) as v from edges where regexp_matches(supplier_name, '{inp.PEER}') group by 1) where v > (select sum(value) from mine)) as peer_rank
        from mine""",
    ),
)
def ego_profile(spark: SparkSession, d: str) -> DataFrame:
    e = edge_table(spark, d)
    mine = cut_lineage(e.where(nw.is_anchor_supplier(SUPPLIER)))
    income = mine.agg(F.sum("value")).scalar()
    rivals = (
        e.join(mine.select("buyer"), "buyer", "left_semi").where(~nw.is_anchor_supplier(SUPPLIER)).agg(F.countDistinct("supplier_id")).scalar()
    )
    higher = (
        e.where(_peer() & ~nw.is_anchor_supplier(SUPPLIER)).groupBy("supplier_id").agg(F.sum("value").alias("v"))
        .where(F.col("v") > income).agg(F.count(F.lit(1))).scalar()
    )
    return mine.agg(
        F.min("supplier_id").alias("supplier_id"),
        F.sum("value").cast("double").alias("value"),
        F.count(F.lit(1)).alias("n_buyers"),
        F.sum("n_processes").alias("n_processes"),
    ).withColumns({"n_rivals": rivals, "peer_rank": 1 + higher})


@query(
    "ego_graph",
    with_views(
        "ego",
        f""", top18 as (select supplier_id from ego_r order by n_shared desc, rival_value desc, supplier_id limit 18),
        near as (select * from (select *, row_number() over (partition by buyer order by value desc, supplier_id) as r from edges
          where buyer in (select buyer from mine) and supplier_id in (select supplier_id from top18)) where r <= 3)
        select {_E} as source, {_P} as target, min(role) as role, cast(max(value) as double) as value from (
          select buyer, supplier_id, value, 'anchor' as role from mine union all select buyer, supplier_id, value, 'rival' from near) group by 1, 2""",
    ),
)
def ego_graph(spark: SparkSession, d: str) -> DataFrame:
    e = edge_table(spark, d, ["supplier_name"])
    return nw.ego_graph(e, SUPPLIER, nw.ego_rivals(e, SUPPLIER, _peer(), k=18))


@query(
    "ego_wallet_top",
    with_views(
        "ego",
        """select 'wallet' as list, buyer as name, wallet_pct as value from (select * from ego_b where wallet_pct > 0 order by wallet_pct desc, buyer limit 10)
        union all select 'rival', supplier_id, least(ratio, 12) from (select * from ego_r order by n_shared desc, rival_value desc, supplier_id limit 14)
        union all select 'peer', supplier_id, value from (select supplier_id, value from (select supplier_id, value from ego_p order by value desc, supplier_id limit 9)
          union all select max(supplier_id), cast(sum(value) as double) from mine order by value desc, supplier_id limit 10)""",
    ),
)
def ego_wallet_top(spark: SparkSession, d: str) -> DataFrame:
    e = edge_table(spark, d)
    wallet = nw.ego_buyers(e, SUPPLIER).where("wallet_pct > 0").orderBy(F.desc("wallet_pct"), "buyer").limit(10)
    rivals = nw.ego_rivals(e, SUPPLIER, _peer(), k=14)
    own = e.where(nw.is_anchor_supplier(SUPPLIER)).agg(
        F.max("supplier_id").alias("supplier_id"), F.sum("value").cast("double").alias("value")
    )
    peers = (
        nw.ego_peers(e, SUPPLIER, _peer(), k=9).select("supplier_id", "value").unionByName(own).orderBy(F.desc("value"), "supplier_id").limit(10)
    )
    return (
        wallet.select(F.lit("wallet").alias("list"), F.col("buyer").alias("name"), F.col("wallet_pct").alias("value"))
        .unionByName(rivals.select(F.lit("rival").alias("list"), F.col("supplier_id").alias("name"), F.least("ratio", F.lit(12.0)).alias("value")))
        .unionByName(peers.select(F.lit("peer").alias("list"), F.col("supplier_id").alias("name"), "value"))
    )
