"""Buyer-supplier network: edges, navigable sample, ego view, components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderscope.functions.measures import hhi
from tenderscope.functions.text import node_slug, short_label
from tenderscope.operators.cleaning import BLANK_TOKENS, norm_tax_id
from tenderscope.operators.ranks import mode_per, top_n_per
from tenderscope.session import cut_lineage


@dataclass(frozen=True)
class SampleCaps:
    """Size of the navigable sample (a display feature, not a data limit)."""

    seed_buyers: int = 55
    suppliers_per_buyer: int = 10
    hub_suppliers: int = 40
    buyers_per_hub: int = 5
    niches: int = 15
    nodes: int = 480
    edges: int = 720


def _real_text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*BLANK_TOKENS), t)


#: What an edge can tell besides its ends and its value.
EDGE_COLUMNS = ("supplier_name", "n_processes", "segment", "department")
MODES = ("segment", "department")


def edge_lines(lines: DataFrame) -> DataFrame:
    """Lines that make an edge, with ``buyer, supplier_id`` as the network names them.

    ``lines``: ``buyer, tax_id, supplier_name, keep, value, process_id`` and what more an edge is to tell.
    ``keep`` is the lenient award flag; no plausibility rule applies here.
    Suppliers are keyed by normalised tax id, else by name.
    """
    name = _real_text(F.col("supplier_name"))
    # the first that is not blank; a list evaluates both once
    key = F.get(F.filter(F.array(norm_tax_id(F.col("tax_id").cast("string")), name), lambda k: k != ""), 0)
    return lines.where(F.col("keep") & (F.coalesce(F.col("value"), F.lit(0)) > 0)).select(
        _real_text(F.col("buyer")).alias("buyer"),
        key.alias("supplier_id"),
        name.alias("supplier_name"),
        "value",
        "process_id",
        *[_real_text(F.col(a)).alias(a) for a in MODES if a in lines.columns],
    ).where(F.col("buyer").isNotNull() & F.col("supplier_id").isNotNull())


def build_edges(lines: DataFrame, columns: Sequence[str] = EDGE_COLUMNS) -> DataFrame:
    """One row per (buyer, supplier) from ``edge_lines``: its value and, of ``EDGE_COLUMNS``, those in ``columns``.

    What is not asked for is neither shuffled nor counted; ``with_modes`` tells segment and
    department of a few edges afterwards.
    """
    base, pair = edge_lines(lines), ["buyer", "supplier_id"]
    modes = [a for a in MODES if a in columns]
    if not modes:
        per, n = base, F.lit(None)
        if "n_processes" in columns:
            per = base.groupBy(*pair, "process_id").agg(F.sum("value").alias("value"), F.min("supplier_name").alias("supplier_name"))
            n = F.count("process_id")
        out = {"supplier_name": F.coalesce(F.min("supplier_name"), F.min("supplier_id")), "n_processes": n}
        return per.groupBy(*pair).agg(F.sum("value").alias("value"), *[out[c].alias(c) for c in columns])
    # first the counts of each value within a pair, for all attributes in one pass and combined
    # before the shuffle, however hot the pair; then one row for each pair
    attributes = ["process_id", *modes, "supplier_name"]
    counted = base.groupingSets([[*pair, a] for a in attributes], *pair, *attributes).agg(
        F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"), F.grouping_id(*pair, *attributes).alias("g")
    )
    last = len(attributes) - 1
    of = {a: F.col("g") == (2 << last) - 1 - (1 << (last - i)) for i, a in enumerate(attributes)}  # bit 1: not in the set

    def mode(a: str) -> Column:  # equal counts go to the smallest value
        return F.min(F.when(of[a] & F.col(a).isNotNull(), F.struct(-F.col("n"), F.col(a).alias("v")))).getField("v")

    out = {
        "supplier_name": F.coalesce(F.min(F.when(of["supplier_name"], F.col("supplier_name"))), F.min("supplier_id")),
        "n_processes": F.count(F.when(of["process_id"], F.col("process_id"))),
        **{a: mode(a) for a in modes},
    }
    return counted.groupBy(*pair).agg(F.sum(F.when(of["process_id"], F.col("value"))).alias("value"), *[out[c].alias(c) for c in columns])


def with_modes(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """A part of the edges with the most frequent segment and department of each, counted over its own lines only."""
    pair = ["buyer", "supplier_id"]
    # by buyer first, which needs nothing but the buyers' table
    own = edge_lines(lines).join(edges.select("buyer").distinct(), "buyer", "left_semi").join(edges.select(*pair), pair, "left_semi")
    own = cut_lineage(own.select(*pair, *MODES))
    for a in MODES:
        edges = edges.join(mode_per(own, pair, a, a), pair, "left")
    return edges


@dataclass(frozen=True)
class Totals:
    """What both sides' nodes add up to, a row each; composites read these instead of all edges."""

    buyers: DataFrame  # buyer, buyer_total, degree, _h, _n
    suppliers: DataFrame  # supplier_id, supplier_total, degree, supplier_name


def end_totals(edges: DataFrame) -> Totals:
    """Totals of both ends over the whole network, each side grouped once and written; ``_h`` and ``_n``: concentration and processes."""
    b = edges.groupBy("buyer").agg(
        F.sum("value").alias("buyer_total"), F.count(F.lit(1)).alias("degree"), F.round(hhi(F.col("value")), 6).alias("_h"), F.sum("n_processes").alias("_n")
    )
    s = edges.groupBy("supplier_id").agg(
        F.sum("value").alias("supplier_total"), F.count(F.lit(1)).alias("degree"), F.min("supplier_name").alias("supplier_name")
    )
    return Totals(cut_lineage(b), cut_lineage(s))


def named_totals(totals: Totals) -> DataFrame:
    """``node_totals`` from what is added up already."""
    b = totals.buyers.select(F.col("buyer").alias("node"), F.lit("entidad").alias("kind"), F.col("buyer").alias("name"), F.col("buyer_total").alias("value"), "degree")
    s = totals.suppliers.select(F.col("supplier_id").alias("node"), F.lit("proveedor").alias("kind"), F.col("supplier_name").alias("name"), F.col("supplier_total").alias("value"), "degree")
    return b.unionByName(s)


def node_totals(edges: DataFrame) -> DataFrame:
    """Value and degree of every node, both sides."""
    buyers = edges.groupBy(F.col("buyer").alias("node")).agg(
        F.lit("entidad").alias("kind"), F.first("buyer").alias("name"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("degree")
    )
    suppliers = edges.groupBy(F.col("supplier_id").alias("node")).agg(
        F.lit("proveedor").alias("kind"), F.min("supplier_name").alias("name"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("degree")
    )
    return buyers.unionByName(suppliers)


def is_anchor_supplier(pattern: str) -> Column:
    return F.col("supplier_name").rlike(pattern) | F.col("supplier_id").rlike(pattern)


def is_anchor_buyer(pattern: str | None) -> Column:
    return F.col("buyer").rlike(pattern) if pattern else F.lit(False)


def _with_totals(edges: DataFrame, totals: Totals) -> DataFrame:
    """Totals of both ends over the whole network, for a few edges."""
    return edges.join(totals.buyers.select("buyer", "buyer_total"), "buyer").join(totals.suppliers.select("supplier_id", "supplier_total"), "supplier_id")


def link_attributes(edges: DataFrame) -> DataFrame:
    """Ids, drawing weight and the two percentages of each link."""
    v = F.col("value").cast("double")
    return edges.select(
        node_slug("e", F.col("buyer")).alias("source"),
        node_slug("p", F.col("supplier_id")).alias("target"),
        v.alias("value"),
        "n_processes",
        F.greatest(v / 1e9, F.lit(0.05)).alias("weight"),
        F.round(100 * v / F.col("supplier_total").cast("double"), 1).alias("dependence_pct"),
        F.round(100 * v / F.col("buyer_total").cast("double"), 1).alias("buyer_share_pct"),
        *[a for a in MODES if a in edges.columns],
        "anchor",
    )


def sample_links(
    edges: DataFrame,
    anchor_supplier: str,
    anchor_buyer: str | None = None,
    niches: DataFrame | None = None,
    caps: SampleCaps = SampleCaps(),
    lines: DataFrame | None = None,
    totals: Totals | None = None,
) -> DataFrame:
    """The navigable sample: large buyers, anchors and niches with their top suppliers,
    hub suppliers with their top buyers, and every anchor edge, within the caps.

    ``lines``: where the edges do not tell segment and department, those of the links come from here.
    ``totals``: ``end_totals`` of the edges, where they are known already.
    """
    totals = totals or end_totals(edges)
    marked = edges.withColumn("anchor", is_anchor_supplier(anchor_supplier) | is_anchor_buyer(anchor_buyer))
    seeds = totals.buyers.orderBy(F.desc("buyer_total"), "buyer").limit(caps.seed_buyers).select("buyer")
    seeds = seeds.unionByName(totals.buyers.where(is_anchor_buyer(anchor_buyer)).select("buyer"))
    if niches is not None:
        seeds = seeds.unionByName(niches.limit(caps.niches).select("buyer"))
    # written, so that the planner knows how few they are and leaves the edges where they are
    seeds = cut_lineage(seeds.distinct())
    hubs = cut_lineage(totals.suppliers.orderBy(F.desc("supplier_total"), "supplier_id").limit(caps.hub_suppliers).select("supplier_id"))
    from_seeds = top_n_per(
        marked.join(seeds, "buyer", "left_semi"), ["buyer"], [F.desc("value"), F.asc("supplier_id")], caps.suppliers_per_buyer
    ).drop("rank")
    from_hubs = top_n_per(
        marked.join(hubs, "supplier_id", "left_semi"), ["supplier_id"], [F.desc("value"), F.asc("buyer")], caps.buyers_per_hub
    ).drop("rank")
    kept = (
        from_seeds.unionByName(from_hubs)
        .unionByName(marked.where("anchor"))
        .dropDuplicates(["buyer", "supplier_id"])
        .orderBy(F.desc("anchor"), F.desc("value"), "buyer", "supplier_id")
        .limit(caps.edges)
    )
    kept = cut_lineage(kept)  # at most caps.edges rows, read four times below
    told = cut_lineage(with_modes(kept, lines)) if lines is not None else kept
    links = link_attributes(_with_totals(told, totals))
    nodes = _capped_nodes(kept, totals, anchor_supplier, anchor_buyer, caps.nodes)
    ends = nodes.select("id")
    return links.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ends.withColumnRenamed("id", "target"), "target", "left_semi"
    )


def _capped_nodes(kept: DataFrame, totals: Totals, anchor_supplier: str, anchor_buyer: str | None, cap: int) -> DataFrame:
    """Anchors and their neighbours always; then the most valuable nodes up to the cap."""
    t = _with_totals(kept, totals)
    anchored = F.col("anchor")
    e = t.groupBy(node_slug("e", F.col("buyer")).alias("id")).agg(F.max("buyer_total").alias("value"), F.bool_or(anchored).alias("safe"))
    p = t.groupBy(node_slug("p", F.col("supplier_id")).alias("id")).agg(F.max("supplier_total").alias("value"), F.bool_or(anchored).alias("safe"))
    nodes = e.unionByName(p)
    order = Window.orderBy(F.desc("safe"), F.desc("value"), "id")  # at most two nodes per kept edge
    n_safe = nodes.agg(F.count_if("safe")).scalar()
    return nodes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.greatest(F.lit(cap), n_safe))


def sample_nodes(links: DataFrame, totals: DataFrame) -> DataFrame:
    """Nodes that still have a link, with their degree in the sample."""
    ends = links.select(F.col("source").alias("id"), "anchor").unionByName(links.select(F.col("target").alias("id"), "anchor"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    prefix = F.when(F.col("kind") == "entidad", node_slug("e", F.col("node"))).otherwise(node_slug("p", F.col("node")))
    named = totals.select(prefix.alias("id"), "kind", "name", F.col("value").cast("double").alias("value"))
    return degree.join(named, "id").withColumn("label", short_label(F.col("name"), 40))


def hubs(nodes: DataFrame, k: int = 12) -> DataFrame:
    top = nodes.where(F.col("kind") == "entidad").orderBy(F.desc("degree"), F.desc("value"), "id").limit(k)
    w = Window.orderBy(F.desc("degree"), F.desc("value"), "id")  # k rows
    return top.withColumn("palace", F.row_number().over(w))


def components(links: DataFrame) -> DataFrame:
    """``id, component``: smallest reachable id of every node of ``source, target``.

    Large-star and small-star steps in turn: each node hands its larger, then its
    smaller neighbours to the least one it knows. Rounds grow with the logarithm of
    the number of nodes even on a path; edges never grow in number beyond nodes and
    edges of the start, and the groups are only ever reduced to a minimum, so a hub
    is combined before the shuffle and its join can be split.
    """
    links = cut_lineage(links.select("source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull()).distinct())
    hi, lo = F.greatest("source", "target"), F.least("source", "target")
    edges = links.where(F.col("source") != F.col("target")).select(hi.alias("hi"), lo.alias("lo"))
    mark = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        large = cut_lineage(large)
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut_lineage(small.unionByName(root.select("hi", F.col("m").alias("lo"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if now == mark:
            break
        mark = now
    nodes = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id"))).distinct()
    return nodes.join(edges.withColumnRenamed("hi", "id"), "id", "left").select("id", F.coalesce("lo", "id").alias("component"))


def largest_component(links: DataFrame) -> DataFrame:
    comp = components(links)
    best = (
        comp.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "component").limit(1)
    )
    return comp.join(F.broadcast(best.select("component")), "component", "left_semi")


def neighbourhood(links: DataFrame, nodes: DataFrame, kind: str | None = None, text: str = "") -> DataFrame:
    """Links induced by the matching nodes and their direct neighbours."""
    seeds = nodes
    if kind:
        seeds = seeds.where(F.col("kind") == kind)
    if text:
        t = text.lower()
        seeds = seeds.where(F.lower("name").contains(t) | F.lower("label").contains(t) | F.lower("id").contains(t))
    ids = seeds.select("id")
    if kind or text:
        out = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
        inn = links.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
        ids = ids.unionByName(out).unionByName(inn).distinct()
    return links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )


# --- ego view -------------------------------------------------------------


def _anchored(edges: DataFrame, anchor: str) -> DataFrame:
    """The anchor's edges, written: the planner then knows their size and leaves all the others where they are."""
    return cut_lineage(edges.where(is_anchor_supplier(anchor)))


def ego_buyers(edges: DataFrame, anchor: str, lines: DataFrame | None = None) -> DataFrame:
    """The anchor's buyers: part of its income and of the buyer's spending.

    ``lines``: where the edges do not tell segment and department, those of the anchor's come from here.
    """
    mine = _anchored(edges, anchor)
    if lines is not None:
        mine = cut_lineage(with_modes(mine, lines))
    told = [a for a in MODES if a in mine.columns]
    income = mine.agg(F.sum("value")).scalar().cast("double")
    per = mine.groupBy("buyer").agg(
        F.sum("value").alias("value"),
        F.sum("n_processes").alias("n_processes"),
        *[F.min(a).alias(a) for a in told],
    )
    spent = edges.join(per.select("buyer"), "buyer", "left_semi").groupBy("buyer").agg(F.sum("value").alias("buyer_total"))
    v = F.col("value").cast("double")
    return per.join(spent, "buyer").select(
        "buyer",
        v.alias("value"),
        "n_processes",
        F.round(100 * v / income, 1).alias("income_pct"),
        F.round(100 * v / F.col("buyer_total").cast("double"), 2).alias("wallet_pct"),
        F.col("buyer_total").cast("double").alias("buyer_total"),
        *told,
    )


def ego_rivals(edges: DataFrame, anchor: str, peer: Column, k: int = 25, examples: int = 5) -> DataFrame:
    """Suppliers that win at the anchor's buyers, by buyers in common."""
    mine = _anchored(edges, anchor).groupBy("buyer").agg(F.sum("value").alias("_anchor"))
    shared = edges.where(~is_anchor_supplier(anchor)).join(mine, "buyer")
    stats = shared.groupBy("supplier_id").agg(
        F.min("supplier_name").alias("supplier_name"),
        F.count(F.lit(1)).alias("n_shared"),
        F.sum("value").alias("_rival"),
        F.sum("_anchor").alias("_mine"),
    )
    top = stats.orderBy(F.desc("n_shared"), F.desc("_rival"), "supplier_id").limit(k)
    # k rows from here on
    some = top_n_per(shared.join(F.broadcast(top.select("supplier_id")), "supplier_id", "left_semi"), ["supplier_id"], [F.asc("buyer")], examples)
    listed = some.groupBy("supplier_id").agg(F.array_join(F.sort_array(F.collect_list("buyer")), ";").alias("examples"))
    total = (
        edges.join(F.broadcast(top.select("supplier_id")), "supplier_id", "left_semi").groupBy("supplier_id").agg(F.sum("value").alias("_total"))
    )
    rival, own = F.col("_rival").cast("double"), F.col("_mine").cast("double")
    return top.join(listed, "supplier_id").join(total, "supplier_id").select(
        "supplier_id",
        "supplier_name",
        "n_shared",
        "examples",
        rival.alias("rival_value"),
        own.alias("anchor_value"),
        F.round(F.try_divide(rival, own), 2).alias("ratio"),
        F.col("_total").cast("double").alias("total_value"),
        peer.alias("is_peer"),
    )


def ego_peers(edges: DataFrame, anchor: str, peer: Column, k: int = 20) -> DataFrame:
    """Suppliers of the anchor's class by value, against the anchor."""
    income = edges.where(is_anchor_supplier(anchor)).agg(F.sum("value")).scalar().cast("double")
    per = edges.where(~is_anchor_supplier(anchor)).groupBy("supplier_id").agg(
        F.min("supplier_name").alias("supplier_name"), F.sum("value").alias("_v"), F.count(F.lit(1)).alias("n_buyers")
    )
    top = per.where(peer).orderBy(F.desc("_v"), "supplier_id").limit(k)
    v = F.col("_v").cast("double")
    return top.select("supplier_id", "supplier_name", v.alias("value"), "n_buyers", F.round(100 * v / income, 1).alias("vs_anchor_pct"))


def ego_graph(edges: DataFrame, anchor: str, rivals: DataFrame, per_buyer: int = 3) -> DataFrame:
    """All anchor edges and the strongest edges of the top rivals at the same buyers."""
    mine = _anchored(edges, anchor)
    near = edges.join(mine.select("buyer"), "buyer", "left_semi").join(
        F.broadcast(rivals.select("supplier_id")), "supplier_id", "left_semi"
    )
    top = top_n_per(near, ["buyer"], [F.desc("value"), F.asc("supplier_id")], per_buyer).drop("rank")
    every = mine.withColumn("role", F.lit("anchor")).unionByName(top.withColumn("role", F.lit("rival")))
    uniq = every.groupBy("buyer", "supplier_id").agg(F.min("role").alias("role"), F.max("value").cast("double").alias("value"))
    return uniq.select(
        node_slug("e", F.col("buyer")).alias("source"), node_slug("p", F.col("supplier_id")).alias("target"), "role", "value"
    )
