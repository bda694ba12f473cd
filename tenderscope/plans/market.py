"""Aggregations, shares, rankings and market composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tenderscope.functions.dates import SHORT, month_label
from tenderscope.functions.text import IES_WORDS, is_university
from tenderscope.operators import market as mk, tables as tb
from tenderscope.operators.cleaning import awarded_lines
from tenderscope.operators.ranks import running_totals, top_n_per
from tenderscope.plans import inputs as inp
from tenderscope.plans.cleaning import mega_processes
from tenderscope.plans.inputs import table, with_views
from tenderscope.plans.registry import query
from tenderscope.session import cut_lineage

LABEL_SQL = "([" + ", ".join(f"'{m}'" for m in SHORT) + "])[month(month)] || ' ' || year(month)"

inp.add_view(
    "monthly",
    "mega",
    """monthly as (
      select cast(date_trunc('month', published_at) as date) as month, count(*) as n_processes,
        coalesce(sum(value_real), 0) as value_total, coalesce(sum(value_real) filter (where not is_mega), 0) as value_no_mega
      from mega where not implausible group by 1)""",
)
inp.add_view(
    "suppliers",
    "market",
    """suppliers as (select supplier_id, supplier_name, sum(value) as value from market group by 1, 2)""",
)
inp.add_view(
    "relations",
    "market",
    """pairs as (select buyer, supplier_id, min(supplier_name) as supplier_name, count(distinct process_id) as n_processes,
        sum(value) as value from market group by 1, 2),
    relations as (select *,
        round(cast(value as double) / cast(sum(value) over (partition by buyer) as double) * 100.0, 6) as buyer_share_pct,
        round(cast(value as double) / cast(sum(value) over (partition by supplier_id) as double) * 100.0, 6) as dependence_pct
      from pairs)""",
)


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Process count and constant-price value per month, with and without mega contracts."""
    p = mega_processes(spark, d, "process_id").where(~F.col("implausible"))
    return p.groupBy(F.trunc("published_at", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n_processes"),
        F.coalesce(F.sum("value_real"), F.lit(0)).alias("value_total"),
        F.coalesce(F.sum(F.when(~F.col("is_mega"), F.col("value_real"))), F.lit(0)).alias("value_no_mega"),
    )


@query(
    "monthly_series",
    with_views(
        "monthly",
        f"""select month, {LABEL_SQL} as label, n_processes, cast(value_total as double) as value_total,
          cast(value_no_mega as double) as value_no_mega from monthly""",
    ),
)
def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    return monthly(spark, d).select(
        "month",
        month_label(F.col("month")).alias("label"),
        "n_processes",
        F.col("value_total").cast("double").alias("value_total"),
        F.col("value_no_mega").cast("double").alias("value_no_mega"),
    )


@query(
    "monthly_with_without",
    with_views(
        "monthly",
        """select month, cast(value_total as double) as value_total, cast(value_no_mega as double) as value_no_mega,
          round(1 - cast(value_no_mega as double) / nullif(cast(value_total as double), 0), 6) as mega_share from monthly""",
    ),
)
def monthly_with_without(spark: SparkSession, d: str) -> DataFrame:
    m = monthly(spark, d)
    total, rest = F.col("value_total").cast("double"), F.col("value_no_mega").cast("double")
    return m.select(
        "month",
        total.alias("value_total"),
        rest.alias("value_no_mega"),
        F.round(1 - F.try_divide(rest, total), 6).alias("mega_share"),
    )


@query(
    "calendar_profile",
    with_views(
        "monthly",
        """, prof as (select month(month) as calendar_month, avg(n_processes) as avg_n,
          cast(sum(value_total) as double) / count(*) as avg_value from monthly group by 1)
        select calendar_month, round(avg_n, 6) as avg_n, round(avg_value, 2) as avg_value,
          calendar_month = (select calendar_month from prof order by avg_n desc, calendar_month limit 1) as is_peak from prof""",
    ),
)
def calendar_profile(spark: SparkSession, d: str) -> DataFrame:
    prof = (
        monthly(spark, d)
        .groupBy(F.month("month").cast("long").alias("calendar_month"))
        .agg(
            F.avg("n_processes").alias("avg_n"),
            (F.sum("value_total").cast("double") / F.count(F.lit(1))).alias("avg_value"),
        )
    )
    w = Window.orderBy(F.desc("avg_n"), "calendar_month")  # twelve rows
    return prof.select(
        "calendar_month",
        F.round("avg_n", 6).alias("avg_n"),
        F.round("avg_value", 2).alias("avg_value"),
        (F.row_number().over(w) == 1).alias("is_peak"),
    )


@query(
    "frequency_table",
    """select state, n, round(n * 100.0 / sum(n) over (), 6) as pct from (
      select case when o_orderstatus = 'O' then null else o_orderstatus end as state, count(*) as n from orders group by 1)""",
)
def frequency_table(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("state"))
    return tb.frequency_table(o, "state")


@query(
    "market_table",
    with_views(
        "suppliers",
        """select supplier_id, supplier_name, cast(value as double) as value,
          round(cast(value as double) / cast(sum(value) over () as double), 6) as share,
          round(cast(sum(value) over (order by value desc, supplier_id rows unbounded preceding) as double)
            / cast(sum(value) over () as double), 6) as cum_share from suppliers""",
    ),
)
def market_table(spark: SparkSession, d: str) -> DataFrame:
    t = mk.market_table(inp.market(spark, d, "supplier_id", "supplier_name", "value"))
    return t.select(
        "supplier_id", "supplier_name", F.col("value").cast("double").alias("value"),
        F.round("share", 6).alias("share"), F.round("cum_share", 6).alias("cum_share"),
    )


@query(
    "hhi_overall",
    with_views(
        "suppliers",
        """select round(sum(s * s) * 10000, 6) as hhi, count(*) as n_suppliers
        from (select cast(value as double) / cast(sum(value) over () as double) as s from suppliers)""",
    ),
)
def hhi_overall(spark: SparkSession, d: str) -> DataFrame:
    totals = mk.supplier_totals(inp.market(spark, d, "supplier_id", "supplier_name", "value"))
    return totals.agg(F.round(mk.hhi(F.col("value")), 6).alias("hhi"), F.count(F.lit(1)).alias("n_suppliers"))


_STAGED_SQL = """
staged as (select 'before' as stage, * from awards where awarded and value > 0
           union all select 'after', * from market),
totals as (select stage, supplier_id, supplier_name, sum(value) as value from staged group by 1, 2, 3),
shares as (select *, cast(value as double) / cast(sum(value) over (partition by stage) as double) as share,
    cast(sum(value) over (partition by stage order by value desc, supplier_id rows unbounded preceding) as double)
      / cast(sum(value) over (partition by stage) as double) as cum from totals)"""
inp.add_view("shares", "market", _STAGED_SQL)


def staged_market(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.awards(spark, d, "supplier_id", "supplier_name", "value", "base_price", "awarded")
    lines = awarded_lines(lines)
    stages = F.when(inp.implausible(), F.array(F.lit("before"))).otherwise(F.array(F.lit("before"), F.lit("after")))
    return lines.select("supplier_id", "supplier_name", "value", F.explode(stages).alias("stage"))


@query(
    "hhi_before_after",
    with_views(
        "shares",
        """select stage, round(sum(share * share) * 10000, 6) as hhi,
          case when sum(share * share) * 10000 < 1500 then 'baja' when sum(share * share) * 10000 < 2500 then 'moderada' else 'alta' end as band,
          count(*) as n_suppliers, count(*) filter (where cum <= 0.80) + 1 as n_80,
          round((count(*) filter (where cum <= 0.80) + 1) / count(*), 6) as pct_80 from shares group by stage""",
    ),
)
def hhi_before_after(spark: SparkSession, d: str) -> DataFrame:
    return mk.concentration(staged_market(spark, d))


@query(
    "pareto_80",
    with_views(
        "shares",
        """select count(*) as n_suppliers, count(*) filter (where cum <= 0.80) + 1 as n_80,
          round((count(*) filter (where cum <= 0.80) + 1) / count(*), 6) as pct_80 from shares where stage = 'after'""",
    ),
)
def pareto_80(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.market(spark, d, "supplier_id", "supplier_name", "value").withColumn("stage", F.lit("after"))
    return mk.concentration(lines).select("n_suppliers", "n_80", "pct_80")


@query(
    "pareto_curve",
    with_views(
        "shares",
        """, ranked as (select row_number() over (order by value desc, supplier_id) as k, cum from shares where stage = 'after'),
        grid as (select i as point, 0.01::double + i * ((1.0::double - 0.01::double) / 39) as p from range(40) t(i))
        select point, round(p * 100, 4) as pct_suppliers, r.k, round(r.cum * 100, 4) as pct_value
        from grid join ranked r on r.k = greatest(1, round_even(p * (select count(*) from ranked), 0)::bigint)""",
    ),
)
def pareto_curve(spark: SparkSession, d: str) -> DataFrame:
    return mk.pareto_curve(inp.market(spark, d, "supplier_id", "supplier_name", "value"))


_BY_BUYER_SQL = f"""
by_buyer as (
  select b.*, n_processes from (
    select buyer, round(sum(share * share) * 10000, 6) as hhi, count(*) as n_suppliers, cast(sum(value) as double) as value from (
      select buyer, supplier_id, value, cast(value as double) / cast(sum(value) over (partition by buyer) as double) as share
      from (select buyer, supplier_id, sum(value) as value from market group by 1, 2)) group by 1) b
  join (select buyer, count(distinct process_id) as n_processes from market group by 1) p using (buyer)
  where n_processes >= {inp.MIN_PROCESSES})"""
inp.add_view("by_buyer", "market", _BY_BUYER_SQL)


def by_buyer(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.market(spark, d, "buyer", "supplier_id", "process_id", "value")
    return mk.hhi_by_buyer(lines, inp.MIN_PROCESSES).withColumn("value", F.col("value").cast("double"))


@query("hhi_by_buyer", with_views("by_buyer", "select * from by_buyer"))
def hhi_by_buyer(spark: SparkSession, d: str) -> DataFrame:
    return by_buyer(spark, d)


@query(
    "concentrated_buyers",
    with_views(
        "by_buyer",
        """select *, 'concentrated' as side from (select * from by_buyer order by hhi desc, buyer limit 8)
        union all select *, 'competitive' from (select * from by_buyer order by hhi, buyer limit 5)""",
    ),
)
def concentrated_buyers(spark: SparkSession, d: str) -> DataFrame:
    return mk.concentrated_and_competitive(by_buyer(spark, d))


@query(
    "coverage_by_state",
    with_views(
        "awards",
        """select state, round(avg(case when line_no <> 3 then 1.0 else 0.0 end), 6) as coverage, count(*) as n
        from awards group by 1""",
    ),
)
def coverage_by_state(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.awards(spark, d, "state", "line_no", "awarded_at")
    at = F.when(F.col("line_no") != 3, F.col("awarded_at"))
    return lines.groupBy("state").agg(
        F.round(F.avg(at.isNotNull().cast("double")), 6).alias("coverage"), F.count(F.lit(1)).alias("n")
    )


@query(
    "null_profile",
    """, c as (select count(*) as t, count(*) filter (where l_linenumber = 3) as a, count(*) filter (where l_suppkey % 7 = 0) as s from lineitem)
    select 'awarded_at' as column_name, a as n_null, round(a * 100.0 / t, 6) as pct_null from c
    union all select 'supplier_id', s, round(s * 100.0 / t, 6) from c union all select 'process_id', 0, 0.0 from c""".replace(", c as", "with c as", 1),
)
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("process_id"),
        F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("supplier_id"),
        F.when(F.col("l_linenumber") != 3, F.col("l_shipdate")).alias("awarded_at"),
    )
    return tb.null_profile(li)


@query(
    "dup_rows",
    """select sum(n)::bigint as n_rows, count(*) as n_distinct, sum(n - 1)::bigint as n_duplicates from (
      select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2)""",
)
def dup_rows(spark: SparkSession, d: str) -> DataFrame:
    return tb.duplicate_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "line_to_process",
    with_views("processes", "select process_id, value, awarded, n_suppliers, lots from processes"),
)
def line_to_process(spark: SparkSession, d: str) -> DataFrame:
    return inp.processes(spark, d, "process_id", "value", "awarded", "n_suppliers", "lots")


@query(
    "award_rate_by_key",
    with_views(
        "processes",
        """select 'method' as kind, method as key, round(avg(awarded::int), 6) as rate, count(*) as n from processes group by 2
        union all select 'segment', segment, round(avg(awarded::int), 6), count(*) from processes group by 2
        union all select 'year', cast(year(published_at) as varchar), round(avg(awarded::int), 6), count(*) from processes group by 2""",
    ),
)
def award_rate_by_key(spark: SparkSession, d: str) -> DataFrame:
    p = inp.processes(spark, d, "process_id", "method", "segment", "published_at", "awarded").withColumn(
        "year", F.year("published_at")
    )
    kinds = [mk.award_rate(p, k).withColumn("kind", F.lit(k)) for k in ("method", "segment", "year")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query(
    "crosstab_year_month",
    "select year(o_orderdate) as year, "
    + ", ".join(f"count(*) filter (where month(o_orderdate) = {m}) as m{m:02d}" for m in range(1, 13))
    + " from orders group by 1",
)
def crosstab_year_month(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        F.year("o_orderdate").cast("long").alias("year"), F.date_format("o_orderdate", "'m'MM").alias("m")
    )
    slots = [f"m{m:02d}" for m in range(1, 13)]
    return o.groupBy("year").pivot("m", slots).count().fillna(0, slots)


@query(
    "degree_distribution",
    with_views(
        "market",
        """select count(*) as n, round(avg(g), 6) as mean, round(stddev_samp(g), 6) as std, min(g) as min, max(g) as max,
          count(*) filter (where g >= 5) as n_diversified, quantile_cont(g::double, 0.25) as q1,
          quantile_cont(g::double, 0.5) as median, quantile_cont(g::double, 0.75) as q3
        from (select buyer_name, count(distinct supplier_id) as g from market group by 1)""",
    ),
)
def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    return mk.degree_distribution(inp.market(spark, d, "buyer_name", "supplier_id"), "buyer_name", "supplier_id")


@query("degree_approx")
def degree_approx(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.market(spark, d, "buyer_name", "supplier_id")
    return lines.groupBy("supplier_id").agg(F.approx_count_distinct("buyer_name", 0.02).alias("degree"))


@query(
    "january_peaks",
    """, daily as (select cast(o_orderdate as date) as day, count(*) as n from orders where month(o_orderdate) = 1 group by 1)
    select cast(date_trunc('month', day) as date) as month, sum(n)::bigint as n, max(n) as peak_n,
      dayofmonth(arg_min(day, (-n, day))) as peak_day, round(max(n) / sum(n), 6) as peak_share from daily group by 1""".replace(", daily", "with daily", 1),
)
def january_peaks(spark: SparkSession, d: str) -> DataFrame:
    return mk.daily_peaks(table(spark, d, "orders").where(F.month("o_orderdate") == 1), "o_orderdate")


@query(
    "availability_profile",
    """, b as (select case when o_orderpriority = '5-LOW' then null else o_orderpriority end as method,
        case o_orderkey % 3 when 0 then null when 1 then 0 else o_custkey end as invited from orders)
    select method, count(*) as n, count(invited) as n_informed, round(avg((invited is not null)::int) * 100, 6) as pct_informed,
      round(avg((coalesce(invited, 0) > 0)::int) * 100, 6) as pct_positive, quantile_cont(invited::double, 0.5) as median
    from b group by 1""".replace(", b", "with b", 1),
)
def availability_profile(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("method"),
        F.when(F.col("o_orderkey") % 3 == 1, 0).when(F.col("o_orderkey") % 3 == 2, F.col("o_custkey")).alias("invited"),
    )
    return mk.availability_profile(o, "method", "invited")


@query(
    "histogram",
    "select floor(p_size / 6)::bigint * 6 as bin_start, count(*) as n from part group by 1",
)
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return tb.histogram(table(spark, d, "part"), "p_size", 6)


@query(
    "financing_presence",
    """select count(*) as n, count(a) as n_term, count(*) filter (where b is not null or c is not null) as n_match from (
      select case when p_size > 10 then p_size end as a, case when p_partkey % 3 = 0 then 1 end as b, case when p_partkey % 5 = 0 then 1 end as c from part)""",
)
def financing_presence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("a"),
        F.when(F.col("p_partkey") % 3 == 0, 1).alias("b"),
        F.when(F.col("p_partkey") % 5 == 0, 1).alias("c"),
    )
    return p.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("a").alias("n_term"),
        F.count_if(F.col("b").isNotNull() | F.col("c").isNotNull()).alias("n_match"),
    )


# --- windows and market composites ----------------------------------------


def relations(spark: SparkSession, d: str) -> DataFrame:
    return mk.relations(inp.market(spark, d, "buyer", "supplier_id", "supplier_name", "process_id", "value"))


@query(
    "buyer_supplier_shares",
    with_views("relations", "select buyer, supplier_id, n_processes, cast(value as double) as value, buyer_share_pct, dependence_pct from relations"),
)
def buyer_supplier_shares(spark: SparkSession, d: str) -> DataFrame:
    return relations(spark, d).select(
        "buyer", "supplier_id", "n_processes", F.col("value").cast("double").alias("value"), "buyer_share_pct", "dependence_pct"
    )


@query(
    "top_relations",
    with_views(
        "relations",
        """select buyer, supplier_id, cast(value as double) as value, buyer_share_pct from relations
        order by relations.value desc, buyer, supplier_id limit 20""",
    ),
)
def top_relations(spark: SparkSession, d: str) -> DataFrame:
    top = relations(spark, d).orderBy(F.desc("value"), "buyer", "supplier_id").limit(20)
    return top.select("buyer", "supplier_id", F.col("value").cast("double").alias("value"), "buyer_share_pct")


@query(
    "top3_per_buyer",
    with_views(
        "relations",
        """select buyer, supplier_id, cast(value as double) as value, buyer_share_pct, rank from (
          select *, row_number() over (partition by buyer order by value desc, supplier_id) as rank from relations) where rank <= 3""",
    ),
)
def top3_per_buyer(spark: SparkSession, d: str) -> DataFrame:
    top = top_n_per(relations(spark, d), ["buyer"], [F.desc("value"), F.asc("supplier_id")], 3)
    return top.select("buyer", "supplier_id", F.col("value").cast("double").alias("value"), "buyer_share_pct", "rank")


@query(
    "supplier_profile",
    with_views(
        "relations",
        """select supplier_id, supplier_name, count(*) as n_buyers, sum(n_processes)::bigint as n_processes, cast(sum(value) as double) as value,
          max(dependence_pct) as max_dependence_pct, arg_min(buyer, (-value, buyer)) as principal_buyer,
          case when max(dependence_pct) >= 80 then 'Alta dependencia' when max(dependence_pct) >= 50 then 'Dependencia moderada' else 'Diversificado' end as profile
        from relations group by 1, 2""",
    ),
)
def supplier_profile(spark: SparkSession, d: str) -> DataFrame:
    return mk.supplier_profile(relations(spark, d)).withColumn("value", F.col("value").cast("double"))


@query(
    "share_matrix",
    with_views(
        "relations",
        """, tb as (select buyer from relations group by 1 order by sum(value) desc, buyer limit 10),
        ts as (select supplier_id, row_number() over (order by v desc, supplier_id) as r from (
          select supplier_id, sum(value) as v from relations group by 1) order by r limit 12)
        select buyer, """
        + ", ".join(f"coalesce(max(buyer_share_pct) filter (where r = {i}), 0) as s{i:02d}" for i in range(1, 13))
        + " from relations join tb using (buyer) join ts using (supplier_id) group by 1",
    ),
)
def share_matrix(spark: SparkSession, d: str) -> DataFrame:
    return mk.share_matrix(relations(spark, d))


@query(
    "month_profile_by_year",
    """select year(o_orderdate) as year, month(o_orderdate) as month, count(*) as n,
      round(count(*) * 100.0 / sum(count(*)) over (partition by year(o_orderdate)), 6) as pct from orders group by 1, 2""",
)
def month_profile_by_year(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(
        F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))
    return tb.prefix_share(o, ["year"])  # twelve rows per year


@query(
    "peer_rank",
    with_views(
        "suppliers",
        f"""select supplier_id, cast(value as double) as value, 1 + (select count(*) from suppliers p
            where regexp_matches(p.supplier_name, '{inp.PEER}') and not regexp_matches(p.supplier_name, '{inp.ANCHOR}') and p.value > a.value) as peer_rank,
          1 + (select count(*) from suppliers p where regexp_matches(p.supplier_name, '{inp.PEER}') and not regexp_matches(p.supplier_name, '{inp.ANCHOR}')) as n_peers
        from suppliers a where regexp_matches(supplier_name, '0{inp.ANCHOR}')""",
    ),
)
def peer_rank(spark: SparkSession, d: str) -> DataFrame:
    t = cut_lineage(mk.supplier_totals(inp.market(spark, d, "supplier_id", "supplier_name", "value")))
    anchor = F.col("supplier_name").rlike("0" + inp.ANCHOR)
    peer = F.col("supplier_name").rlike(inp.PEER) & ~F.col("supplier_name").rlike(inp.ANCHOR)
    anchors = t.where(anchor)  # larger tables hold many
    freq = t.where(anchor | peer).groupBy("value").agg(F.count_if(peer).alias("_n"))
    run = running_totals(freq, "value", [], {"_upto": "_n"}, grouped=True)
    return anchors.join(run, "value").select(
        "supplier_id",
        F.col("value").cast("double").alias("value"),
        (1 + F.col("_upto") - F.col("_n")).alias("peer_rank"),
        (1 + t.agg(F.count_if(peer)).scalar()).alias("n_peers"),
    )


inp.add_view(
    "rotation",
    "market",
    f"""per_year as (select year(published_at) as year, supplier_id, min(supplier_name) as supplier_name, sum(value) as value from market group by 1, 2),
    ranked_year as (select *, row_number() over (partition by year order by value desc, supplier_id) as r from per_year),
    tops as (select year, list(supplier_id) as ids from ranked_year where r <= {inp.TOP_ROTATION} group by 1),
    rotation as (select y.year, n_suppliers, top1_id, top1_name, cast(top1_value as double) as top1_value,
        round(cast(top1_value as double) / cast(total as double) * 100.0, 6) as top1_pct,
        round(len(list_intersect(t.ids, p.ids)) / nullif(len(list_distinct(list_concat(t.ids, p.ids))), 0)
          * case when p.ids is null then null else 100.0 end, 6) as jaccard_pct
      from (select year, count(*) as n_suppliers, sum(value) as total, max(supplier_id) filter (where r = 1) as top1_id,
              max(supplier_name) filter (where r = 1) as top1_name, max(value) filter (where r = 1) as top1_value from ranked_year group by 1) y
      join tops t on t.year = y.year left join tops p on p.year = y.year - 1)""",
)


@query("yearly_rotation", with_views("rotation", "select * from rotation"))
def yearly_rotation(spark: SparkSession, d: str) -> DataFrame:
    return mk.yearly_rotation(
        inp.market(spark, d, "published_at", "supplier_id", "supplier_name", "value"), inp.TOP_ROTATION
    )


@query("top50_rotation", with_views("rotation", "select year, n_suppliers, jaccard_pct from rotation"))
def top50_rotation(spark: SparkSession, d: str) -> DataFrame:
    return yearly_rotation(spark, d).select("year", "n_suppliers", "jaccard_pct")


def _wide_sql(source: str, years: tuple[int, ...]) -> str:
    sums = ", ".join(f"coalesce(sum(value) filter (where year(published_at) = {y}), 0) as v{y}" for y in years)
    pcts = ", ".join(f"cast(v{y} as double) / cast(sum(v{y}) over () as double) * 100.0 as pct_{y}" for y in years)
    ys = ", ".join(map(str, years))
    return f"""wide as (select supplier_id, supplier_name, {pcts} from (
      select supplier_id, min(supplier_name) as supplier_name, {sums} from {source} where year(published_at) in ({ys}) group by 1))"""


@query(
    "share_change",
    with_views(
        "market",
        f""", {_wide_sql('market', (1999, 2000))},
        c as (select supplier_id, supplier_name, round(pct_1999, 6) as pct_1999, round(pct_2000, 6) as pct_2000, round(pct_2000 - pct_1999, 6) as change_pp,
          case when pct_1999 = 0 and pct_2000 > 0 then 'Entrante' when pct_1999 > 0 and pct_2000 = 0 then 'Saliente'
            when pct_2000 - pct_1999 > 0 then 'Ganó participación' else 'Perdió participación' end as class from wide)
        select *, 'up' as side from (select * from c order by change_pp desc, supplier_id limit 10)
        union all select *, 'down' from (select * from c order by change_pp, supplier_id limit 10)""",
    ),
)
def share_change(spark: SparkSession, d: str) -> DataFrame:
    w = mk.share_by_year(inp.market(spark, d, "supplier_id", "supplier_name", "value", "published_at"), (1999, 2000))
    a, b = F.col("pct_1999"), F.col("pct_2000")
    c = w.select(
        "supplier_id", "supplier_name", F.round(a, 6).alias("pct_1999"), F.round(b, 6).alias("pct_2000"),
        F.round(b - a, 6).alias("change_pp"), mk.change_class(a, b).alias("class"),
    )
    return mk.extremes(c, "change_pp", "supplier_id")


_YEARS = (1999, 2000, 2001)
_SAME_SQL = f"""
same as (select * from market where year(published_at) in (1999, 2000, 2001) and published_at <= make_timestamp(year(published_at),
    (select month(max(published_at)) from market where year(published_at) = 2001),
    (select dayofmonth(max(published_at)) from market where year(published_at) = 2001), 0, 0, 0)),
{_wide_sql('same', _YEARS)}"""
inp.add_view("wide", "market", _SAME_SQL)


def same_period_shares(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.market(spark, d, "supplier_id", "supplier_name", "value", "published_at")
    return mk.share_by_year(mk.same_period(lines, _YEARS), _YEARS)


@query(
    "same_period_share",
    with_views(
        "wide",
        """select supplier_id, round(pct_1999, 6) as pct_1999, round(pct_2000, 6) as pct_2000, round(pct_2001, 6) as pct_2001,
          round(pct_2000 - pct_1999, 6) as change_1999_2000, round(pct_2001 - pct_2000, 6) as change_2000_2001,
          round(pct_2001 - pct_1999, 6) as change_1999_2001,
          case when pct_2000 = 0 and pct_2001 > 0 then 'Entrante en 2001' when pct_2000 > 0 and pct_2001 = 0 then 'Saliente en 2001'
            when pct_2001 - pct_2000 > 0 then 'Ganó participación' else 'Perdió participación' end as class from wide""",
    ),
)
def same_period_share(spark: SparkSession, d: str) -> DataFrame:
    w = same_period_shares(spark, d)
    a, b, c = (F.col(f"pct_{y}") for y in _YEARS)
    return w.select(
        "supplier_id", *[F.round(f"pct_{y}", 6).alias(f"pct_{y}") for y in _YEARS],
        F.round(b - a, 6).alias("change_1999_2000"), F.round(c - b, 6).alias("change_2000_2001"),
        F.round(c - a, 6).alias("change_1999_2001"), mk.change_class(b, c, " en 2001").alias("class"),
    )


@query(
    "share_long",
    with_views(
        "wide",
        """, top as (select * from wide order by round(pct_1999 + pct_2000 + pct_2001, 6) desc, supplier_id limit 15)
        select supplier_id, 1999 as year, round(pct_1999, 6) as share_pct from top union all select supplier_id, 2000, round(pct_2000, 6) from top
        union all select supplier_id, 2001, round(pct_2001, 6) from top""",
    ),
)
def share_long(spark: SparkSession, d: str) -> DataFrame:
    w = same_period_shares(spark, d)
    total = F.round(sum(F.col(f"pct_{y}") for y in _YEARS), 6)
    top = w.orderBy(total.desc(), "supplier_id").limit(15)
    cols = top.select("supplier_id", *[F.round(f"pct_{y}", 6).alias(str(y)) for y in _YEARS])
    return cols.unpivot("supplier_id", [str(y) for y in _YEARS], "year", "share_pct").withColumn(
        "year", F.col("year").cast("int")
    )


@query(
    "top10_yearly_share",
    with_views(
        "suppliers",
        """, top as (select supplier_id from suppliers order by value desc, supplier_id limit 10),
        py as (select year(published_at) as year, supplier_id, sum(value) as v from market group by 1, 2)
        select year, supplier_id, round(cast(v as double) / cast(t as double) * 100.0, 6) as share_pct from py
        join (select year, sum(v) as t from py group by 1) using (year) where supplier_id in (select supplier_id from top)""",
    ),
)
def top10_yearly_share(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.market(spark, d, "supplier_id", "published_at", "value")
    top = (
        lines.groupBy("supplier_id").agg(F.sum("value").alias("v")).orderBy(F.desc("v"), "supplier_id").limit(10).select("supplier_id")
    )
    per = lines.groupBy(F.year("published_at").cast("long").alias("year"), "supplier_id").agg(F.sum("value").alias("v"))
    totals = per.groupBy("year").agg(F.sum("v").alias("t"))  # one row per year
    return (
        per.join(F.broadcast(top), "supplier_id", "left_semi")
        .join(totals, "year")
        .select("year", "supplier_id", F.round(F.col("v").cast("double") / F.col("t").cast("double") * 100.0, 6).alias("share_pct"))
    )


@query(
    "segment_value_month",
    with_views(
        "mega",
        """select cast(date_trunc('month', published_at) as date) as month, segment, cast(sum(value_real) as double) as value_real
        from mega where not implausible and not is_mega group by 1, 2""",
    ),
)
def segment_value_month(spark: SparkSession, d: str) -> DataFrame:
    p = mega_processes(spark, d, "process_id", "segment").where(~F.col("implausible") & ~F.col("is_mega"))
    return p.groupBy(F.trunc("published_at", "month").alias("month"), "segment").agg(
        F.sum("value_real").cast("double").alias("value_real")
    )


#: Most frequent methods shown by year.
TOP_METHODS = 6


@query(
    "method_year",
    with_views(
        "processes",
        f"""select year(published_at) as year, method, count(*) as n from processes where method in (
          select method from processes group by 1 order by count(*) desc, method limit {TOP_METHODS}) group by 1, 2""",
    ),
)
def method_year(spark: SparkSession, d: str) -> DataFrame:
    p = inp.processes(spark, d, "process_id", "method", "published_at")
    top = p.groupBy("method").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "method").limit(TOP_METHODS).select("method")
    return (
        p.join(F.broadcast(top), "method", "left_semi")
        .groupBy(F.year("published_at").cast("long").alias("year"), "method")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "top_lines",
    with_views("awards", "select process_id, supplier_id, value from awards order by value desc, process_id, supplier_id limit 15"),
)
def top_lines(spark: SparkSession, d: str) -> DataFrame:
    return inp.awards(spark, d, "process_id", "supplier_id", "value").orderBy(F.desc("value"), "process_id", "supplier_id").limit(15)


@query(
    "is_university",
    """select n, name, case n % 5 when 0 then true when 1 then true when 2 then true when 3 then length(k) >= 3 else false end as flag from (
      select p_partkey as n, replace(upper(p_name), ' ', '') as k, case p_partkey % 5 when 0 then 'Universidad ' || p_name when 1 then 'uptc ' || p_name
        when 2 then 'Pascual  Bravo' when 3 then 'uni' || replace(p_name, ' ', '') else 'Comercial ' || p_name end as name from part)""",
)
def is_university_query(spark: SparkSession, d: str) -> DataFrame:
    n, name = F.col("p_partkey"), F.col("p_name")
    made = (
        F.when(n % 5 == 0, F.concat(F.lit("Universidad "), name))
        .when(n % 5 == 1, F.concat(F.lit("uptc "), name))
        .when(n % 5 == 2, F.lit("Pascual  Bravo"))
        .when(n % 5 == 3, F.concat(F.lit("uni"), F.replace(name, F.lit(" "), F.lit(""))))
        .otherwise(F.concat(F.lit("Comercial "), name))
    )
    p = table(spark, d, "part").select(n.alias("n"), made.alias("name"))
    return p.withColumn("flag", is_university(F.col("name"), IES_WORDS))
