"""Eligibility, teams, priorities, inventories and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tenderscope.operators import decisions as de
from tenderscope.plans import inputs as inp, nested_sql
from tenderscope.plans.inputs import add_view, table, with_views
from tenderscope.plans.nested import calls
from tenderscope.plans.registry import query


@query("actor_match", nested_sql.ACTOR_MATCH)
def actor_match(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).select("convocatoria", F.explode(de.actor_hits(F.col("actores_elegibles"))).alias("a"))
    return c.select("convocatoria", "a.tipo", "a.rol")


@query(
    "eligibility_rules",
    """with c as (select doc_id as k, case when doc_id % 11 = 0 then 0 when doc_id % 3 = 1 then 1 else 2 end as st, doc_id % 4 as r, doc_id % 5 = 1 as by_text,
        case doc_id % 3 when 0 then true when 1 then false end as al from documents),
      f as (select *, r in (1, 3) or by_text as ex, r = 0 and not by_text as only_ally from c)
    select 'convocatoria_' || k as convocatoria, case st when 1 then false when 2 then true end as puede_postularse,
      case st when 0 then 'desconocido' when 1 then 'no_elegible' else case when only_ally and not ex then 'solo_como_aliado' when al then 'solo_en_alianza' when not al then 'puede_sola_o_alianza' else 'elegible_alianza_indefinida' end end as modo,
      case when st = 2 then case when only_ally and not ex then 'aliado' when ex or r = 2 then 'ejecutora' else 'aliado' end end as rol_sugerido,
      case when st = 0 then 'baja' when st = 2 and k % 5 = 0 then 'media' else 'alta' end as confianza from f""",
)
def eligibility_rules(spark: SparkSession, d: str) -> DataFrame:
    v = de.rule_verdict(calls(spark, d))
    return v.select("convocatoria", "puede_postularse", "modo", "rol_sugerido", "confianza")


@query("pending_conditions", nested_sql.PENDING)
def pending_conditions(spark: SparkSession, d: str) -> DataFrame:
    v = de.rule_verdict(calls(spark, d))
    return v.select("convocatoria", F.inline("pendientes"))


@query(
    "merge_verdicts",
    """select o_orderkey as call_id, coalesce(case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then o_orderpriority < '3' end, o_orderstatus = 'F') as puede,
      case when o_orderkey % 3 = 0 and o_orderkey % 5 <> 0 then 'sola' else 'reglas_' || o_orderstatus end as modo,
      case when o_orderkey % 3 = 0 and o_orderkey % 7 <> 0 then 'proponente' else 'ejecutora' end as rol,
      case when o_orderkey % 3 = 0 then 'reglas+segunda' else 'reglas' end as fuente from orders""",
)
def merge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    rules = o.select(
        k.alias("call_id"), (F.col("o_orderstatus") == "F").alias("puede"), F.concat(F.lit("reglas_"), "o_orderstatus").alias("modo"),
        F.lit("ejecutora").alias("rol"),
    )
    second = o.where(k % 3 == 0).select(
        k.alias("call_id"),
        F.when(k % 2 == 0, F.col("o_orderpriority") < "3").alias("puede"),
        F.when(k % 5 != 0, "sola").otherwise("").alias("modo"),
        F.when(k % 7 != 0, "proponente").alias("rol"),
    )
    return de.merge_verdicts(rules, second, "call_id")


add_view(
    "team",
    "",
    """crank as (select l_orderkey as q, l_suppkey as id, max(l_quantity / 50) as score_final from lineitem group by 1, 2),
    cr as (select *, row_number() over (partition by q order by score_final desc, id) as rank, max(score_final) over (partition by q) >= 0.65 as strong from crank),
    team as (select q, id, score_final, rank, case when rank = 1 then 'Investigador' else 'Co-investigador' end as role from cr
      where rank <= 6 and case when strong then score_final >= 0.65 else rank <= 3 end)""",
)


def call_ranking(spark: SparkSession, d: str) -> DataFrame:
    """A ranking per process: its suppliers scored by quantity."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("id")).agg(
        F.max(F.col("l_quantity") / 50).alias("score_final")
    )


@query("team_pick", with_views("team", "select q, id, score_final, rank, role from team"))
def team_pick(spark: SparkSession, d: str) -> DataFrame:
    return de.pick_team(call_ranking(spark, d)).select("q", "id", "score_final", "rank", "role")


add_view(
    "plan",
    "",
    """m as (select l_orderkey as q, max(l_quantity / 50) as match from lineitem group by 1),
    rate as (select o_orderpriority, avg((o_orderstatus = 'F')::int) as p from orders group by 1),
    pool as (select o_orderkey as call_id, match, p from orders left join m on q = o_orderkey join rate using (o_orderpriority)
      where o_orderstatus = 'F' and (year(o_orderdate) >= 2000 or (select count(*) from orders where o_orderstatus = 'F' and year(o_orderdate) >= 2000) < 3)),
    pri as (select *, round(0.45::double * coalesce(match, 0) + 0.40::double * coalesce(p, 0) + 0.15::double, 4) as priority from pool),
    plan as (select call_id, priority, row_number() over (order by priority desc, match desc nulls last, call_id) <= 20 as in_plan from pri)""",
)


@query("portfolio_plan", with_views("plan", "select call_id, priority, in_plan from plan"))
def portfolio_plan(spark: SparkSession, d: str) -> DataFrame:
    best = call_ranking(spark, d).groupBy("q").agg(F.max("score_final").alias("match"))
    o = table(spark, d, "orders")
    rate = o.groupBy("o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("p"))
    c = o.select(
        F.col("o_orderkey").alias("call_id"), "o_orderpriority", (F.col("o_orderstatus") == "F").alias("eligible"), F.col("o_orderdate").alias("opened")
    )
    pool = de.opportunity_pool(c, "eligible", "opened", since=2000)
    full = pool.join(best, F.col("call_id") == F.col("q"), "left").join(rate, "o_orderpriority")
    return de.portfolio(full, "call_id", 20).select("call_id", "priority", "in_plan")


#: Balance from which a supplier stands for a senior; below zero it has no profile.
SENIOR_BALANCE = 8000

_PLAN_STATE_SQL = f"""state as (
      select q, count(*) as n_team, count(distinct s_nationkey) as n_fac, count(*) filter (where score_final >= {de.TEAM_SCORE}) as n_strong,
        count(*) filter (where s_acctbal < 0) as n_none, coalesce(bool_or(s_acctbal > {SENIOR_BALANCE}), false) as senior
      from team join supplier on s_suppkey = id group by 1),
    lined as (select l_orderkey as q, count(*) filter (where l_returnflag = 'A') as n_lines, case when count(*) > 1 then avg((l_linestatus = 'F')::int) end as p from lineitem group by 1),
    plans as (select state.*, n_lines, p, case o_orderstatus when 'F' then true when 'P' then false end as ally
      from state join lined using (q) join orders on o_orderkey = q)"""


@query(
    "plan_actions",
    with_views(
        "team",
        f""", {_PLAN_STATE_SQL} select q, array_to_string(list_filter([case when n_team > 0 then 'contact_lead' end, 'confirm_availability', 'cross_check_lines',
          case when ally then 'find_partner' end, case when not ally then 'consider_partner' end, case when n_fac >= 2 then 'use_several_faculties' end,
          case when n_lines > 0 then 'justify_fit' end, case when p < 0.45 then 'review_low_signal' end, case when p >= 0.55 then 'prioritise_high_signal' end, 'update_evidence'],
          lambda x: x is not null), ';') as actions,
        coalesce(nullif(array_to_string(list_filter([case when n_strong < 2 then 'few_strong_people' end, case when n_none > 0 then 'profiles_without_cv' end,
          case when ally then 'depends_on_partner' end, case when not senior then 'no_senior' end], lambda x: x is not null), ';'), ''), 'residual') as risks from plans""",
    ),
)
def plan_actions(spark: SparkSession, d: str) -> DataFrame:
    """Actions and risks of every call from its team, its suppliers' places and balances, its lines and its state."""
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", "s_acctbal")
    team = de.pick_team(call_ranking(spark, d)).join(suppliers, "id")
    state = team.groupBy("q").agg(
        F.count(F.lit(1)).alias("n_team"),
        F.countDistinct("s_nationkey").alias("n_faculties"),
        F.count_if(F.col("score_final") >= de.TEAM_SCORE).alias("n_strong"),
        F.count_if(F.col("s_acctbal") < 0).alias("n_without_cv"),
        F.coalesce(F.bool_or(F.col("s_acctbal") > SENIOR_BALANCE), F.lit(False)).alias("has_senior"),
    )
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("n_lines"),
        F.when(F.count(F.lit(1)) > 1, F.avg((F.col("l_linestatus") == "F").cast("int"))).alias("p"),
    )
    status = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("q"), status.alias("alliance"))
    out = de.actions_and_risks(state.join(lines, "q").join(orders, "q"))
    return out.select("q", F.array_join("actions", ";").alias("actions"), F.array_join("risks", ";").alias("risks"))


@query(
    "call_decisions",
    with_views(
        "team",
        f""", lead as (select q, count(*) as n_team, max(score_final) as match, arg_min(id, rank) as lead from team group by 1),
        rated as (select l_orderkey as q, avg((l_linestatus = 'F')::int) as p from lineitem group by 1),
        every as (select o_orderkey as call_id, cast(o_orderdate as date) as opened, case o_orderstatus when 'F' then true when 'P' then false end as eligible,
            lead, coalesce(n_team, 0) as n_team, match, p, d.doc_id is not null as read
          from orders left join lead on lead.q = o_orderkey left join rated on rated.q = o_orderkey left join documents d on d.doc_id = o_orderkey),
        told as (select *, round(0.45::double * coalesce(match, 0) + 0.40::double * coalesce(p, 0) + 0.15::double * case when eligible then 1 when eligible is null then 0.35::double else 0 end, 4) as priority from every)
        select *, case when not eligible then 'discard' when match is null then 'unranked' when not read then 'unread' when priority >= {de.PURSUE} then 'pursue' else 'review' end as decision from told""",
    ),
)
def call_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every process as a call: state, team, chance, text and what follows from them."""
    status = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False)
    opened = F.col("o_orderdate").cast("date").alias("opened")
    calls = table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), opened, status.alias("eligible"))
    rates = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.avg((F.col("l_linestatus") == "F").cast("int")).alias("p"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("call_id"), "n_chars")
    return de.decision_table(calls, de.pick_team(call_ranking(spark, d)), rates, texts)


@query(
    "proxy_features",
    """select o_orderkey as call_id, case when o_orderkey % 4 = 0 then 5e8 else o_totalprice end as base_price,
      cast(greatest(3, least(coalesce(nullif(case when o_orderkey % 3 = 0 then null else o_custkey % 80 end, 0), 18), 60)) as double) as duration, 1 as lots,
      month(o_orderdate) as month, year(o_orderdate) as year from orders""",
)
def proxy_features(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(
        k.alias("call_id"),
        F.when(k % 4 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("amount"),
        F.when(k % 3 != 0, F.col("o_custkey") % 80).cast("int").alias("max_months"),
        F.lit(None).cast("int").alias("min_months"),
        F.col("o_orderdate").alias("opened"),
    )
    return de.proxy_features(c)


_INV_SQL = """inv as (select d.doc_id as call_id, source as title, case when length(trim(text)) > 140 then substr(trim(text), 1, 140) || '…' else trim(text) end as preview,
      d.doc_id % 2 = 0 as has_ranking, quality is not null as has_verdict, case when d.doc_id % 2 = 0 then d.doc_id * 7 % 100 end as top1_id, case when d.doc_id % 2 = 0 then (n_chars % 100) / 100.0::double end as top1_score,
      quality = 1 as eligible from documents d left join labels l on l.doc_id = d.doc_id)"""


def inventory(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    k = F.col("doc_id")
    c = docs.select(k.alias("call_id"), F.col("source").alias("title"))
    ext = docs.select(k.alias("call_id"), F.col("text").alias("objective"))
    rk = docs.where(k % 2 == 0).select(
        k.alias("call_id"), (k * 7 % 100).alias("top1_id"), ((F.col("n_chars") % 100) / 100.0).alias("top1_score")
    )
    ver = table(spark, d, "labels").select(k.alias("call_id"), (F.col("quality") == 1).alias("eligible"))
    return de.call_inventory(c, rk, ver, ext)


@query("call_inventory", f"with {_INV_SQL} select * from inv")
def call_inventory(spark: SparkSession, d: str) -> DataFrame:
    return inventory(spark, d)


@query(
    "project_counters",
    f"with {_INV_SQL} select count(*) as n_calls, count(*) filter (where has_ranking) as n_ranked, count(*) filter (where not has_ranking) as n_pending, count(*) filter (where eligible) as n_eligible from inv",
)
def project_counters(spark: SparkSession, d: str) -> DataFrame:
    return inventory(spark, d).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if("has_ranking").alias("n_ranked"),
        F.count_if(~F.col("has_ranking")).alias("n_pending"),
        F.count_if(F.col("eligible")).alias("n_eligible"),
    )


#: Characters that a fetched page has at least.
FETCHED = 2000


@query(
    "link_audit",
    rf"""select case when page_id is null then 'not_found' when length(html) < {FETCHED} then 'unreachable'
      when d.lang <> regexp_extract(url, '^[a-z]+://[^/]*/([a-z]{{2}})/', 1) then 'discrepancy' else 'confirmed' end as outcome, count(*) as n
    from documents d left join pages on page_id = doc_id group by 1""",
)
def link_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every document against the page of its id: missing, cut short, in another language, or as it should be."""
    sample = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    links = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", "html")
    spoken = F.regexp_extract("url", r"^[a-z]+://[^/]*/([a-z]{2})/", 1)
    checks = links.join(sample, "id").select(
        "id", F.when(F.length("html") < FETCHED, "short").alias("error"), F.when(F.col("lang") != spoken, F.col("url")).alias("found_url")
    )
    sample, links = sample.select("id"), links.select("id")
    return de.link_audit(sample, links, checks).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
