"""Eligibility rules, teams, priorities and portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderscope.functions.text import norm_lower
from tenderscope.operators.ranks import top_n_per

# Wording that names a higher-education institution.
INSTITUTION = (
    r"institucion(?:es)?\s+de\s+educacion\s+superior|\bies\b|universidades?|institucion(?:es)?\s+universitaria"
)
EXECUTOR_TEXT = r"entidad ejecutora|proponente|como ejecutor"
ALLY_ROLES = ("aliada", "aliado", "colaboradora", "colaborador")
# Pending conditions and the risk each stands for.
CONDITION_RISKS = (
    ("territorio", r"sede|municipio|region|departamento|sgr|domicilio"),
    ("acreditacion", r"acreditacion"),
    ("grupos_minciencias", r"grupo|categoriz|a1|\ba\b|\bb\b|\bc\b|957"),
    ("experiencia", r"experiencia|sgr|50\s*%"),
)
TEAM_SCORE, TEAM_FALLBACK, TEAM_CAP = 0.65, 3, 6


def actor_hits(actors: Column, pattern: str = INSTITUTION) -> Column:
    return F.filter(actors, lambda a: norm_lower(a["tipo"]).rlike(pattern))


def rule_verdict(calls: DataFrame, pattern: str = INSTITUTION) -> DataFrame:
    """Deterministic verdict per call; three-valued where the call does not say."""
    df = calls.withColumn("_n", F.coalesce(F.size("actores_elegibles"), F.lit(0))).withColumn(
        "hits", F.coalesce(actor_hits(F.col("actores_elegibles"), pattern), F.slice("actores_elegibles", 1, 0))
    )
    df = df.withColumn("_roles", F.filter(F.transform("hits", lambda h: norm_lower(h["rol"])), lambda r: r != ""))
    by_text = F.exists("hits", lambda h: norm_lower(h["condicion"]).rlike(EXECUTOR_TEXT))
    by_role = F.exists("_roles", lambda r: (r == "ejecutor") | r.contains("ejecut") | r.contains("propon"))
    only_ally = (F.size("_roles") > 0) & F.forall("_roles", lambda r: r.isin(*ALLY_ROLES)) & ~by_text
    df = df.withColumns({"_exec": by_role | by_text, "_ally": only_ally})
    first_role = F.nullif(F.try_element_at("hits", F.lit(1))["rol"], F.lit(""))
    none, missing = F.col("_n") == 0, F.size("hits") == 0
    ally = F.col("_ally") & ~F.col("_exec")
    alliance = F.col("alianza_obligatoria")
    lead = F.when(F.col("_exec") | (F.size("_roles") == 0), "ejecutora").otherwise(F.coalesce(first_role, F.lit("participante")))
    df = df.withColumns(
        {
            "puede_postularse": F.when(none, F.lit(None).cast("boolean")).when(missing, False).otherwise(True),
            "modo": F.when(none, "desconocido")
            .when(missing, "no_elegible")
            .when(ally, "solo_como_aliado")
            .when(alliance, "solo_en_alianza")
            .when(~alliance, "puede_sola_o_alianza")
            .otherwise("elegible_alianza_indefinida"),
            "rol_sugerido": F.when(none | missing, F.lit(None).cast("string"))
            .when(ally, F.coalesce(first_role, F.lit("aliado")))
            .otherwise(lead),
            "pendientes": condition_risks(F.transform("hits", lambda h: h["condicion"])),
        }
    )
    return df.withColumn(
        "confianza", F.when(none, "baja").when(F.size("pendientes") > 0, "media").otherwise("alta")
    ).drop("_n", "_roles", "_exec", "_ally")


def condition_risks(conditions: Column) -> Column:
    """(condition, risk) for every risk a condition mentions."""

    def risks(c: Column) -> Column:
        items = [F.when(norm_lower(c).rlike(p), F.struct(c.alias("condicion"), F.lit(r).alias("riesgo"))) for r, p in CONDITION_RISKS]
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    real = F.filter(conditions, lambda c: F.coalesce(c, F.lit("")) != "")
    return F.flatten(F.transform(real, risks))


def merge_verdicts(rules: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The second opinion wins field by field; a blank mode or role falls back to the rules."""
    s = second.select(key, F.col("puede").alias("_p"), F.col("modo").alias("_m"), F.col("rol").alias("_r"), F.lit(True).alias("_s"))
    blank = F.lit("")
    return rules.join(s, key, "left").select(
        key,
        F.coalesce("_p", "puede").alias("puede"),
        F.coalesce(F.nullif("_m", blank), F.col("modo")).alias("modo"),
        F.coalesce(F.nullif("_r", blank), F.col("rol")).alias("rol"),
        F.when(F.col("_s"), "reglas+segunda").otherwise("reglas").alias("fuente"),
    )


def opportunity_pool(calls: DataFrame, eligible: str, opened: str, since: int = 2023, least: int = 3) -> DataFrame:
    """Eligible calls; only the recent ones where there are enough of them."""
    ok = calls.where(F.col(eligible))
    recent = F.coalesce(F.year(opened) >= since, F.lit(False))
    n = ok.where(recent).agg(F.count(F.lit(1))).scalar()
    return ok.where(recent | (n < least))


def pick_team(ranking: DataFrame) -> DataFrame:
    """Strong people of a call, else the first three; at most six; first is the lead.

    The window group limit keeps six rows per call and map task before the shuffle.
    """
    top = top_n_per(ranking, ["q"], [F.desc("score_final"), F.asc("id")], TEAM_CAP)
    call = Window.partitionBy("q")  # six rows
    strong = F.col("score_final") >= TEAM_SCORE
    marked = top.withColumn("_any", F.max(F.when(strong, 1).otherwise(0)).over(call) == 1)
    kept = marked.where(F.when(F.col("_any"), strong).otherwise(F.col("rank") <= TEAM_FALLBACK))
    return kept.withColumn("role", F.when(F.col("rank") == 1, "Investigador").otherwise("Co-investigador")).drop("_any")


def priority(match: Column, p: Column, eligible: Column) -> Column:
    e = F.when(eligible, 1.0).when(eligible.isNull(), 0.35).otherwise(0.0)
    return F.round(0.45 * F.coalesce(match, F.lit(0.0)) + 0.40 * F.coalesce(p, F.lit(0.0)) + 0.15 * e, 4)


#: Priority from which a call is pursued first.
PURSUE = 0.6


def decision_table(calls: DataFrame, team: DataFrame, rates: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row per call with all that decides on it.

    ``calls(call_id, opened, eligible)``, ``team`` as ``pick_team`` gives it, ``rates(call_id, p)`` and
    ``extractions(call_id, n_chars)``; the last three may lack calls. Everything is joined on the call,
    with at most one row a side, so no join multiplies rows.
    """
    lead = team.groupBy(F.col("q").alias("call_id")).agg(
        F.count(F.lit(1)).alias("n_team"), F.max("score_final").alias("match"), F.min_by("id", "rank").alias("lead")
    )
    texts = extractions.groupBy("call_id").agg(F.max("n_chars").alias("n_chars"))
    chance = rates.groupBy("call_id").agg(F.max("p").alias("p"))
    every = calls.join(lead, "call_id", "left").join(chance, "call_id", "left").join(texts, "call_id", "left")
    every = every.withColumn("priority", priority(F.col("match"), F.col("p"), F.col("eligible")))
    decision = (
        F.when(~F.col("eligible"), "discard").when(F.col("match").isNull(), "unranked").when(F.col("n_chars").isNull(), "unread")
        .when(F.col("priority") >= PURSUE, "pursue").otherwise("review")
    )
    return every.select(
        "call_id", "opened", "eligible", "lead", F.coalesce("n_team", F.lit(0)).alias("n_team"), "match", "p", F.col("n_chars").isNotNull().alias("read"),
        "priority", decision.alias("decision"),
    )


def portfolio(opportunities: DataFrame, key: str, top: int) -> DataFrame:
    """Priority of every opportunity; the ``top`` first are in the plan."""
    scored = opportunities.withColumn("priority", priority(F.col("match"), F.col("p"), F.col("eligible")))
    first = scored.orderBy(F.desc("priority"), F.desc("match"), key).limit(top).select(key, F.lit(True).alias("_in"))
    return scored.join(F.broadcast(first), key, "left").withColumn("in_plan", F.coalesce("_in", F.lit(False))).drop("_in")


def actions_and_risks(plans: DataFrame) -> DataFrame:
    """Lists of codes from the state of a plan (``n_team, n_faculties, n_strong, n_without_cv,
    has_senior, alliance, n_lines, p``)."""

    def listed(*items: tuple[str, Column]) -> Column:
        return F.filter(F.array(*[F.when(c, F.lit(code)) for code, c in items]), lambda x: x.isNotNull())

    yes = F.lit(True)
    team = F.col("n_team") > 0
    must = F.coalesce(F.col("alliance"), F.lit(False))
    actions = listed(
        ("contact_lead", team),
        ("confirm_availability", yes),
        ("cross_check_lines", yes),
        ("find_partner", must),
        ("consider_partner", F.coalesce(~F.col("alliance"), F.lit(False))),
        ("use_several_faculties", F.col("n_faculties") >= 2),
        ("justify_fit", F.col("n_lines") > 0),
        ("review_low_signal", F.coalesce(F.col("p") < 0.45, F.lit(False))),
        ("prioritise_high_signal", F.coalesce(F.col("p") >= 0.55, F.lit(False))),
        ("update_evidence", yes),
    )
    risks = listed(
        ("few_strong_people", F.col("n_strong") < 2),
        ("profiles_without_cv", F.col("n_without_cv") > 0),
        ("depends_on_partner", must),
        ("no_senior", ~F.col("has_senior") & team),
    )
    return plans.withColumn("actions", actions).withColumn(
        "risks", F.when(F.size(risks) > 0, risks).otherwise(F.array(F.lit("residual")))
    )


def proxy_features(calls: DataFrame) -> DataFrame:
    """Model inputs of a call from its amount, term and opening date, with defaults."""
    amount = F.when(F.col("amount") > 0, F.col("amount"))
    months = F.coalesce(F.nullif(F.col("max_months"), F.lit(0)), F.nullif(F.col("min_months"), F.lit(0)), F.lit(18))
    return calls.select(
        "call_id",
        F.coalesce(amount, F.lit(5e8)).alias("base_price"),
        F.greatest(F.lit(3), F.least(months, F.lit(60))).cast("double").alias("duration"),
        F.lit(1).alias("lots"),
        F.coalesce(F.month("opened"), F.lit(6)).alias("month"),
        F.coalesce(F.year("opened"), F.year(F.current_date())).alias("year"),
    )


def call_inventory(calls: DataFrame, rankings: DataFrame, verdicts: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row per call with its flags and a preview; ranked first, then newest id."""
    out = (
        calls.join(extractions, "call_id", "left")
        .join(rankings.withColumn("has_ranking", F.lit(True)), "call_id", "left")
        .join(verdicts.withColumn("has_verdict", F.lit(True)), "call_id", "left")
    )
    goal = F.trim(F.coalesce("objective", F.lit("")))
    return out.select(
        "call_id",
        "title",
        F.when(F.length(goal) > 140, F.concat(F.substring(goal, 1, 140), F.lit("…"))).otherwise(goal).alias("preview"),
        F.coalesce("has_ranking", F.lit(False)).alias("has_ranking"),
        F.coalesce("has_verdict", F.lit(False)).alias("has_verdict"),
        "top1_id",
        "top1_score",
        "eligible",
    ).orderBy(F.desc("has_ranking"), F.desc("call_id"))


def link_audit(sample: DataFrame, links: DataFrame, checks: DataFrame) -> DataFrame:
    """Outcome of each audited id: not found, unreachable, discrepancy or confirmed."""
    j = sample.join(links.withColumn("_l", F.lit(True)), "id", "left").join(checks, "id", "left")
    return j.select(
        "id",
        F.when(F.col("_l").isNull(), "not_found")
        .when(F.coalesce("error", F.lit("")) != "", "unreachable")
        .when(F.coalesce("found_url", F.lit("")) != "", "discrepancy")
        .otherwise("confirmed")
        .alias("outcome"),
    )
