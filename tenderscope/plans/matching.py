"""Ranking, evidence and score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tenderscope.functions import text as tx
from tenderscope.operators import matching as mt
from tenderscope.operators.ranks import top_n_per
from tenderscope.plans.inputs import add_view, table, with_views
from tenderscope.plans.registry import query
from tenderscope.session import cut_lineage

CATEGORIES = ("Investigador Emérito", "Investigador Senior", "Investigador Asociado", "Investigador Junior", None)
_CAT_SQL = "(['Investigador Emérito', 'Investigador Senior', 'Investigador Asociado', 'Investigador Junior', NULL])"
_BONUS_SQL = """((case when has_cv then 0.12::double else 0.0::double end)
  + (case when lower(category) like '%emérito%' then 0.18::double when lower(category) like '%senior%' then 0.16::double when lower(category) like '%asociado%' then 0.13::double
     when lower(category) like '%junior%' then 0.09::double else 0.0::double end)
  + (case when n_areas >= 5 then 0.08::double when n_areas >= 2 then 0.05::double when n_areas >= 1 then 0.03::double else 0.0::double end))"""

add_view(
    "people",
    "",
    f"""people as (select *, {_BONUS_SQL} as bonus from (select d.doc_id as id, text, coalesce(quality, 0) = 1 as has_cv, {_CAT_SQL}[1 + d.doc_id % 5] as category,
      n_chars % 7 as n_areas, source as faculty from documents d left join labels l on l.doc_id = d.doc_id))""",
)


def people(spark: SparkSession, d: str) -> DataFrame:
    """Documents as people: their text, and profile columns derived from the tables."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    p = docs.select(
        F.col("doc_id").alias("id"),
        "text",
        (F.coalesce("quality", F.lit(0)) == 1).alias("has_cv"),
        mt.category_of(F.col("doc_id") % 5, CATEGORIES).alias("category"),
        (F.col("n_chars") % 7).alias("n_areas"),
        F.col("source").alias("faculty"),
    )
    return p.withColumn("bonus", mt.profile_bonus(F.col("has_cv"), F.col("category"), F.col("n_areas")))


def call_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text")


_TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"
_TERMS = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"
add_view(
    "weights",
    "people",
    f"""dw as (select id, {_TOK.format(c='text')} as w from people), qw as (select item_id as q, {_TOK.format(c='text')} as w from benchmark),
    dt as (select id, term, count(*) as tf from (select id, {_TERMS} as term from dw) group by 1, 2),
    qt as (select q, term, count(*) as tf from (select q, {_TERMS} as term from qw) group by 1, 2),
    voc as (select term, ln((1.0::double + (select count(*) from people)) / (1.0::double + count(*))) + 1 as idf from dt group by 1 order by sum(tf) desc, term limit 12000),
    draw as (select id, term, (1 + ln(tf)) * idf as w from dt join voc using (term)), qraw as (select q, term, (1 + ln(tf)) * idf as w from qt join voc using (term)),
    weights as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as w from draw),
    qweights as (select q, term, w / sqrt(sum(w * w) over (partition by q)) as w from qraw),
    tsim as (select q, id, sum(a.w * b.w) as t from qweights a join weights b using (term) group by 1, 2)""",
)


@query("tfidf_weights", with_views("weights", "select id, term, round(w, 6) as weight from weights"))
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    counts, fitted = mt.fit_tfidf(people(spark, d), "id", "text")
    return fitted.rows(counts, "id").select("id", "term", F.round("weight", 6).alias("weight"))


@query(
    "tfidf_cosine",
    with_views(
        "weights",
        """select q, id, round(s, 6) as score_tfidf, rank from (select *, row_number() over (partition by q order by round(s, 6) desc, id) as rank from (
          select b.item_id as q, p.id, least(1.0, coalesce(t, 0)) as s from benchmark b cross join people p left join tsim on tsim.q = b.item_id and tsim.id = p.id)) where rank <= 10""",
    ),
)
def tfidf_cosine(spark: SparkSession, d: str) -> DataFrame:
    calls, pool = mt.hybrid_vectors(call_texts(spark, d), people(spark, d).withColumn("bonus", F.lit(0.0)), None)
    top = mt.grid_top_k(calls, pool, 10)
    return top.select("q", "id", F.round("score_tfidf", 6).alias("score_tfidf"), "rank")


_COSINE_SQL = """with v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e from embeddings),
    u as (select id, list_transform(e, lambda x: x / n) as e from (select *, coalesce(nullif(sqrt(list_dot_product(e, e)), 0), 1) as n from v))
    select q, id, round(s, 6) as cosine, rank from (select *, row_number() over (partition by q order by round(s, 6) desc, id) as rank from (
      select a.id as q, b.id, list_dot_product(a.e, b.e) as s from u a join u b on a.id <> b.id)) where rank <= 5"""


def _unit_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    unit = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), mt.l2_normalise(F.col("embedding")).alias("vector"))
    none_t, none_w = F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("array<double>").alias("weights")
    return unit.select(F.col("id").alias("q"), none_t, none_w, "vector"), unit.select("id", none_t, none_w, "vector", F.lit(0.0).alias("bonus"))


@query("vector_cosine", _COSINE_SQL)
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    top = mt.grid_top_k(*_unit_vectors(spark, d), 5, w_vector=1.0, w_terms=0.0, clip=False, skip_same=True)
    return top.select("q", "id", F.round("score_emb", 6).alias("cosine"), "rank")


@query("vector_cosine_pruned", _COSINE_SQL)
def vector_cosine_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same neighbours by bounds over pivots: cells that cannot hold one stay shut."""
    top, _cells = mt.pruned_top_k(*_unit_vectors(spark, d), 5, w_vector=1.0, w_terms=0.0, clip=False, skip_same=True)
    return top.select("q", "id", F.round("score_emb", 6).alias("cosine"), "rank")


@query(
    "profile_bonus",
    with_views("people", "select id, has_cv, category, n_areas, round(bonus, 6) as bonus from people"),
)
def profile_bonus(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("id", "has_cv", "category", "n_areas", F.round("bonus", 6).alias("bonus"))


def ranking(spark: SparkSession, d: str, k: int = 15) -> DataFrame:
    """Hybrid rank of all people for all calls."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    calls, pool = mt.hybrid_vectors(call_texts(spark, d), people(spark, d), vectors)
    return mt.grid_top_k(calls, pool, k)


add_view(
    "hybrid",
    "weights",
    """v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as e from embeddings),
        u as (select id, list_transform(e, lambda x: x / n) as e from (select *, coalesce(nullif(sqrt(list_dot_product(e, e)), 0), 1) as n from v)),
        pairs as (select b.item_id as q, p.id, bonus, a.e is not null as has, coalesce(list_dot_product(a.e, c.e), 0) as emb, coalesce(t, 0) as t from benchmark b cross join people p
          left join u a on a.id = b.item_id left join u c on c.id = p.id left join tsim on tsim.q = b.item_id and tsim.id = p.id),
        raw as (select *, greatest(0, least(1, case when has then 0.85::double * emb + 0.15::double * t else t end)) as raw from pairs),
        fin as (select *, greatest(0, least(1, raw + bonus)) as f from raw),
    hybrid as (select q, id, round(emb, 6) as score_emb, round(t, 6) as score_tfidf, round(raw, 6) as score_raw, round(bonus, 6) as boost, round(f, 6) as score_final, rank
        from (select *, row_number() over (partition by q order by round(f, 6) desc, id) as rank from fin) where rank <= 15)""",
)


@query("hybrid_rank", with_views("hybrid", "select * from hybrid"))
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    r = ranking(spark, d)
    cols = ("score_emb", "score_tfidf", "score_raw", "boost", "score_final")
    return r.select("q", "id", *[F.round(c, 6).alias(c) for c in cols], "rank")


# --- keyword shortlist ----------------------------------------------------

_KW = "list_filter(regexp_extract_all(lower(text), '[a-záéíóúñ]{6,}'), lambda w: w not in ('para','con','del','los','las','que','como','entre','sobre','desde','hacia','este','esta','estos','estas','mediante','dentro'))"
add_view(
    "short",
    "people",
    f"""kq as (select q, w from (select q, w, row_number() over (partition by q order by count(*) desc, w) as r from (select item_id as q, unnest({_KW}) as w from benchmark) group by 1, 2) where r <= 20),
    kd as (select id, unnest(list_distinct({_KW})) as w from people),
    short as (select * from (select q, id, hits, has_cv, category, score, row_number() over (partition by q order by score desc, id) as rank from (
      select q, id, hits, has_cv, category, hits + has_cv::int + coalesce(regexp_matches(lower(category), 'senior|asociado'), false)::int as score
      from (select q, id, count(*) as hits from kq join kd using (w) group by 1, 2) join people using (id))) where rank <= 15)""",
)


def shortlist(spark: SparkSession, d: str) -> DataFrame:
    """Keyword baseline: hits, CV and strong category; people without a hit are out."""
    words = call_texts(spark, d).select("q", F.explode(tx.keywords(F.col("text"))).alias("w"))
    counts = words.groupBy("q", "w").agg(F.count(F.lit(1)).alias("n"))
    best = top_n_per(counts, ["q"], [F.desc("n"), F.asc("w")], 20)
    one = F.lit(None).cast("array<double>").alias("vector")
    packed = best.groupBy("q").agg(F.collect_list("w").alias("terms"))  # twenty words
    asked = call_texts(spark, d).select("q").join(packed, "q", "left")
    asked = asked.select("q", "terms", F.transform("terms", lambda _w: F.lit(1.0)).alias("weights"), one)
    p = people(spark, d)
    strong = F.coalesce(F.lower("category").rlike(mt.STRONG), F.lit(False))
    pool = p.withColumn("terms", F.array_distinct(tx.keywords(F.col("text")))).select(
        "id",
        "terms",
        F.transform("terms", lambda _w: F.lit(1.0)).alias("weights"),
        one,
        (F.col("has_cv").cast("double") + strong.cast("double")).alias("bonus"),
    )
    top = mt.grid_top_k(asked, pool, 15, clip=False, need_overlap=True)
    return top.join(p.select("id", "has_cv", "category"), "id")


@query(
    "keyword_shortlist",
    with_views("short", "select q, id, hits, has_cv, category, score, rank from short"),
)
def keyword_shortlist(spark: SparkSession, d: str) -> DataFrame:
    return shortlist(spark, d).select(
        "q", "id", F.col("score_tfidf").cast("long").alias("hits"), "has_cv", "category", F.col("score_final").cast("long").alias("score"), "rank"
    )


@query(
    "team_coverage",
    with_views(
        "short",
        """select q, count(*) as n_top, bool_or(coalesce(regexp_matches(lower(category), 'senior|asociado'), false)) as has_strong,
          case when bool_or(coalesce(regexp_matches(lower(category), 'senior|asociado'), false)) then 'parcial' else 'insuficiente' end as verdict from short group by 1""",
    ),
)
def team_coverage(spark: SparkSession, d: str) -> DataFrame:
    return mt.coverage_verdict(shortlist(spark, d))


# --- stored rankings ------------------------------------------------------

add_view(
    "stored",
    "",
    f"""stored as (select l_orderkey as q, l_suppkey as id, max(case when l_orderkey % 4 = 0 then 0 else l_discount * 10 end) as score_emb, max(l_tax * 10) as score_tfidf,
      l_suppkey % 3 = 0 as has_cv, {_CAT_SQL}[1 + l_suppkey % 5] as category, l_suppkey % 7 as n_areas, case when l_suppkey % 6 = 0 then '' else 'F' || l_suppkey % 4 end as faculty
      from lineitem group by l_orderkey, l_suppkey),
    rs as (select *, {_BONUS_SQL} as boost, max(score_emb) over (partition by q) > 1e-6 as has from stored),
    rs2 as (select *, greatest(0, least(1, case when has then 0.85::double * score_emb + 0.15::double * score_tfidf else score_tfidf end)) as score_raw from rs),
    rs3 as (select *, round(greatest(0, least(1, score_raw + boost)), 6) as score_final from rs2),
    rescored as (select *, row_number() over (partition by q order by score_final desc, id) as rank from rs3)""",
)


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Stored ranking rows: one per process and supplier, scores from discount and tax."""
    s = F.col("l_suppkey")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("q"), s.alias("id")).agg(
        F.max(F.when(F.col("l_orderkey") % 4 == 0, 0.0).otherwise(F.col("l_discount") * 10)).alias("score_emb"),
        F.max(F.col("l_tax") * 10).alias("score_tfidf"),
    )
    i = F.col("id")
    return rows.select(
        "q", "id", "score_emb", "score_tfidf", (i % 3 == 0).alias("has_cv"), mt.category_of(i % 5, CATEGORIES).alias("category"),
        (i % 7).alias("n_areas"), F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("F"), (i % 4).cast("string"))).alias("faculty"),
    )


@query(
    "rescore",
    with_views("stored", "select q, id, round(score_raw, 6) as score_raw, round(boost, 6) as boost, score_final, rank from rescored"),
)
def rescore(spark: SparkSession, d: str) -> DataFrame:
    r = mt.rescore(stored(spark, d))
    return r.select("q", "id", F.round("score_raw", 6).alias("score_raw"), F.round("boost", 6).alias("boost"), "score_final", "rank")


@query(
    "score_breakdown",
    with_views(
        "stored",
        """, cb as (select *, case when lower(category) like '%emérito%' then 0.18 when lower(category) like '%senior%' then 0.16 when lower(category) like '%asociado%' then 0.13 when lower(category) like '%junior%' then 0.09 else 0.0 end as cat,
          case when n_areas >= 5 then 0.08 when n_areas >= 2 then 0.05 when n_areas >= 1 then 0.03 else 0.0 end as ar from stored),
        f as (select q, id, 'emb' as feature, 'score' as kind, round(0.85::double * score_emb, 4) as contribution from cb union all select q, id, 'tfidf', 'score', round(0.15::double * score_tfidf, 4) from cb
          union all select q, id, 'cvlac', 'boost', 0.12::double from cb where has_cv union all select q, id, 'categoria', 'boost', cat::double from cb where cat > 0
          union all select q, id, 'areas', 'boost', ar::double from cb where ar > 0 union all select q, id, 'facultad', 'contexto', 0.0::double from cb where faculty <> '')
        select *, row_number() over (partition by q, id order by contribution desc, case when kind = 'score' then 0 else 1 end, feature) as pos from f""",
    ),
)
def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return mt.score_breakdown(stored(spark, d))


@query(
    "rank_overlap",
    with_views(
        "stored",
        """, b as (select q, id, row_number() over (partition by q order by score_tfidf desc, id) as rank from stored)
        select a.q, count(b.id) as n_shared from rescored a left join b on b.q = a.q and b.id = a.id and b.rank <= 3 where a.rank <= 3 group by 1""",
    ),
)
def rank_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = stored(spark, d)
    w = Window.partitionBy("q").orderBy(F.desc("score_tfidf"), "id")  # a stored ranking is short
    return mt.rank_overlap(mt.rescore(s), s.withColumn("rank", F.row_number().over(w)))


# --- evidence -------------------------------------------------------------

_EV = r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-záéíóúñ]{{3,}}$'))"
_STOP_SQL = "[" + ",".join(f"'{w}'" for w in mt.EVIDENCE_STOP) + "]"
_RUNS = "regexp_extract_all(lower({c}), '[a-záéíóúñ]{{4,}}')"
add_view(
    "evidence",
    "hybrid",
    f"""epairs as (select h.q, h.id, b.text as ct, d.text as pt from hybrid h join benchmark b on b.item_id = h.q join documents d on d.doc_id = h.id),
    ebare as (select q, id, unnest({_RUNS.format(c='ct')}) as term, generate_subscripts({_RUNS.format(c='ct')}, 1) as pos, {_RUNS.format(c='pt')} as pr from epairs
      where len({_EV.format(c='ct')}) = 0 and len({_EV.format(c='pt')}) = 0),
    eback as (select q, id, term, n as weight, n as call_weight, n as person_weight, row_number() over (partition by q, id order by n desc, pos) as rank from (
      select q, id, term, count(*)::double as n, min(pos) as pos from ebare where list_contains(pr, term) and not list_contains({_STOP_SQL}, term) group by 1, 2, 3)),
    eq as (select q, id, term, 1 + ln(count(*)) as w from (select q, id, {_TERMS} as term from (select q, id, {_EV.format(c='ct')} as w from epairs)) group by 1, 2, 3),
    ed as (select q, id, term, 1 + ln(count(*)) as w from (select q, id, {_TERMS} as term from (select q, id, {_EV.format(c='pt')} as w from epairs)) group by 1, 2, 3),
    ew as (select coalesce(eq.q, ed.q) as q, coalesce(eq.id, ed.id) as id, coalesce(eq.term, ed.term) as term,
      eq.w * case when ed.w is null then ln(1.5::double) + 1 else 1 end as wq, ed.w * case when eq.w is null then ln(1.5::double) + 1 else 1 end as wd from eq full join ed on eq.q = ed.q and eq.id = ed.id and eq.term = ed.term),
    en as (select *, wq / sqrt(sum(wq * wq) over (partition by q, id)) as nq, wd / sqrt(sum(wd * wd) over (partition by q, id)) as nd from ew),
    evidence as (select * from (select q, id, term, round(nq * nd, 5) as weight, round(nq, 5) as call_weight, round(nd, 5) as person_weight,
        row_number() over (partition by q, id order by round(nq * nd, 5) desc, term) as rank
      from en where nq * nd > 0 and not list_has_all({_STOP_SQL}, string_split(term, ' '))) where rank <= 7
      union all select * from eback where rank <= 7)""",
)


def pairs(spark: SparkSession, d: str, ranked: DataFrame) -> DataFrame:
    """The texts of each call and of the people ranked for it."""
    c = call_texts(spark, d).withColumnRenamed("text", "call_text")
    p = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("person_text"))
    return ranked.select("q", "id").join(c, "q").join(p, "id")


@query("term_evidence", with_views("evidence", "select * from evidence"))
def term_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What ties each call to each of the people ranked for it."""
    return mt.term_evidence(cut_lineage(pairs(spark, d, ranking(spark, d))))


def _snippet_sql(text: str) -> str:
    """110 characters around the first hit of a term, or of its first word that occurs."""
    hit = f"(case when contains(lower({text}), term) then term else list_filter(string_split(term, ' '), lambda w: w <> '' and contains(lower({text}), w))[1] end)"
    at = f"instr(lower({text}), {hit})"
    first, last = f"greatest(0, {at} - 37)", f"least(length({text}), {at} - 1 + length({hit}) + 110)"
    return f"""case when {hit} is not null then (case when {first} > 0 then '…' else '' end) || replace(trim(substr({text}, {first} + 1, {last} - {first})), chr(10), ' ')
      || (case when {last} < length({text}) then '…' else '' end) end"""


@query(
    "term_evidence_snippets",
    with_views("evidence", f"select q, id, term, {_snippet_sql('pt')} as in_person, {_snippet_sql('ct')} as in_call from evidence join epairs using (q, id)"),
)
def term_evidence_snippets(spark: SparkSession, d: str) -> DataFrame:
    p = cut_lineage(pairs(spark, d, ranking(spark, d)))
    return mt.term_evidence(p).join(p, ["q", "id"]).select(
        "q", "id", "term", tx.term_snippet(F.col("person_text"), F.col("term")).alias("in_person"),
        tx.term_snippet(F.col("call_text"), F.col("term")).alias("in_call"),
    )


#: Terms of each pair that the graph shows.
GRAPH_TERMS = 6


@query(
    "match_graph",
    with_views(
        "evidence people",
        f""", rk as (select q, p.id, score_final, has_cv, category, n_areas from hybrid h join people p on p.id = h.id),
        sl as (select *, 'term::' || substr(regexp_replace(lower(term), '[^a-z0-9]+', '_', 'g'), 1, 40) as tid from evidence where rank <= {GRAPH_TERMS}),
        cb as (select *, case when lower(category) like '%emérito%' then 0.18 when lower(category) like '%senior%' then 0.16 when lower(category) like '%asociado%' then 0.13 when lower(category) like '%junior%' then 0.09 else 0.0 end as cat,
          case when n_areas >= 5 then 0.08 when n_areas >= 2 then 0.05 when n_areas >= 1 then 0.03 else 0.0 end as ar from rk)
        select q, 'call::' || q as source, cast(id as varchar) as target, 'match' as kind, score_final as score, round(40 + round(greatest(0.05::double, least(1, 1 - score_final)), 4) * 160, 1) as length from rk
        union all select q, 'call::' || q, tid, 'termino_conv', max(weight), round(55 + greatest(0, 0.4::double - max(weight)) * 80, 1) from sl group by q, tid
        union all select q, cast(id as varchar), tid, 'termino_doc', max(weight), round(35 + greatest(0, 0.3::double - max(weight)) * 70, 1) from sl group by q, id, tid
        union all select q, cast(id as varchar), id || '::cvlac', 'aporte', 0.12, 48.0 from cb where has_cv
        union all select q, cast(id as varchar), id || '::categoria', 'aporte', cat, 48.0 from cb where cat > 0
        union all select q, cast(id as varchar), id || '::areas', 'aporte', ar, 48.0 from cb where ar > 0""",
    ),
)
def match_graph(spark: SparkSession, d: str) -> DataFrame:
    """The star of each call: the people ranked for it, what ties them to it, and what adds to their scores."""
    rk = ranking(spark, d).withColumn("score_final", F.round("score_final", 6))
    meta = people(spark, d).select("id", "has_cv", "category", "n_areas", "faculty")
    rk = cut_lineage(rk.join(meta, "id"))
    terms = mt.term_evidence(cut_lineage(pairs(spark, d, rk))).where(F.col("rank") <= GRAPH_TERMS)
    return mt.match_graph_links(rk, terms, mt.score_breakdown(rk))


@query(
    "embedding_cache_split",
    """with t as (select doc_id, substr(sha256('model-a' || chr(10) || text), 1, 16) as key from documents),
    c as (select key from t where doc_id in (select vec_id from embeddings where label % 2 = 0))
    select doc_id, key, key in (select key from c) as cached from t""",
)
def embedding_cache_split(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", tx.content_key("model-a", F.col("text")).alias("key"))
    have = table(spark, d, "embeddings").where(F.col("label") % 2 == 0).select(F.col("vec_id").alias("doc_id"))
    return mt.cache_split(t, t.join(have, "doc_id", "left_semi"), "key").select("doc_id", "key", "cached")
