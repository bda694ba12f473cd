"""Sources, coercion, flags, filters and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tenderscope.functions import dates, text
from tenderscope.operators import cleaning as cl, tables as tb
from tenderscope.plans import inputs as inp
from tenderscope.plans.inputs import table, with_views
from tenderscope.plans.registry import query
from tenderscope.session import scratch_path
from tenderscope.sources import readers


@query(
    "scan_award_lines",
    with_views("awards", "select process_id, supplier_id, value, published_at from awards"),
)
def scan_award_lines(spark: SparkSession, d: str) -> DataFrame:
    return inp.awards(spark, d, "process_id", "supplier_id", "value", "published_at")


@query(
    "monthly_segment_counts",
    with_views(
        "awards",
        f"""select cast(date_trunc('month', published_at) as date) as month, segment, count(*) as n
        from awards where published_at >= timestamp '1995-01-01' and not {inp.implausible_sql()} group by 1, 2""",
    ),
)
def monthly_segment_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.awards(spark, d, "published_at", "segment", "value", "base_price")
    return (
        lines.where((F.col("published_at") >= F.lit("1995-01-01").cast("timestamp_ntz")) & ~inp.implausible())
        .groupBy(F.trunc("published_at", "month").alias("month"), "segment")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def clip_sql(text: str, n: int) -> str:
    """White space collapsed, and an ellipsis in the last place of what is longer than ``n``."""
    flat = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    return f"case when length({flat}) > {n} then substr({flat}, 1, {n - 1}) || '…' else {flat} end"


_PROFILE_SQL = f"""concat_ws(chr(10), 'Docente: Person ' || doc_id || '. Facultad: ' || coalesce(source, '') || '. Cargo: .', 'Áreas: ' || lang,
  case when text <> '' then 'Perfil: ' || {clip_sql("text", 600)} end)"""


@query(
    "load_profiles",
    f"""select id, length(t) as n_chars from (select cast(doc_id as varchar) as id, {clip_sql(_PROFILE_SQL, 3500)} as t from documents) where length(t) >= 40""",
)
def load_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Write the documents as nested profile JSON, then read the folder back."""
    folder = scratch_path(spark, "profiles")
    table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("Person "), F.col("doc_id").cast("string")).alias("nombre"),
        F.col("source").alias("facultad_csv"),
        F.array(F.col("lang")).alias("areas_investigacion"),
        F.col("text").alias("perfil_profesional"),
    ).write.mode("overwrite").json(folder)
    people = readers.load_profiles(spark, folder)
    return people.select("id", F.length("canonical_text").cast("long").alias("n_chars"))


@query(
    "page_links",
    r"""with found as (
      select page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as hrefs,
             regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as titles from pages)
    select page_id, pos - 1 as pos, hrefs[pos] as href, trim(titles[pos]) as title,
           coalesce(nullif(case when page_id % 3 = 0 then '' else cast(page_id as varchar) end, ''),
             nullif(case when regexp_matches(url, '/[a-z]{2}/\d+') then 'node_' || regexp_extract(url, '/[a-z]{2}/(\d+)', 1) else '' end, '')) as call_id
    from found, range(1, len(hrefs) + 1) t(pos) where len(hrefs) >= 5""",
)
def page_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").withColumn(
        "number", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("page_id").cast("string"))
    )
    return readers.page_rows(
        pages, "page_id", "html", "url", "number", id_rules=[(r"/[a-z]{2}/(\d+)", "node_")], min_cells=5
    )


_LISTING_BASE = "https://calls.example.org"


def listings(spark: SparkSession, d: str) -> DataFrame:
    """A listing page made of each page's own links: some rows without number or link, the sixth too short."""
    pattern = F.lit(r'<a href="([^"]*)">([^<]*)</a>')
    links = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("h"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("t"))

    def row(x: Column, i: Column) -> Column:
        n = (F.col("page_id") * 10 + i).cast("string")
        by_link = F.concat(F.lit("<td><a class='t' href=\""), x["h"], F.when(i % 3 == 0, F.concat(F.lit("/node/"), n)).otherwise(""), F.lit('">'), x["t"], F.lit("</a></td>"))
        title = F.when(i % 3 == 2, F.concat(F.lit("<TD>\n <b>"), x["t"], F.lit("</b>"))).otherwise(by_link)
        number = F.concat(F.lit("<td> "), F.when(i % 3 == 0, "").otherwise(n), F.lit(" </td>"))
        rest = F.concat(F.lit("<td>"), F.col("url"), F.lit("<td>$ "), n, F.lit("</td>"), F.when(i == 5, "").otherwise(F.concat(F.lit("<td>day "), i.cast("string"), F.lit("</td>"))))
        return F.concat(F.lit("<tr>"), number, title, rest, F.when(i % 2 == 0, "</tr>").otherwise(""))

    body = F.array_join(F.transform(links, row), "<!-- <tr><td>no row -->")
    head = F.lit("<p>x</p><table id=\"l\"><tr><th>No.</th><th>Title</th></tr>")
    return table(spark, d, "pages").select("page_id", F.concat(head, body, F.lit("</table><table><tr></tr><tr><td>1<td>2<td>3<td>4<td>5</table>")).alias("html"))


@query(
    "listing_rows",
    rf"""with found as (
      select page_id, url as page, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as t from pages),
    r as (select page_id, page, i, page_id * 10 + i as n, h[i + 1] as h, trim(regexp_replace(replace(t[i + 1], '&amp;', '&'), '\s+', ' ', 'g')) as title from found, range(0, len(h)) x(i) where i <> 5),
    u as (select *, case i % 3 when 0 then '{_LISTING_BASE}' || h || '/node/' || n when 1 then '{_LISTING_BASE}' || h end as url from r)
    select case i % 3 when 0 then 'node_' || n else cast(n as varchar) end as number, title, url, replace(page, '&amp;', '&') as description, '$ ' || n as resources, 'day ' || i as opening
    from (select *, row_number() over (partition by url order by page_id, i) as k from u) where k = 1""",
)
def listing_rows(spark: SparkSession, d: str) -> DataFrame:
    return readers.listing_rows(listings(spark, d), "page_id", "html", _LISTING_BASE, text.LISTING_ID_RULES)


@query(
    "upsert_latest",
    f"""select cust as customer, o_orderkey as process_id, load from (
      select o_custkey as cust, o_orderkey, case when o_orderdate < timestamp '{inp.CUT}' then 0 else 1 end as load,
        row_number() over (partition by o_custkey order by case when o_orderdate < timestamp '{inp.CUT}' then 0 else 1 end desc, o_orderkey desc) as rn
      from orders) where rn = 1""",
)
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("process_id"), "o_orderdate"
    )
    cut = F.col("o_orderdate") < F.lit(inp.CUT).cast("timestamp_ntz")
    old = o.where(cut).select("customer", "process_id", F.lit(0).alias("load"))
    new = o.where(~cut).select("customer", "process_id", F.lit(1).alias("load"))
    return tb.upsert_latest(old, new, ["customer"], ["process_id"])


@query(
    "merge_summary",
    f"""with old as (select o_custkey as customer, count(*) as n from orders where o_orderdate < timestamp '{inp.CUT}' group by 1),
    new as (select o_custkey as customer, count(*) as n from orders where o_orderdate >= timestamp '{inp.CUT}' group by 1)
    select coalesce(new.customer, old.customer) as customer, coalesce(new.n, old.n) as n
    from old full join new on old.customer = new.customer""",
)
def merge_summary(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), "o_orderdate")
    cut = F.col("o_orderdate") < F.lit(inp.CUT).cast("timestamp_ntz")
    old = o.where(cut).groupBy("customer").agg(F.count(F.lit(1)).alias("n"))
    new = o.where(~cut).groupBy("customer").agg(F.count(F.lit(1)).alias("n"))
    return tb.merge_over(old, new, ["customer"]).orderBy("customer")


@query(
    "pending_keys",
    "select o_orderkey as process_id from orders where o_orderkey not in (select l_orderkey from lineitem)",
)
def pending_keys(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("process_id"))
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("process_id"))
    return tb.pending_keys(wanted, done, "process_id")


# --- coercion and flags ---------------------------------------------------


@query(
    "coerce_columns",
    """select l_orderkey as process_id, l_linenumber as line_no,
      case when l_linenumber = 4 then null else l_quantity end as amount,
      case when l_linenumber = 3 then null else cast(l_shipdate as timestamp) end as awarded_at from lineitem""",
)
def coerce_columns(spark: SparkSession, d: str) -> DataFrame:
    dirty = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("process_id"),
        F.col("l_linenumber").alias("line_no"),
        F.when(F.col("l_linenumber") == 4, "n/a")
        .otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("long").cast("string"), F.lit(".0")))
        .alias("amount_text"),
        F.when(F.col("l_linenumber") == 3, "sin fecha")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
        .alias("date_text"),
    )
    return dirty.select(
        "process_id",
        "line_no",
        cl.to_number(F.col("amount_text")).alias("amount"),
        cl.to_timestamp(F.col("date_text")).alias("awarded_at"),
    )


#: How the flag of a line is spelt: by its return flag and status, its tax and its quantity (one text for both engines).
_TOKENS_SQL = """case when l_tax > 0.065 then null when l_discount > 0.085 then (case when l_linestatus = 'F' then 'nan' else ' ' end)
  when l_returnflag = 'R' then (case when l_linestatus = 'F' then 'Si' else ' SÍ ' end) when l_returnflag = 'A' then (case when l_linestatus = 'F' then 'No' else 'yes' end)
  when l_quantity > 25 then cast(cast(l_quantity as int) % 3 as varchar(9)) else l_returnflag || l_linestatus end"""


def _flag_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.expr(_TOKENS_SQL).alias("raw"))


@query(
    "bool_tokens",
    f"""select raw, coalesce(lower(trim(raw)) in ('1','true','si','sí','yes'), false) as flag,
      case raw when 'Si' then true when 'No' then false end as si_no, count(*) as n
    from (select {_TOKENS_SQL} as raw from lineitem) group by all""",
)
def bool_tokens(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    return (
        _flag_lines(spark, d)
        .select("raw", cl.flag_strict(raw).alias("flag"), cl.flag_si_no(raw).alias("si_no"))
        .groupBy("raw", "flag", "si_no")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "bool_tokens_lenient",
    f"""select raw, case when raw is null or lower(trim(raw)) in ('', 'nan', 'none') then true
        else lower(trim(raw)) in ('1','true','si','sí','yes') end as flag, count(*) as n
    from (select {_TOKENS_SQL} as raw from lineitem) group by all""",
)
def bool_tokens_lenient(spark: SparkSession, d: str) -> DataFrame:
    return (
        _flag_lines(spark, d)
        .select("raw", cl.flag_lenient(F.col("raw")).alias("flag"))
        .groupBy("raw", "flag")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "implausible_flag",
    with_views("awards", f"select process_id, value, base_price from awards where {inp.implausible_sql()}"),
)
def implausible_flag(spark: SparkSession, d: str) -> DataFrame:
    return inp.awards(spark, d, "process_id", "value", "base_price").where(inp.implausible())


@query(
    "implausible_flag_b",
    with_views(
        "awards",
        f"""select process_id, line_no, value, base from (
          select *, case when line_no = 3 then null else base_price end as base from awards)
        where value > {inp.CAP} or (base is not null and value > {inp.RATIO} * greatest(base, 1))""",
    ),
)
def implausible_flag_b(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.awards(spark, d, "process_id", "line_no", "value", "base_price")
    lines = lines.withColumn("base", F.when(F.col("line_no") != 3, F.col("base_price")))
    flag = cl.implausible(F.col("value"), F.col("base"), rule="base_min_one", cap=inp.CAP, ratio=inp.RATIO)
    return lines.where(flag).select("process_id", "line_no", "value", "base")


_CUTS = (20_000, 40_000, 60_000, 80_000, 100_000)


@query(
    "threshold_ladder",
    with_views(
        "awards",
        """select cast(c as double) as cutoff, count(*) filter (where value > c) as n_above,
          cast(coalesce(sum(value) filter (where value > c), 0) as double) as value_above
        from awards, (values (20000), (40000), (60000), (80000), (100000)) t(c) group by c""",
    ),
)
def threshold_ladder(spark: SparkSession, d: str) -> DataFrame:
    return cl.threshold_ladder(inp.awards(spark, d, "value"), "value", _CUTS)


@query(
    "flag_processes",
    with_views(
        "processes",
        f"""select process_id, hit as by_lines, hit or {inp.implausible_sql(inp.PROCESS_CAP)} as flagged
        from (select *, process_id in (select process_id from awards where {inp.implausible_sql()}) as hit from processes)""",
    ),
)
def flag_processes(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.awards(spark, d, "process_id", "value", "base_price").where(inp.implausible())
    procs = inp.processes(spark, d, "process_id", "value", "base_price")
    return cl.flag_processes(procs, lines, inp.implausible(inp.PROCESS_CAP)).select("process_id", "by_lines", "flagged")


# --- filters --------------------------------------------------------------


@query(
    "awarded_lines",
    with_views("awards", "select process_id, supplier_id, value from awards where awarded and value > 0"),
)
def awarded_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.awards(spark, d, "process_id", "supplier_id", "value", "awarded")
    return cl.awarded_lines(lines).select("process_id", "supplier_id", "value")


@query(
    "competitive_universe",
    with_views(
        "processes",
        """select process_id, method, awarded from processes
        where method in ('1-URGENT','2-HIGH','3-MEDIUM') and published_at is not null""",
    ),
)
def competitive_universe(spark: SparkSession, d: str) -> DataFrame:
    p = inp.processes(spark, d, "process_id", "method", "published_at", "awarded")
    return cl.competitive_universe(p, inp.COMPETITIVE).select("process_id", "method", "awarded")


@query(
    "censor_filter",
    with_views("processes", "select process_id, state, awarded from processes where awarded or state in ('P')"),
)
def censor_filter(spark: SparkSession, d: str) -> DataFrame:
    return cl.censor_filter(inp.processes(spark, d, "process_id", "state", "awarded"), ["P"])


@query(
    "resolved_subset",
    with_views(
        "processes",
        """select process_id, summary, state_text from (select process_id,
          case when state = 'F' then 'Proceso ADJUDICADO' else 'Presentación' end as summary,
          case when state = 'P' then 'Cancelado' else 'Abierto' end as state_text from processes)
        where lower(summary) like '%adjudicado%' or state_text = 'Cancelado'""",
    ),
)
def resolved_subset(spark: SparkSession, d: str) -> DataFrame:
    p = inp.processes(spark, d, "process_id", "state").select(
        "process_id",
        F.when(F.col("state") == "F", "Proceso ADJUDICADO").otherwise("Presentación").alias("summary"),
        F.when(F.col("state") == "P", "Cancelado").otherwise("Abierto").alias("state_text"),
    )
    return cl.resolved_subset(p, "summary", "state_text")


@query(
    "supplier_key",
    """select supplier_id, supplier_name, count(*) as n from (
      select coalesce(case when l_suppkey % 7 = 0 then null else cast(l_suppkey as varchar) end, s_name) as supplier_id,
             coalesce(case when l_suppkey % 3 = 0 then null else s_name end,
                      case when l_suppkey % 7 = 0 then null else cast(l_suppkey as varchar) end) as supplier_name
      from lineitem join supplier on l_suppkey = s_suppkey) group by all""",
)
def supplier_key(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.awards(spark, d, "supplier_id", "supplier_name")
    key = F.col("supplier_id").cast("long")
    tax = F.when(key % 7 != 0, F.col("supplier_id"))
    name = F.when(key % 3 != 0, F.col("supplier_name"))
    return (
        lines.select(
            cl.supplier_key(tax, F.col("supplier_name")).alias("supplier_id"),
            cl.supplier_label(tax, name).alias("supplier_name"),
        )
        .groupBy("supplier_id", "supplier_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "norm_tax_id",
    """select case l_linenumber % 4 when 2 then '' when 3 then 'NIT-' || l_suppkey else cast(l_suppkey as varchar) end as tax_id,
      count(*) as n from lineitem group by 1""",
)
def norm_tax_id(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_suppkey").cast("string")
    raw = (
        F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("00"), k))
        .when(F.col("l_linenumber") % 4 == 1, F.concat(k, F.lit(".0")))
        .when(F.col("l_linenumber") % 4 == 2, F.lit(" nan "))
        .otherwise(F.concat(F.lit("NIT-"), k))
    )
    return (
        table(spark, d, "lineitem")
        .select(cl.norm_tax_id(raw).alias("tax_id"))
        .groupBy("tax_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


_LABELS = {"ECONOMY": "Gestión", "PROMO": "Ingeniería", "SMALL": "Educación"}


@query(
    "segment_mix",
    """select segment, label, n, round(n * 100.0 / sum(n) over (), 6) as pct from (
      select p_type as segment, case p_type when 'ECONOMY' then 'Gestión' when 'PROMO' then 'Ingeniería'
        when 'SMALL' then 'Educación' else p_type end as label, count(*) as n
      from lineitem join part on l_partkey = p_partkey group by all)""",
)
def segment_mix(spark: SparkSession, d: str) -> DataFrame:
    lines = inp.awards(spark, d, "segment").select(
        cl.segment_code(F.concat(F.col("segment"), F.lit(".0"))).alias("segment")
    )
    freq = tb.frequency_table(lines, "segment")
    return freq.withColumn("label", cl.label_of(F.col("segment"), _LABELS))


@query(
    "bucket_tail",
    with_views(
        "processes",
        """, top as (select department from (select department, count(*) as n from processes group by 1 order by n desc, department limit 20))
        select coalesce(t.department, 'OTRO') as bucket, count(*) as n from processes p
        left join top t on p.department = t.department group by 1""",
    ),
)
def bucket_tail(spark: SparkSession, d: str) -> DataFrame:
    p = inp.processes(spark, d, "process_id", "department")
    return cl.bucket_tail(p, "department", 20, "bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mega_contracts",
    with_views("mega", "select process_id, cast(value_real as double) as value_real, is_mega from mega where is_mega"),
)
def mega_contracts(spark: SparkSession, d: str) -> DataFrame:
    return mega_processes(spark, d, "process_id").where("is_mega").select(
        "process_id", F.col("value_real").cast("double").alias("value_real"), "is_mega"
    )


def mega_processes(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Deflated processes with the implausible and mega flags."""
    need = dict.fromkeys([*cols, "published_at", "value", "base_price", "awarded", "n_suppliers"])
    p = inp.processes(spark, d, *need)
    real = cl.deflate(p, "published_at", ["value", "base_price"], inp.price_index(spark, d), inp.BASE_MONTH)
    real = real.withColumn("implausible", inp.implausible(inp.PROCESS_CAP))
    return cl.flag_mega(real, q=inp.MEGA_QUANTILE)


@query(
    "deflate_values",
    with_views(
        "deflated",
        "select process_id, round(factor, 6) as factor, value_real, base_price_real from deflated",
    ),
)
def deflate_values(spark: SparkSession, d: str) -> DataFrame:
    p = inp.processes(spark, d, "process_id", "published_at", "value", "base_price")
    real = cl.deflate(p, "published_at", ["value", "base_price"], inp.price_index(spark, d), inp.BASE_MONTH)
    return real.select("process_id", F.round("factor", 6).alias("factor"), "value_real", "base_price_real")


# --- joins ----------------------------------------------------------------


@query(
    "semi_flagged",
    with_views(
        "awards",
        f"""select o_orderkey as process_id, o_orderstatus as state from orders
        where o_orderkey in (select process_id from awards where {inp.implausible_sql()})""",
    ),
)
def semi_flagged(spark: SparkSession, d: str) -> DataFrame:
    flagged = inp.awards(spark, d, "process_id", "value", "base_price").where(inp.implausible())
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("process_id"), F.col("o_orderstatus").alias("state"))
    return o.join(flagged, "process_id", "left_semi")


@query(
    "orphan_lines",
    f"""select count(*) as n_lines, count(distinct l_orderkey) as n_processes from lineitem
    where l_orderkey not in (select o_orderkey from orders where o_orderdate >= timestamp '{inp.CUT}')""",
)
def orphan_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("process_id"))
    recent = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit(inp.CUT).cast("timestamp_ntz"))
    orphans = tb.pending_keys(lines, recent.select(F.col("o_orderkey").alias("process_id")), "process_id")
    return orphans.agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("process_id").alias("n_processes"))


@query(
    "new_vs_known",
    f"""select distinct o_custkey as customer, case when o_custkey in (
        select o_custkey from orders where o_orderdate < timestamp '{inp.CUT}') then 'known' else 'new' end as status
    from orders where o_orderdate >= timestamp '{inp.CUT}'""",
)
def new_vs_known(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), "o_orderdate")
    cut = F.col("o_orderdate") < F.lit(inp.CUT).cast("timestamp_ntz")
    return tb.new_vs_known(o.where(~cut), o.where(cut), "customer")


@query(
    "prep_window_days",
    """with m as (select o_orderkey as process_id, any_value(o_orderpriority) as title, cast(any_value(o_orderdate) as date) as opens,
        cast(min(l_shipdate) as date) as closes from orders join lineitem on l_orderkey = o_orderkey group by 1)
    select process_id, title, opens, closes, date_diff('day', opens, closes) as days, date_diff('day', opens, closes) <= 35 as short_notice from m""",
)
def prep_window_days(spark: SparkSession, d: str) -> DataFrame:
    """Opening and closing milestones as Spanish text, parsed, pivoted and joined to the listing."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("process_id"), F.col("o_orderpriority").alias("title"), "o_orderdate"
    )
    closing = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("process_id")).agg(
        F.min("l_shipdate").alias("at")
    )
    milestones = (
        o.select("process_id", F.lit("Apertura").alias("activity"), F.col("o_orderdate").alias("at"))
        .unionByName(closing.select("process_id", F.lit("Cierre").alias("activity"), "at"))
        .select("process_id", "activity", text.spanish_date_text(F.col("at")).alias("date_text"))
    )
    wide = (
        milestones.withColumn("day", dates.parse_long_date(F.col("date_text")))
        .groupBy("process_id")
        .pivot("activity", ["Apertura", "Cierre"])
        .agg(F.min("day"))
        .withColumnsRenamed({"Apertura": "opens", "Cierre": "closes"})
        .withColumn("days", F.datediff("closes", "opens").cast("long"))
        .where(F.col("days").isNotNull())
    )
    listing = o.select("process_id", "title")
    return wide.join(listing, "process_id", "left").select(
        "process_id", "title", "opens", "closes", "days", (F.col("days") <= 35).alias("short_notice")
    )


@query(
    "parse_long_date",
    "select o_orderkey as process_id, case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) end as day from orders",
)
def parse_long_date(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    txt = F.when(F.col("o_orderkey") % 5 == 0, "por definir").otherwise(text.spanish_date_text(F.col("o_orderdate")))
    return o.select(F.col("o_orderkey").alias("process_id"), dates.parse_long_date(txt).alias("day"))


_PART_DOCS_SQL = """
docs as (
  select p_brand as call_id, p_type as activity, p_partkey as pos,
         case p_partkey % 3 when 0 then p_name || ' (Editable).' when 1 then upper(p_name) || '.' else p_name end as name,
         'http://docs.example.org/f/' || p_partkey || case p_partkey % 3 when 0 then '.docx' when 1 then '.pdf' else '.PDF' end as url
  from part)"""


def part_docs(spark: SparkSession, d: str) -> DataFrame:
    """Document links derived from the part catalogue."""
    k = F.col("p_partkey")
    kind = k % 3
    return table(spark, d, "part").select(
        F.col("p_brand").alias("call_id"),
        F.col("p_type").alias("activity"),
        k.alias("pos"),
        F.when(kind == 0, F.concat(F.col("p_name"), F.lit(" (Editable).")))
        .when(kind == 1, F.concat(F.upper("p_name"), F.lit(".")))
        .otherwise(F.col("p_name"))
        .alias("name"),
        F.concat(
            F.lit("http://docs.example.org/f/"),
            k.cast("string"),
            F.when(kind == 0, ".docx").when(kind == 1, ".pdf").otherwise(".PDF"),
        ).alias("url"),
    )


@query(
    "merge_doc_formats",
    f"""with {_PART_DOCS_SQL}, k as (select *, pos % 3 = 0 as editable,
        lower(case pos % 3 when 0 then replace(name, ' (Editable).', '') when 1 then rtrim(name, '.') else name end) as dedup from docs)
    select call_id, activity, dedup as dedup_key, arg_min(name, pos) as name, arg_max(url, pos) filter (where not editable) as url_pdf,
      arg_max(url, pos) filter (where editable) as url_editable from k group by 1, 2, 3""",
)
def merge_doc_formats(spark: SparkSession, d: str) -> DataFrame:
    docs = part_docs(spark, d).withColumn("dedup_key", text.document_key(F.col("name")))
    return tb.merge_formats(
        docs, ["call_id", "activity", "dedup_key"], "name", "url", "pos", text.is_editable(F.col("name"), F.col("url"))
    )


@query(
    "expand_urls",
    f"""with {_PART_DOCS_SQL} select pos, name, 'pdf' as format, url from docs where pos % 3 <> 0
    union all select pos, name, 'editable', url from docs where pos % 3 = 0""",
)
def expand_urls(spark: SparkSession, d: str) -> DataFrame:
    docs = part_docs(spark, d)
    edit = text.is_editable(F.col("name"), F.col("url"))
    wide = docs.select(
        "pos", "name", F.when(~edit, F.col("url")).alias("url_pdf"), F.when(edit, F.col("url")).otherwise(" ").alias("url_editable")
    )
    return tb.expand_urls(wide, [("url_pdf", "pdf"), ("url_editable", "editable")], ["pos", "name"])


@query(
    "docs_per_call",
    f"""with {_PART_DOCS_SQL} select call_id, count(*) filter (where activity = 'PROMO') as n_annexes,
      count(distinct name) as n_names, count(*) as n_docs from docs group by 1""",
)
def docs_per_call(spark: SparkSession, d: str) -> DataFrame:
    return part_docs(spark, d).groupBy("call_id").agg(
        F.count_if(F.col("activity") == "PROMO").alias("n_annexes"),
        F.countDistinct("name").alias("n_names"),
        F.count(F.lit(1)).alias("n_docs"),
    )


@query(
    "enrich_left",
    """select s_suppkey as supplier_id, s_name as name, n_name as name_profile, s_acctbal as balance
    from supplier left join nation on s_nationkey = n_nationkey and n_nationkey % 2 = 0""",
)
def enrich_left(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
        F.col("s_nationkey").alias("key"),
    )
    detail = table(spark, d, "nation").where(F.col("n_nationkey") % 2 == 0).select(
        F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")
    )
    return tb.enrich_left(listing, detail, "key", "_profile").select("supplier_id", "name", "name_profile", "balance")


@query(
    "order_by_listing",
    """with listing as (select n_nationkey as k, n_nationkey * 3 % 25 as pos from nation where n_nationkey % 2 = 1)
    select s_suppkey as supplier_id, coalesce(pos, 10000) as list_rank,
      row_number() over (partition by s_nationkey order by s_suppkey) as seq
    from supplier left join listing on s_nationkey = k""",
)
def order_by_listing(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    listing = table(spark, d, "nation").where(n % 2 == 1).select(n.alias("nation"), (n * 3 % 25).alias("pos"))
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("nation"))
    ranked = tb.order_by_listing(sup, listing, "nation", "pos")
    w = Window.partitionBy("nation").orderBy("supplier_id")
    return ranked.select(
        "supplier_id", F.col("list_rank").cast("long").alias("list_rank"), F.row_number().over(w).cast("long").alias("seq")
    ).orderBy("list_rank", "supplier_id")


@query(
    "first_n_calls",
    f"""with {_PART_DOCS_SQL}, firsts as (select call_id from docs group by 1 order by min(pos), call_id limit 5)
    select call_id, pos, name from docs where call_id in (select call_id from firsts)""",
)
def first_n_calls(spark: SparkSession, d: str) -> DataFrame:
    return tb.first_n_keys(part_docs(spark, d), "call_id", [F.col("pos")], 5).select("call_id", "pos", "name")


@query("seeded_sample", "select s_suppkey, s_name from supplier order by md5(s_suppkey || ':42'), s_suppkey limit 20")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return tb.seeded_sample(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 42, 20)
