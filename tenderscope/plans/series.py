"""Monthly series: forecasts, backtests, shares, decomposition and rank tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tenderscope.functions.dates import month_label
from tenderscope.operators import cleaning as cl, forecast as fc, stats
from tenderscope.plans import inputs as inp
from tenderscope.plans.inputs import table, with_views
from tenderscope.plans.market import LABEL_SQL, monthly
from tenderscope.plans.registry import query
from tenderscope.session import cut_lineage

H = 6
LABEL_OF = LABEL_SQL.replace("(month)", "({c})")

inp.add_view(
    "panel",
    "processes",
    """panel_raw as (select key, month, count(*) as y from (
        select segment as key, cast(date_trunc('month', published_at) as date) as month from processes
        union all select 'ALL', cast(date_trunc('month', published_at) as date) from processes) group by 1, 2),
    panel_marked as (select *, max(month) over (partition by key) as last, count(*) over (partition by key) as n from panel_raw),
    panel_avg as (select *, avg(case when month(month) = month(last) and month <> last then y end) over (partition by key) as peers from panel_marked),
    panel as (select key, month, y from panel_avg where not (month = last and n >= 14 and coalesce(peers > 0 and y < 0.4 * peers, false)))""",
)
inp.add_view(
    "ser",
    "panel",
    """ser as (select key, list(cast(y as double) order by month) as ys, count(*) as n, max(month) as last_month from panel group by 1),
    org as (select key, n as origin, ys, last_month from ser
      union all select key, n - 6 * k, ys[1:n - 6 * k], last_month from ser, range(1, 4) t(k) where n - 6 * k >= 24
      union all select key, n - 6, ys[1:n - 6], last_month from ser where n - 6 < 24 and n - 6 >= 18),
    pos as (select key, origin, i, ys[i] as v, (i - 1) % 12 as p from org, range(1, origin + 1) t(i)),
    fac as (select key, origin, p, avg(v) as a, median(v) as med from pos group by 1, 2, 3),
    ctr as (select key, origin, avg(a) as c from fac group by 1, 2),
    lgs as (select key, i, ln(1 + greatest(ys[i], 0)) as z from ser, range(1, n + 1) t(i)),
    dif as (select *, z - lag(z, 12) over (partition by key order by i) as d from lgs),
    dif2 as (select *, lag(d) over (partition by key order by i) as d1, lag(d, 12) over (partition by key order by i) as d12,
      d - lag(d) over (partition by key order by i) as e from dif),
    dl as (select *, lag(e) over (partition by key order by i) as e1 from dif2),
    cut as (select distinct key, origin as m from org union select key, origin - 6 from org),
    -- four candidates: differences on the month before, twice differenced, their mean, on the season before
    reg as (
      select key, m, 0 as c, coalesce(regr_slope(d, d1), 0) as b, avg(d) - coalesce(regr_slope(d, d1), 0) * avg(d1) as a from cut join dl using (key) where i <= m and d1 is not null group by 1, 2
      union all select key, m, 1, coalesce(regr_slope(e, e1), 0), avg(e) - coalesce(regr_slope(e, e1), 0) * avg(e1) from cut join dl using (key) where i <= m and e1 is not null group by 1, 2
      union all select key, m, 2, 0, avg(d) from cut join dl using (key) where i <= m and d is not null group by 1, 2
      union all select key, m, 3, coalesce(regr_slope(d, d12), 0), avg(d) - coalesce(regr_slope(d, d12), 0) * avg(d12) from cut join dl using (key) where i <= m and d12 is not null group by 1, 2),
    arp as (
      select r.key, r.m, r.c, k, y.z + case r.c when 2 then r.a when 3 then r.a + r.b * y.d
        when 0 then x.d * pow(r.b, k) + r.a * list_sum(list_transform(range(0, k), lambda j: pow(r.b, j)))
        else x.d + list_sum(list_transform(range(1, k + 1), lambda q: x.e * pow(r.b, q) + r.a * list_sum(list_transform(range(0, q), lambda j: pow(r.b, j))))) end as p
      from reg r, range(1, 7) t(k), dl x, dl y where x.key = r.key and x.i = r.m and y.key = r.key and y.i = r.m - 12 + k),
    are as (select p.key, p.m + 6 as origin, p.c, avg((p.p - l.z) * (p.p - l.z)) as e from arp p join lgs l on l.key = p.key and l.i = p.m + p.k group by 1, 2, 3 having count(*) = 6),
    arc as (select key, origin, arg_min(c, (e, c)) as c from are group by 1, 2),
    bas as (select o.*, list_avg(ys[greatest(origin - 11, 1):origin]) as lvl, ys[origin] as lst from org o),
    prd as (select b.key, b.origin, b.last_month, k, lst,
        case when b.origin >= 12 then ys[b.origin - 12 + (k - 1) % 12 + 1] else lst end as naive,
        case when b.origin >= 12 then lvl * (f.a / ctr.c) else lst end as level,
        case when lst <= 0 then lvl * (f.a / ctr.c) else lst * (f.a / fl.a) end as anchored,
        coalesce(f.med, lst) as median,
        case when b.origin >= 30 then greatest(exp(arp.p) - 1, 0) end as ar
      from bas b, range(1, 7) t(k)
      left join fac f on f.key = b.key and f.origin = b.origin and f.p = (b.origin + k - 1) % 12
      left join fac fl on fl.key = b.key and fl.origin = b.origin and fl.p = (b.origin - 1) % 12
      left join ctr on ctr.key = b.key and ctr.origin = b.origin left join arc on arc.key = b.key and arc.origin = b.origin left join (select key, m, k as kk, c, p from arp) arp on arp.key = b.key and arp.m = b.origin and arp.kk = t.k and arp.c = arc.c),
    lng as (
      select key, origin, last_month, k, lst, 'estacional_naive' as model, 0 as pos, naive as pred from prd union all
      select key, origin, last_month, k, lst, 'estacional_nivel', 1, level from prd union all
      select key, origin, last_month, k, lst, 'estacional_anclado', 2, anchored from prd union all
      select key, origin, last_month, k, lst, 'estacional_mediana', 3, median from prd union all
      select key, origin, last_month, k, lst, 'seasonal_ar', 4, ar from prd),
    fut as (select l.*, cast(l.last_month + to_months(cast(k as int)) as date) as month from lng l join ser s on s.key = l.key and s.n = l.origin where pred is not null),
    win as (select l.key, l.model, l.pos, l.origin, avg(abs((t.v - pred) / t.v)) filter (where t.v > 0) * 100 as mape, sqrt(avg((t.v - pred) * (t.v - pred))) as rmse
      from lng l join (select key, i, ys[i] as v from ser, range(1, n + 1) t(i)) t on t.key = l.key and t.i = l.origin + l.k where pred is not null group by 1, 2, 3, 4),
    bt as (select *, row_number() over (partition by key order by mape_median_pct, mape_pct, rmse, pos) as rank from (
      select key, model, pos, round(avg(mape), 2) as mape_pct, round(quantile_cont(mape, 0.5), 2) as mape_median_pct, round(avg(rmse), 1) as rmse, count(*) as n_windows
      from win group by 1, 2, 3)),
    gap as (select key, quantile_cont(g, 0.5) as med from (select key, abs(v - lag(v, 12) over (partition by key order by i)) as g
      from pos join ser using (key) where origin = n) where g is not null group by 1),
    sig as (select s.key, case when s.n >= 24 then med else list_stddev_pop(ys[greatest(n - 11, 1):n]) end as sigma from ser s left join gap using (key)),
    fcb as (select f.*, greatest(pred - 1.64::double * sigma * sqrt(1 + k / 12.0::double), 0) as lo, pred + 1.64::double * sigma * sqrt(1 + k / 12.0::double) as hi
      from fut f join sig using (key))""",
)


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Processes per month for every segment and for the whole market."""
    p = inp.processes(spark, d, "process_id", "segment", "published_at")
    raw = (
        p.select(F.explode(F.array("segment", F.lit("ALL"))).alias("key"), F.trunc("published_at", "month").alias("month"))
        .groupBy("key", "month")
        .agg(F.count(F.lit(1)).alias("y"))
    )
    return cl.drop_incomplete_last(raw, ["key"])


def series(spark: SparkSession, d: str) -> DataFrame:
    return fc.to_series(panel(spark, d), ["key"])


@query("drop_incomplete_month", with_views("panel", "select key, month, y from panel"))
def drop_incomplete_month(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d)


def _model_query(name: str, model: str) -> None:
    sql = with_views("ser", f"select key, k::int as step, month, round(pred, 6) as pred from fut where model = '{model}'")

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = fc.forecast(series(spark, d), ["key"], H, {model: fc.MODELS[model]})
        return out.select("key", "step", "month", F.round("pred", 6).alias("pred"))


_model_query("fc_naive", "estacional_naive")
_model_query("fc_level", "estacional_nivel")
_model_query("fc_anchored", "estacional_anclado")
_model_query("fc_median", "estacional_mediana")
_model_query("fc_seasonal_ar", "seasonal_ar")


inp.add_view(
    "hw",
    "ser",
    f"""hw_in as (select key, origin, list_transform(ys, lambda v: ln(1 + greatest(v, 0))) as z from org where origin >= 24),
    hw(key, origin, z, a, b, g, t, lev, tr, se, err, gaps) as (
      select key, origin, z, a, b, g, 0, list_avg(z[1:12]), (list_avg(z[13:24]) - list_avg(z[1:12])) / 12, list_transform(z[1:12], lambda v: v - list_avg(z[1:12])), 0::double, 0::double
      from hw_in, unnest({list(fc.HW_LEVEL)}::double[]) x(a), unnest({list(fc.HW_TREND)}::double[]) y(b), unnest({list(fc.HW_SEASON)}::double[]) w(g)
      union all
      select key, origin, z, a, b, g, t + 1, nw, b * (nw - lev) + (1 - b) * tr, list_append(se[2:12], g * (v - nw) + (1 - g) * s0),
        err + (v - (lev + tr + s0)) * (v - (lev + tr + s0)), gaps + (v - (lev + tr + s0))
      from (select *, z[t + 1] as v, se[1] as s0, a * (z[t + 1] - se[1]) + (1 - a) * (lev + tr) as nw from hw where t < origin)),
    hw_best as (select *, row_number() over (partition by key, origin order by err, a, b, g) as r from hw where t = origin),
    hwp as (select key, origin, k, lev + k * tr + se[1 + (k - 1) % 12] as p,
        1.64::double * sqrt(greatest(err / origin - (gaps / origin) * (gaps / origin), 0)) * sqrt(1 + k / 12.0::double) as w
      from hw_best, range(1, 7) t(k) where r = 1)""",
)


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@query(
    "fc_holt_winters",
    _recursive(
        with_views(
            "hw",
            """select h.key, k::int as step, cast(last_month + to_months(cast(k as int)) as date) as month, round(greatest(exp(p) - 1, 0), 6) as pred,
              round(greatest(exp(p - w) - 1, 0), 6) as lo, round(greatest(exp(p + w) - 1, 0), 6) as hi from hwp h join ser s on s.key = h.key and s.n = h.origin""",
        )
    ),
)
def fc_holt_winters(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).withColumn("_f", fc.holt_winters(F.col("y"), H))
    path = F.arrays_zip(F.col("_f.pred"), F.col("_f.lo"), F.col("_f.hi"))
    return s.select("key", "last_month", F.posexplode(path).alias("i", "p")).select(
        "key",
        (F.col("i") + 1).alias("step"),
        F.add_months("last_month", F.col("i") + 1).alias("month"),
        *[F.round(f"p.{c}", 6).alias(c) for c in ("pred", "lo", "hi")],
    )


@query(
    "fc_bands",
    with_views(
        "ser",
        """select key, model, k::int as step, round(pred, 6) as pred, round(lo, 6) as lo, round(hi, 6) as hi from fcb""",
    ),
)
def fc_bands(spark: SparkSession, d: str) -> DataFrame:
    out = fc.forecast(series(spark, d), ["key"], H)
    return out.select("key", "model", "step", *[F.round(c, 6).alias(c) for c in ("pred", "lo", "hi")])


@query("backtest", with_views("ser", "select key, model, mape_pct, mape_median_pct, rmse, n_windows, rank from bt"))
def backtest(spark: SparkSession, d: str) -> DataFrame:
    return fc.backtest(series(spark, d), ["key"], H)


@query(
    "backtest_holt_winters",
    _recursive(
        with_views(
            "hw",
            """, race as (select key, origin, k, model, pos, pred from lng union all select key, origin, k, 'holt_winters', 5, greatest(exp(p) - 1, 0) from hwp),
            win6 as (select l.key, l.model, l.pos, l.origin, avg(abs((t.v - pred) / t.v)) filter (where t.v > 0) * 100 as mape, sqrt(avg((t.v - pred) * (t.v - pred))) as rmse
              from race l join (select key, i, ys[i] as v from ser, range(1, n + 1) t(i)) t on t.key = l.key and t.i = l.origin + l.k where pred is not null group by 1, 2, 3, 4),
            bt6 as (select key, model, pos, round(avg(mape), 2) as mape_pct, round(quantile_cont(mape, 0.5), 2) as mape_median_pct, round(avg(rmse), 1) as rmse, count(*) as n_windows from win6 group by 1, 2, 3)
            select key, model, mape_pct, mape_median_pct, rmse, n_windows, row_number() over (partition by key order by mape_median_pct, mape_pct, rmse, pos) as rank from bt6""",
        )
    ),
)
def backtest_holt_winters(spark: SparkSession, d: str) -> DataFrame:
    """The full race of six, with the smoothing model."""
    race = {**fc.MODELS, "holt_winters": lambda y, h: fc.holt_winters(y, h)["pred"]}
    return fc.backtest(series(spark, d), ["key"], H, race)


_SELECT_SQL = """
sel as (select key, 'ranked' as mode, model from bt where rank = 1
  union all select key, 'continuity', arg_min(model, (m + case when jump <= 1 then 0 else 40 end, jump, model)) from (
    select *, bool_or(ok) over (partition by key) as any_ok, row_number() over (partition by key order by jump, m, model) as calm from (
      select *, jump <= 1 and m <= 1.5 * min(m) over (partition by key) as ok from (
        select f.key, f.model, case when lst <= 0 then 0 else abs(pred - lst) / lst end as jump, coalesce(s.m, 999) as m,
            min(s.m) over (partition by f.key) as best, lvl > 0 and (lst < 0.55 * lvl or lst > 1.8 * lvl) as odd
        from (select fut.*, bas.lvl from fut join bas on bas.key = fut.key and bas.origin = fut.origin where k = 1) f
        left join (select key, model, case when mape_median_pct > 0 then mape_median_pct else mape_pct end as m from bt) s on s.key = f.key and s.model = f.model)
      where model <> 'estacional_naive' and not (model = 'estacional_anclado' and (odd or coalesce(m > 1.25 * best, false)))))
  where case when any_ok then ok else calm <= 2 end group by key)"""
inp.add_view("sel", "ser", _SELECT_SQL)


@query("fc_select", with_views("sel", "select key, mode, model from sel"))
def fc_select(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d)
    scores = fc.backtest(s, ["key"], H)
    ranked = fc.select_model(s, scores, ["key"], H).withColumn("mode", F.lit("ranked"))
    smooth = fc.select_model(s, scores, ["key"], H, continuity=True).withColumn("mode", F.lit("continuity"))
    return ranked.unionByName(smooth)


def projection(s: DataFrame) -> DataFrame:
    """Forecast rows of each series' best ranked model."""
    best = fc.select_model(s, fc.backtest(s, ["key"], H), ["key"], H)
    return fc.forecast(s, ["key"], H).join(best, ["key", "model"])


@query(
    "fc_summary",
    with_views(
        "sel",
        f""", proj as (select f.* from fcb f join sel on sel.key = f.key and sel.model = f.model and sel.mode = 'ranked'),
        agg as (select key, arg_min(month, (-pred, month)) as peak, arg_min(month, (pred, month)) as valley, sum(pred) as total from proj group by 1)
        select p.key, month, {LABEL_OF.format(c='month')} as label, 'proyeccion' as kind, round(pred, 6) as value, round(lo, 6) as lo, round(hi, 6) as hi,
          month = peak as is_peak, month = valley as is_valley, round(total, 6) as horizon_total, round(total / 6, 6) as horizon_mean
        from proj p join agg using (key)
        union all select key, month, {LABEL_OF.format(c='month')}, 'observado', y, null, null, null, null, null, null
        from (select *, row_number() over (partition by key order by month desc) as r from panel) where r <= 12""",
    ),
)
def fc_summary(spark: SparkSession, d: str) -> DataFrame:
    proj = cut_lineage(projection(cut_lineage(series(spark, d))))
    agg = proj.groupBy("key").agg(
        F.min(F.struct((-F.col("pred")).alias("v"), "month")).getField("month").alias("peak"),
        F.min(F.struct("pred", "month")).getField("month").alias("valley"),
        F.sum("pred").alias("total"),
    )
    future = proj.join(agg, "key").select(
        "key",
        "month",
        month_label(F.col("month")).alias("label"),
        F.lit("proyeccion").alias("kind"),
        F.round("pred", 6).alias("value"),
        F.round("lo", 6).alias("lo"),
        F.round("hi", 6).alias("hi"),
        (F.col("month") == F.col("peak")).alias("is_peak"),
        (F.col("month") == F.col("valley")).alias("is_valley"),
        F.round("total", 6).alias("horizon_total"),
        F.round(F.col("total") / H, 6).alias("horizon_mean"),
    )
    w = Window.partitionBy("key").orderBy(F.desc("month"))  # one row per month
    past = panel(spark, d).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 12)
    past = past.select(
        "key",
        "month",
        month_label(F.col("month")).alias("label"),
        F.lit("observado").alias("kind"),
        F.col("y").cast("double").alias("value"),
    )
    return future.unionByName(past, allowMissingColumns=True)


@query(
    "outlook",
    with_views(
        "monthly",
        f""", mk as (select *, max(month) over () as last from monthly),
        cut as (select * from mk where not (month = last and coalesce(n_processes < 0.4 * (select avg(n_processes) from mk where month(month) = month(last) and month <> last), false))),
        lvl as (select avg(n_processes) as n, avg(cast(value_no_mega as double)) as v, max(month) as last from (select * from cut order by month desc limit 12)),
        fac as (select month(month) as cm, avg(n_processes) as fn, avg(cast(value_no_mega as double)) as fv from monthly group by 1),
        f2 as (select cm, fn / avg(fn) over () as fn, fv / avg(fv) over () as fv from fac),
        fut as (select cast(last + to_months(cast(k as int)) as date) as month, n, v from lvl, range(1, 7) t(k))
        select fut.month, {LABEL_OF.format(c='fut.month')} as label, round_even(n * coalesce(fn, 1), 0)::bigint as n_estimate, round(v * coalesce(fv, 1), 2) as value_estimate,
          p.n_processes as n_year_before, cast(p.value_no_mega as double) as value_year_before
        from fut left join f2 on cm = month(fut.month) left join cut p on p.month = cast(fut.month - to_months(12) as date)""",
    ),
)
def outlook(spark: SparkSession, d: str) -> DataFrame:
    """Seasonal month factors times the recent level, with last year's month beside it."""
    full = monthly(spark, d).select(
        F.lit("ALL").alias("key"), "month", "n_processes", F.col("value_no_mega").cast("double").alias("value")
    )
    return _outlook(full)


def _outlook(full: DataFrame) -> DataFrame:
    cut = cl.drop_incomplete_last(full, ["key"], value="n_processes", min_points=1)
    w = Window.partitionBy("key").orderBy(F.desc("month"))  # one row per month
    lvl = (
        cut.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 12)
        .groupBy("key").agg(F.avg("n_processes").alias("n"), F.avg("value").alias("v"), F.max("month").alias("last"))
    )
    fac = full.groupBy("key", F.month("month").alias("cm")).agg(F.avg("n_processes").alias("fn"), F.avg("value").alias("fv"))
    k = Window.partitionBy("key")  # twelve rows
    fac = fac.withColumns({"fn": F.col("fn") / F.avg("fn").over(k), "fv": F.col("fv") / F.avg("fv").over(k)})
    fut = lvl.select("key", "n", "v", F.explode(F.sequence(F.lit(1), F.lit(H))).alias("step"), "last")
    fut = fut.withColumn("month", F.add_months("last", F.col("step"))).withColumn("cm", F.month("month"))
    before = cut.select(
        "key", F.add_months("month", 12).alias("month"), F.col("n_processes").alias("n_year_before"), F.col("value").alias("value_year_before")
    )
    return fut.join(fac, ["key", "cm"], "left").join(before, ["key", "month"], "left").select(
        "month",
        month_label(F.col("month")).alias("label"),
        F.bround(F.col("n") * F.coalesce("fn", F.lit(1.0))).cast("long").alias("n_estimate"),
        F.round(F.col("v") * F.coalesce("fv", F.lit(1.0)), 2).alias("value_estimate"),
        "n_year_before",
        "value_year_before",
    )


@query(
    "yoy_lookup",
    with_views(
        "panel",
        "select a.key, a.month, a.y, b.y as y_year_before from panel a left join panel b on a.key = b.key and b.month = cast(a.month - to_months(12) as date)",
    ),
)
def yoy_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    before = p.select("key", F.add_months("month", 12).alias("month"), F.col("y").alias("y_year_before"))
    return p.join(before, ["key", "month"], "left")


# --- shares by segment ----------------------------------------------------

inp.add_view(
    "pan",
    "panel",
    """segs as (select key as segment, month, y from panel where key <> 'ALL'),
    pan as (select s.segment, s.month, s.y, t.y as total from segs s join panel t on t.key = 'ALL' and t.month = s.month
      where s.month in (select month from segs group by 1 having count(*) = (select count(distinct segment) from segs))),
    sh0 as (select *, y / total as raw from pan),
    sh as (select segment, month, y, total, raw / sum(raw) over (partition by month) as share, dense_rank() over (order by month) as i from sh0),
    cuts as (select max(i) as origin from sh union all select max(i) - 6 * k from sh, range(1, 4) t(k) group by k having max(i) - 6 * k >= 24),
    tr as (select origin, sh.* from sh join cuts on i <= origin),
    rec as (select origin, segment, avg(share) as r, max(month) as last from tr where i > origin - 12 group by 1, 2),
    sea as (select origin, segment, month(month) as cm, quantile_cont(share, 0.5) as s from tr group by 1, 2, 3),
    g as (select rec.*, k, cast(last + to_months(cast(k as int)) as date) as month, coalesce(s, r) as s from rec, range(1, 7) t(k)
      left join sea on sea.origin = rec.origin and sea.segment = rec.segment and sea.cm = month(cast(last + to_months(cast(k as int)) as date))),
    u as (select origin, segment, k, month, r / sum(r) over (partition by origin, k) as r, s / sum(s) over (partition by origin, k) as s from g),
    b as (select *, (0.7::double * s + 0.3::double * r) / sum(0.7::double * s + 0.3::double * r) over (partition by origin, k) as bl from u),
    paths as (select origin, segment, k, month, 'topdown_blend' as method, bl as share from b union all select origin, segment, k, month, 'topdown_estacional', s from b
      union all select origin, segment, k, month, 'topdown_reciente', r from b)""",
)


def segment_panel_long(spark: SparkSession, d: str) -> DataFrame:
    return panel_shares(cut_lineage(panel(spark, d)))


def panel_shares(p: DataFrame) -> DataFrame:
    """Segment counts and shares for the months present in every segment and in the total."""
    seg = p.where(F.col("key") != "ALL").select(F.col("key").alias("segment"), "month", "y")
    tot = p.where(F.col("key") == "ALL").select("month", F.col("y").alias("total"))
    n = seg.select("segment").distinct().agg(F.count(F.lit(1))).scalar()
    month = Window.partitionBy("month")  # one row per segment
    full = seg.join(tot, "month").withColumn("_n", F.count(F.lit(1)).over(month)).where(F.col("_n") == n).drop("_n")
    share = F.when(F.col("total") > 0, F.col("y") / F.col("total"))
    bad = F.max(F.when(share.isNull(), 1).otherwise(0)).over(month) == 1
    raw = full.withColumn("_raw", F.when(bad, F.lit(1.0)).otherwise(share))
    return raw.withColumn("share", F.col("_raw") / F.sum("_raw").over(month)).drop("_raw")


@query(
    "segment_panel",
    with_views(
        "pan",
        "select month, any_value(total) as total, "
        + ", ".join(f"max(y) filter (where segment = '{s}') as {s.lower()}" for s in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
        + " from pan group by 1",
    ),
)
def segment_panel(spark: SparkSession, d: str) -> DataFrame:
    long = cut_lineage(segment_panel_long(spark, d))
    names = [r["segment"] for r in long.select("segment").distinct().orderBy("segment").collect()]  # one row for each segment
    wide = long.groupBy("month", "total").pivot("segment", names).agg(F.max("y"))
    return wide.select("month", "total", *[F.col(n).alias(n.lower()) for n in names]).dropna()


@query(
    "share_forecast",
    with_views(
        "pan",
        """select segment, method, k::int as step, round(share, 6) as share from paths where origin = (select max(origin) from cuts)""",
    ),
)
def share_forecast(spark: SparkSession, d: str) -> DataFrame:
    out = fc.share_paths(segment_panel_long(spark, d).select("segment", "month", "share"), [], "segment", H)
    return out.withColumn("share", F.round("share", 6))


def _topdown_errors(long: DataFrame) -> DataFrame:
    """Error per origin, segment and method: total x share, and each segment alone."""
    w = Window.partitionBy("segment").orderBy("month")  # one row per month
    long = long.withColumn("i", F.row_number().over(w))
    long = long.withColumn("n", F.max("i").over(Window.partitionBy("segment")))
    ends = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.col("n") - H * k)
    cut = long.withColumn("origin", F.explode(F.filter(ends, lambda e: e >= 24)))
    train = cut.where(F.col("i") <= F.col("origin"))
    shares = fc.share_paths(train.select("origin", "segment", "month", "share"), ["origin"], "segment", H)
    total = fc.to_series(train.select("origin", "month", "total").distinct(), ["origin"], value="total")
    total = total.select("origin", F.posexplode(fc.naive(F.col("y"), H)).alias("step", "total_pred")).withColumn("step", F.col("step") + 1)
    alone = fc.to_series(train.select("origin", "segment", "month", "y"), ["origin", "segment"])
    alone = alone.select(
        "origin", "segment", F.lit("independiente").alias("method"), F.posexplode(fc.seasonal_median(F.col("y"), H)).alias("step", "pred")
    ).withColumn("step", F.col("step") + 1)
    down = shares.join(total, ["origin", "step"]).select(
        "origin", "segment", "method", "step", (F.col("total_pred") * F.col("share")).alias("pred")
    )
    test = cut.select("origin", "segment", (F.col("i") - F.col("origin")).alias("step"), F.col("y").cast("double").alias("actual")).where(
        F.col("step").between(1, H)
    )
    a, p = F.col("actual"), F.col("pred")
    return down.unionByName(alone).join(test, ["origin", "segment", "step"]).groupBy("origin", "segment", "method").agg(
        (F.avg(F.when(a > 0, F.abs((a - p) / a))) * 100.0).alias("mape")
    )


def topdown_scores(long: DataFrame) -> DataFrame:
    per = _topdown_errors(long).groupBy("segment", "method").agg(
        F.percentile("mape", 0.5).alias("_med"), F.avg("mape").alias("_avg")  # three windows
    )
    every = per.groupBy("method").agg(F.avg("_med").alias("_med"), F.avg("_avg").alias("_avg")).withColumn("segment", F.lit("*"))
    return per.unionByName(every).select(
        "segment", "method", F.round("_med", 2).alias("mape_median_pct"), F.round("_avg", 2).alias("mape_pct")
    )


inp.add_view(
    "tds",
    "pan",
    """totals as (select distinct month, total, i from sh),
    tp as (select origin, k, (select total from totals where i = origin - 12 + (k - 1) % 12 + 1) as total_pred from cuts, range(1, 7) t(k)),
    alone as (select tr.origin, segment, k, median(y) as pred from tr, range(1, 7) t(k) where (tr.i - 1) % 12 = (tr.origin + k - 1) % 12 group by 1, 2, 3),
    allp as (select p.origin, segment, p.k, method, total_pred * share as pred from paths p join tp on tp.origin = p.origin and tp.k = p.k
      union all select origin, segment, k, 'independiente', pred from alone),
    errs as (select a.origin, a.segment, method, avg(abs((sh.y - pred) / sh.y)) * 100 as mape from allp a join sh on sh.segment = a.segment and sh.i = a.origin + a.k group by 1, 2, 3),
    per as (select segment, method, quantile_cont(mape, 0.5) as med, avg(mape) as av from errs group by 1, 2),
    tds as (select segment, method, round(med, 2) as mape_median_pct, round(av, 2) as mape_pct from per
      union all select '*', method, round(avg(med), 2), round(avg(av), 2) from per group by method)""",
)


@query("topdown_backtest", with_views("tds", "select * from tds"))
def topdown_backtest(spark: SparkSession, d: str) -> DataFrame:
    return topdown_scores(cut_lineage(segment_panel_long(spark, d)))


def choose_topdown(scores: DataFrame) -> Column:
    """Best method overall; the independent series must win by more than a tenth."""
    overall = scores.where(F.col("segment") == "*")
    down = overall.where(F.col("method") != "independiente")
    best = down.agg(F.min(F.struct("mape_median_pct", "method"))).scalar()
    alone = overall.where(F.col("method") == "independiente").agg(F.min("mape_median_pct")).scalar()
    return F.when(alone < 0.9 * best["mape_median_pct"], F.lit("independiente")).otherwise(best["method"])


@query(
    "topdown_forecast",
    with_views(
        "sel tds",
        """, proj as (select f.k, f.pred, f.lo, f.hi from fcb f join sel on sel.key = f.key and sel.model = f.model and sel.mode = 'ranked' where f.key = 'ALL'),
        best as (select arg_min(method, (mape_median_pct, method)) as m, min(mape_median_pct) as e from tds where segment = '*' and method <> 'independiente'),
        pick as (select case when (select mape_median_pct from tds where segment = '*' and method = 'independiente') < 0.9 * e then 'independiente' else m end as method, m from best)
        select p.segment, pick.method, p.k::int as step, p.month, round(proj.pred * share, 6) as pred, round(proj.lo * share, 6) as lo, round(proj.hi * share, 6) as hi, round(share, 6) as share
        from paths p join pick on p.method = pick.m join proj on proj.k = p.k where p.origin = (select max(origin) from cuts) and pick.method <> 'independiente'
        union all select f.key, 'independiente', f.k::int, f.month, round(f.pred, 6), round(f.lo, 6), round(f.hi, 6), null
        from fcb f join sel on sel.key = f.key and sel.model = f.model and sel.mode = 'ranked' where f.key <> 'ALL' and (select method from pick) = 'independiente'""",
    ),
)
def topdown_forecast(spark: SparkSession, d: str) -> DataFrame:
    p = cut_lineage(panel(spark, d))  # segments x months: everything below reads it many times
    proj = cut_lineage(projection(cut_lineage(fc.to_series(p, ["key"]))))
    long = cut_lineage(panel_shares(p))
    choice = choose_topdown(cut_lineage(topdown_scores(long)))
    shares = fc.share_paths(long.select("segment", "month", "share"), [], "segment", H)
    total = proj.where(F.col("key") == "ALL").select("step", "month", "pred", "lo", "hi")
    down = shares.where(F.col("method") == choice).join(total, "step").select(
        "segment",
        "method",
        "step",
        "month",
        *[F.round(F.col(c) * F.col("share"), 6).alias(c) for c in ("pred", "lo", "hi")],
        F.round("share", 6).alias("share"),
    )
    alone = proj.where((F.col("key") != "ALL") & (choice == "independiente")).select(
        F.col("key").alias("segment"),
        F.lit("independiente").alias("method"),
        "step",
        "month",
        *[F.round(c, 6).alias(c) for c in ("pred", "lo", "hi")],
        F.lit(None).cast("double").alias("share"),
    )
    return down.unionByName(alone)


# --- statistics -----------------------------------------------------------


@query(
    "fill_months",
    with_views(
        "panel",
        """, kept as (select * from panel where (year(month) * 12 + month(month)) % 5 <> 0),
        grid as (select key, cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as month from kept group by 1),
        j as (select g.key, g.month, k.y, year(g.month) * 12 + month(g.month) as i from grid g left join kept k on k.key = g.key and k.month = g.month),
        p as (select *, last_value(case when y is not null then {'i': i, 'v': y} end ignore nulls) over (partition by key order by month rows between unbounded preceding and current row) as a,
          first_value(case when y is not null then {'i': i, 'v': y} end ignore nulls) over (partition by key order by month rows between current row and unbounded following) as z from j)
        select key, month, y is null as filled, round(coalesce(cast(y as double), a.v + (z.v - a.v) / cast(z.i - a.i as double) * (i - a.i)), 6) as y from p""",
    ),
)
def fill_months(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).where((F.year("month") * 12 + F.month("month")) % 5 != 0)
    return stats.fill_months(p, ["key"]).withColumn("y", F.round("y", 6))


inp.add_view(
    "parts",
    "panel",
    """dt as (select key, month, cast(y as double) as y, case when count(*) over w13 = 13 then
        (sum(y) over (partition by key order by month rows between 5 preceding and 5 following) + 0.5 * lag(y, 6) over (partition by key order by month)
         + 0.5 * lead(y, 6) over (partition by key order by month)) / 12.0::double end as trend from panel window w13 as (partition by key order by month rows between 6 preceding and 6 following)),
    eff as (select key, month(month) as cm, avg(y - trend) as e from dt group by 1, 2),
    parts as (select dt.*, s as seasonal, y - trend - s as residual from dt join (select key, cm, e - avg(e) over (partition by key) as s from eff) x on x.key = dt.key and x.cm = month(dt.month))""",
)


@query(
    "decompose",
    with_views("parts", "select key, month, y, round(trend, 6) as trend, round(seasonal, 6) as seasonal, round(residual, 6) as residual from parts"),
)
def decompose(spark: SparkSession, d: str) -> DataFrame:
    out = stats.decompose(panel(spark, d), ["key"])
    return out.select("key", "month", "y", *[F.round(c, 6).alias(c) for c in ("trend", "seasonal", "residual")])


@query(
    "strengths",
    with_views(
        "parts",
        """select key, round(greatest(0, 1 - var_samp(residual) / var_samp(seasonal + residual)), 6) as seasonal_strength,
          round(greatest(0, 1 - var_samp(residual) / var_samp(trend + residual)), 6) as trend_strength from parts where residual is not null group by 1""",
    ),
)
def strengths(spark: SparkSession, d: str) -> DataFrame:
    return stats.strengths(stats.decompose(panel(spark, d), ["key"]), ["key"])


_KW_SQL = """with daily as (select cast(o_orderdate as date) as day, count(*) as n from orders where year(o_orderdate) between 1996 and 1999 group by 1),
    r as (select month(day) as m, n, rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0 as rk from daily),
    t as (select sum(c * c * c - c) as ties from (select count(*) as c from daily group by n)),
    g as (select m, sum(rk) as s, count(*) as c from r group by 1), z as (select cast(sum(c) as double) as n, sum(s * s / c) as q, count(*) - 1 as df from g)
    select round((12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) as h, df, n::bigint as n from z, t"""


def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.year("o_orderdate").between(1996, 1999))
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.month("day"))


@query("kruskal_wallis", _KW_SQL)
def kruskal_wallis(spark: SparkSession, d: str) -> DataFrame:
    return stats.kruskal_wallis(daily_counts(spark, d), "m", "n").withColumn("h", F.round("h", 6))


@query("kruskal_wallis_p")
def kruskal_wallis_p(spark: SparkSession, d: str) -> DataFrame:
    return stats.kruskal_wallis(daily_counts(spark, d), "m", "n").withColumn("p_value", stats.chi2_tail("h", "df"))


@query(
    "spearman_target",
    with_views(
        "processes",
        """, x as (select 'base_price' as feature, cast(base_price as double) as x, awarded::int as y from processes
          union all select 'duration', duration, awarded::int from processes union all select 'lots', lots, awarded::int from processes),
        r as (select feature, rank() over (partition by feature order by x) + (count(*) over (partition by feature, x) - 1) / 2.0 as rx,
          rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0 as ry from x)
        select feature, round(corr(rx, ry), 6) as rho, count(*) as n from r group by 1""",
    ),
)
def spearman_target(spark: SparkSession, d: str) -> DataFrame:
    p = inp.processes(spark, d, "process_id", "base_price", "duration", "lots", "awarded")
    p = p.withColumn("y", F.col("awarded").cast("int"))
    parts = [stats.spearman(p, c, "y").withColumn("feature", F.lit(c)) for c in ("base_price", "duration", "lots")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "spearman_years",
    """with prof as (select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n from orders where year(o_orderdate) in (1998, 1999, 2000) group by 1, 2),
    r as (select y, m, rank() over (partition by y order by n) + (count(*) over (partition by y, n) - 1) / 2.0 as rk from prof)
    select a.y as year_a, b.y as year_b, round(corr(a.rk, b.rk), 6) as rho from r a join r b on a.m = b.m and a.y < b.y group by 1, 2""",
)
def spearman_years(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the month profiles of every pair of years."""
    o = table(spark, d, "orders").where(F.year("o_orderdate").isin(1998, 1999, 2000))
    prof = o.groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("y")  # twelve rows per year
    ranked = prof.withColumn(
        "rk", F.rank().over(w.orderBy("n")) + (F.count(F.lit(1)).over(Window.partitionBy("y", "n")) - 1) / 2.0
    )
    a = ranked.select(F.col("y").alias("year_a"), "m", F.col("rk").alias("ra"))
    b = ranked.select(F.col("y").alias("year_b"), "m", F.col("rk").alias("rb"))
    pairs = a.join(b, "m").where(F.col("year_a") < F.col("year_b"))  # twelve months x pairs of years
    return pairs.groupBy("year_a", "year_b").agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))
