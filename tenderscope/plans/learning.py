"""Features, encodings, metrics and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderscope.operators import cleaning as cl, learning as ln
from tenderscope.plans import inputs as inp
from tenderscope.plans.inputs import add_view, table, with_views
from tenderscope.plans.registry import query
from tenderscope.session import cut_lineage

NUM = [*ln.NUMERIC, "buyer_te"]

add_view(
    "model_rows",
    "deflated",
    f"""universe as (select * from deflated where method in ('1-URGENT','2-HIGH','3-MEDIUM') and base_price_real > 0),
    topdep as (select department from universe group by 1 order by count(*) desc, department limit 20),
    model_rows as (select u.*, ln(1 + cast(base_price_real as double)) as log_price, month(published_at) as month, year(published_at) as year,
        coalesce(t.department, 'OTRO') as department_group, published_at < timestamp '{inp.CUT}' as is_train,
        case when process_id % 4 = 0 then null else duration end as duration_gap
      from universe u left join topdep t on t.department = u.department)""",
)


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    p = inp.processes(
        spark, d, "process_id", "published_at", "base_price", "method", "buyer", "department", "segment", "duration", "lots", "awarded"
    )
    p = cl.competitive_universe(p, inp.COMPETITIVE)
    p = cl.deflate(p, "published_at", ["base_price"], inp.price_index(spark, d), inp.BASE_MONTH)
    rows = ln.prepare(p).withColumn("y", F.col("awarded").cast("int"))
    rows = rows.withColumn("duration_gap", F.when(F.col("process_id") % 4 != 0, F.col("duration")))
    return ln.temporal_split(rows, "published_at", inp.CUT)


@query(
    "features",
    with_views("model_rows", "select process_id, round(log_price, 6) as log_price, month, year, department_group, duration, lots from model_rows"),
)
def features(spark: SparkSession, d: str) -> DataFrame:
    return model_rows(spark, d).select(
        "process_id", F.round("log_price", 6).alias("log_price"), "month", "year", "department_group", "duration", "lots"
    )


@query(
    "temporal_split",
    with_views(
        "model_rows",
        "select is_train, count(*) as n, round(avg(awarded::int), 6) as rate, min(published_at) as first, max(published_at) as last from model_rows group by 1",
    ),
)
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return model_rows(spark, d).groupBy("is_train").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("y"), 6).alias("rate"),
        F.min("published_at").alias("first"),
        F.max("published_at").alias("last"),
    )


@query(
    "impute_train_median",
    with_views(
        "model_rows",
        """select process_id, coalesce(cast(duration_gap as double), (select quantile_cont(cast(duration_gap as double), 0.5) from model_rows where is_train)) as duration from model_rows""",
    ),
)
def impute_train_median(spark: SparkSession, d: str) -> DataFrame:
    out = ln.impute_train_median(model_rows(spark, d), ["duration_gap"])
    return out.select("process_id", F.col("duration_gap").alias("duration"))


@query(
    "target_encode",
    with_views(
        "model_rows",
        """, mu as (select avg(awarded::int) as m from model_rows where is_train), te as (select buyer, (sum(awarded::int) + 20 * m) / (count(*) + 20) as te from model_rows, mu where is_train group by buyer, m)
        select process_id, round(coalesce(te, m), 6) as buyer_te from model_rows left join te using (buyer), mu""",
    ),
)
def target_encode(spark: SparkSession, d: str) -> DataFrame:
    return ln.target_encode(model_rows(spark, d), "buyer", "y").select("process_id", F.round("buyer_te", 6).alias("buyer_te"))


@query(
    "rule_by_method",
    with_views(
        "model_rows",
        """, mu as (select avg(awarded::int) as m from model_rows where is_train), r as (select method, avg(awarded::int) as p from model_rows where is_train and method <> '1-URGENT' group by 1),
        s as (select awarded::int as y, coalesce(p, m) as prob from model_rows left join r using (method), mu where not is_train)
        select count(*) as n, round(avg((y = (prob >= 0.5)::int)::int), 6) as accuracy,
          round(avg((y = (select arg_min(y, (-n, y)) from (select awarded::int as y, count(*) as n from model_rows where is_train group by 1)))::int), 6) as accuracy_majority from s""",
    ),
)
def rule_by_method(spark: SparkSession, d: str) -> DataFrame:
    rows = model_rows(spark, d)
    # a method missing from training shows the fallback to the overall rate
    rows = rows.withColumn("known", F.when(~(F.col("is_train") & (F.col("method") == "1-URGENT")), F.col("method")))
    rows = ln.rate_by(rows, "known", "y").withColumn("maj", ln.majority(rows, "y"))
    test = rows.where(~F.col("is_train"))
    return test.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("y") == F.col("pred")).cast("double")), 6).alias("accuracy"),
        F.round(F.avg((F.col("y") == F.col("maj")).cast("double")), 6).alias("accuracy_majority"),
    )


@query(
    "standardize",
    with_views(
        "model_rows",
        """, m as (select avg(log_price) as a, stddev_pop(log_price) as b, avg(cast(duration as double)) as c, stddev_pop(cast(duration as double)) as e from model_rows where is_train)
        select process_id, round((log_price - a) / b, 6) as log_price_z, round((duration - c) / e, 6) as duration_z from model_rows, m""",
    ),
)
def standardize(spark: SparkSession, d: str) -> DataFrame:
    out = ln.standardise(model_rows(spark, d), ["log_price", "duration"])
    return out.select("process_id", F.round("log_price_z", 6).alias("log_price_z"), F.round("duration_z", 6).alias("duration_z"))


@query(
    "budget_bins",
    with_views(
        "model_rows",
        """, q as (select quantile_cont(cast(base_price_real as double), 0.25) as a, quantile_cont(cast(base_price_real as double), 0.5) as b, quantile_cont(cast(base_price_real as double), 0.75) as c from model_rows where is_train)
        select is_train, case when base_price_real <= a then 'Q1_bajo' when base_price_real <= b then 'Q2' when base_price_real <= c then 'Q3' else 'Q4_alto' end as budget, count(*) as n from model_rows, q group by 1, 2""",
    ),
)
def budget_bins(spark: SparkSession, d: str) -> DataFrame:
    return ln.budget_bins(model_rows(spark, d), "base_price_real").groupBy("is_train", "budget").agg(F.count(F.lit(1)).alias("n"))


# --- metrics --------------------------------------------------------------

_SCORED_SQL = "s as (select quality as y, (n_chars % 1000) / 1000.0::double as score, ((n_chars % 1000) >= 500)::int as pred, source from labels join documents using (doc_id))"


def scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    s = F.col("n_chars") % 1000
    return table(spark, d, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("y"), (s / 1000.0).alias("score"), (s >= 500).cast("int").alias("pred"), "source"
    )


@query(
    "auc_rank",
    f"""with {_SCORED_SQL}, r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from s)
    select round((sum(rk) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0)
      / (count(*) filter (where y = 1) * count(*) filter (where y = 0)), 6) as auc_roc, count(*) as n from r""",
)
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return ln.auc(scored(spark, d), "y", "score")


@query(
    "avg_precision",
    f"""with {_SCORED_SQL}, g as (select score, sum(y) as p, count(*) as n from s group by 1), c as (select p, sum(p) over w as tp, sum(n) over w as k from g window w as (order by score desc))
    select round(sum(p * (tp / k)) / sum(p), 6) as auc_pr from c""",
)
def avg_precision(spark: SparkSession, d: str) -> DataFrame:
    return ln.average_precision(scored(spark, d), "y", "score")


@query("confusion", f"with {_SCORED_SQL} select y as actual, pred as predicted, count(*) as n from s group by 1, 2")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return ln.confusion(scored(spark, d), "y", "pred")


@query(
    "class_report",
    f"""with {_SCORED_SQL}, c as (select 0 as label union all select 1), t as (select label, count(*) filter (where y = label and pred = label) as tp, count(*) filter (where y = label) as support, count(*) filter (where pred = label) as said from c, s group by 1)
    select label, round(coalesce(tp / nullif(said, 0), 0), 6) as precision, round(coalesce(tp / nullif(support, 0), 0), 6) as recall,
      round(coalesce(2 * (tp / said) * (tp / support) / nullif(tp / said + tp / support, 0), 0), 6) as f1, support from t""",
)
def class_report(spark: SparkSession, d: str) -> DataFrame:
    return ln.class_report(scored(spark, d), "y", "pred")


def _four_classes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select((F.col("quality") + 2 * F.col("toxic")).alias("y"), (F.col("n_chars") % 5).cast("int").alias("pred"))


_FOUR_SQL = """m as (select quality + 2 * toxic as y, cast(n_chars % 5 as int) as pred from labels join documents using (doc_id)),
    k as (select distinct c from (select y as c from m union all select pred from m)),
    v as (select c, count(*) filter (where y = c and pred = c) as tp, count(*) filter (where y = c) as support, count(*) filter (where pred = c) as said from k, m group by 1),
    f as (select *, coalesce(2.0 * tp / nullif(support + said, 0), 0) as f1 from v)"""


@query(
    "f1_summary",
    f"""with {_FOUR_SQL} select round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1, round(sum(tp) / sum(support), 6) as accuracy, count(*) as n_classes from f""",
)
def f1_summary(spark: SparkSession, d: str) -> DataFrame:
    return ln.f1_summary(_four_classes(spark, d), "y", "pred")


@query(
    "class_report_multi",
    f"""with {_FOUR_SQL} select c as label, round(coalesce(tp / nullif(said, 0), 0), 6) as precision, round(coalesce(tp / nullif(support, 0), 0), 6) as recall, round(f1, 6) as f1, support from f""",
)
def class_report_multi(spark: SparkSession, d: str) -> DataFrame:
    """The report of more than two classes, one of them only ever predicted."""
    return ln.class_report(_four_classes(spark, d), "y", "pred")


# --- fits -----------------------------------------------------------------


def encoded(spark: SparkSession, d: str) -> DataFrame:
    """Training table, written once: every fit reads it many times."""
    rows = ln.target_encode(model_rows(spark, d), "buyer", "y")
    rows = ln.balanced_weight(rows, "y")
    keep = ["process_id", "published_at", "y", "weight", "is_train", "segment", "base_price_real", *NUM, *ln.CATEGORICAL]
    return cut_lineage(rows.select(*keep))


def _binary(rows: DataFrame, kind: str, **params: int) -> DataFrame:
    model = ln.fit_binary(rows.where("is_train"), "y", NUM, kind, **params)
    return ln.probability(model.transform(rows.where(~F.col("is_train")))).withColumn("pred", F.col("prediction").cast("int"))


def _metrics(test: DataFrame, name: str) -> DataFrame:
    f1 = ln.class_report(test, "y", "pred").where(F.col("label") == 1).select("f1").scalar()
    out = ln.accuracy(test, "y", "pred").withColumns({"model": F.lit(name), "f1": f1})
    scores = {"auc_roc": ln.auc(test, "y", "prob").select("auc_roc").scalar(), "auc_pr": ln.average_precision(test, "y", "prob").select("auc_pr").scalar()}
    return out.withColumns(scores).select("model", "n", "accuracy", "f1", "auc_roc", "auc_pr")


@query("fit_logistic")
def fit_logistic(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(cut_lineage(_binary(encoded(spark, d), "logistic").select("y", "pred", "prob")), "logistic")


@query("fit_gbt")
def fit_gbt(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(cut_lineage(_binary(encoded(spark, d), "gbt").select("y", "pred", "prob")), "gbt")


@query("model_log")
def model_log(spark: SparkSession, d: str) -> DataFrame:
    rows = encoded(spark, d)
    rule = ln.rate_by(rows, "method", "y").where(~F.col("is_train"))
    fits = {kind: cut_lineage(_binary(rows, kind).select("y", "pred", "prob")) for kind in ("logistic", "gbt")}
    share = ln.majority(rows, "y")
    most = rows.where(~F.col("is_train")).select("y", share.alias("pred"), F.lit(0.5).alias("prob"))
    named = {"majority": cut_lineage(most), "rule_by_method": rule, **fits}
    return ln.model_log([_metrics(test, name) for name, test in named.items()])


def _multiclass(rows: DataFrame, label: str, numeric: list[str]) -> DataFrame:
    train = rows.where("is_train")
    model = ln.fit_multiclass(train, label, numeric)
    test = ln.with_label(model, model.transform(rows.where(~F.col("is_train")))).select(label, "pred")
    maj = ln.majority(rows, label)
    return ln.accuracy(test, label, "pred").withColumn(
        "accuracy_majority", test.agg(F.round(F.avg((F.col(label) == maj).cast("double")), 6)).scalar()
    )


@query("fit_budget")
def fit_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = ln.budget_bins(encoded(spark, d), "base_price_real")
    return _multiclass(cut_lineage(rows), "budget", [c for c in NUM if c != "log_price"])


@query("fit_segment")
def fit_segment(spark: SparkSession, d: str) -> DataFrame:
    return _multiclass(encoded(spark, d), "segment", NUM)


@query("coef_rank")
def coef_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = encoded(spark, d)
    ranked = ln.coefficients(ln.fit_binary(rows.where("is_train"), "y", NUM, "logistic"), NUM)
    return spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(ranked, 1)], "rank int, feature string, coefficient double")


@query("score_bands")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    rows = encoded(spark, d)
    model = ln.fit_binary(rows.where("is_train"), "y", NUM, "logistic")
    known = model.stages[0].labelsArray[1]
    aligned = ln.align_for_scoring(rows.where(~F.col("is_train")), list(known))
    out = ln.probability(model.transform(aligned))
    return out.select("process_id", F.round("prob", 6).alias("prob"), ln.score_band(F.col("prob")).alias("band"))
