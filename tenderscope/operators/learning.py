"""Features without leakage, encodings, metrics and model fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from tenderscope.operators import boosting
from tenderscope.operators.cleaning import bucket_tail
from tenderscope.operators.ranks import exact_percentiles, running_totals

NUMERIC = ("log_price", "duration", "lots", "month", "year")
CATEGORICAL = ("method", "department_group")


def prepare(processes: DataFrame, price: str = "base_price_real", departments: int = 20) -> DataFrame:
    """Model rows: positive price, log amount, calendar parts, grouped department, named buyer."""
    rows = processes.where(F.coalesce(F.col(price) > 0, F.lit(False)))
    rows = rows.withColumns(
        {
            "log_price": F.log1p(F.col(price).cast("double")),
            "month": F.month("published_at"),
            "year": F.year("published_at"),
            "buyer": F.coalesce("buyer", F.lit("SIN_ENTIDAD")),
        }
    )
    return bucket_tail(rows, "department", departments, "department_group")


def temporal_split(df: DataFrame, date: str, cut: str) -> DataFrame:
    """Mark rows before the cut as training; a null date belongs to neither side."""
    at = F.lit(cut).cast("timestamp_ntz")
    return df.where(F.col(date).isNotNull()).withColumn("is_train", F.col(date) < at)


def impute_train_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians of the training rows fill gaps on both sides."""
    # all columns in one pass: a row for each column and value
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.where("is_train").select(F.inline(pairs))
    medians = exact_percentiles(long, "x", {"m": 0.5}, ["column"])
    # a row for each column
    found = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "m")))).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.try_element_at(found, F.lit(c))) for c in columns})


def target_encode(df: DataFrame, key: str, y: str, alpha: float = 20.0, out: str = "buyer_te") -> DataFrame:
    """Smoothed rate per key from training rows; unseen keys get the overall rate.

    The lookup has a row per key, unbounded, so Spark picks the join by size.
    """
    train = df.where("is_train")
    mu = train.agg(F.avg(F.col(y).cast("double"))).scalar()
    te = train.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(
        F.sum(F.col(y).cast("double")).alias("_s"), F.count(F.lit(1)).alias("_c")
    )
    te = te.withColumn(out, (F.col("_s") + alpha * mu) / (F.col("_c") + alpha)).drop("_s", "_c")
    return df.join(te, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(out, F.coalesce(out, mu))


def rate_by(df: DataFrame, key: str, y: str) -> DataFrame:
    """Historical rate per key, learnt on training rows; prediction at one half."""
    return target_encode(df, key, y, alpha=0.0, out="prob").withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


def majority(df: DataFrame, y: str) -> Column:
    """Most frequent training class, smallest on a tie."""
    return df.where("is_train").groupBy(y).agg(F.count(F.lit(1)).alias("n")).agg(F.min_by(y, F.struct(-F.col("n"), F.col(y)))).scalar()


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation, measured on training rows."""
    measures = [F.struct(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd")).alias(c) for c in columns for x in (F.col(c).cast("double"),)]
    fit = df.where("is_train").agg(F.struct(*measures)).scalar()  # all columns in one pass
    return df.withColumns(
        {f"{c}_z": (F.col(c).cast("double") - fit[c]["mu"]) / F.when(fit[c]["sd"] == 0, 1.0).otherwise(fit[c]["sd"]) for c in columns}
    )


def budget_bins(df: DataFrame, price: str) -> DataFrame:
    """Four right-closed ranges cut at the training quartiles."""
    q = exact_percentiles(df.where("is_train"), price, {"a": 0.25, "b": 0.5, "c": 0.75})
    cuts = q.select(F.struct("a", "b", "c")).scalar()
    a, b, c = (cuts[x] for x in ("a", "b", "c"))
    p = F.col(price).cast("double")
    return df.withColumn("budget", F.when(p <= a, "Q1_bajo").when(p <= b, "Q2").when(p <= c, "Q3").otherwise("Q4_alto"))


# --- metrics --------------------------------------------------------------


def _by_score(df: DataFrame, y: str, score: str, keys: Sequence[str]) -> DataFrame:
    yes = F.col(y).cast("int")
    return df.groupBy(*keys, F.col(score).cast("double").alias("s")).agg(
        F.sum(yes).alias("pos"), F.sum(1 - yes).alias("neg")
    )


def auc(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from counts per distinct score; ties count one half."""
    run = running_totals(_by_score(df, y, score, keys), "s", [], {"below": "neg"}, keys, descending=False, grouped=True)
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0))
    total = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return run.groupBy(*keys).agg(F.round(F.try_divide(wins, total), 6).alias("auc_roc"), F.sum(F.col("pos") + F.col("neg")).alias("n"))


def average_precision(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of precision at each distinct score weighted by the recall it adds."""
    run = running_totals(_by_score(df, y, score, keys), "s", [], {"tp": "pos", "fp": "neg"}, keys, grouped=True)
    gain = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return run.groupBy(*keys).agg(F.round(F.try_divide(gain, F.sum("pos").cast("double")), 6).alias("auc_pr"))


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _class_scores(df: DataFrame, y: str, pred: str) -> DataFrame:
    cells = confusion(df, y, pred)  # classes squared
    rows = F.array(F.struct(F.col("actual").alias("c"), F.lit(1).alias("a")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("a")))
    flat = cells.select(F.inline(rows), "n", (F.col("actual") == F.col("predicted")).alias("hit"))
    tot = flat.groupBy(F.col("c").alias("label")).agg(
        F.sum(F.when(F.col("hit") & (F.col("a") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("a") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("a") == 0, F.col("n")).otherwise(0)).alias("said"),
    )
    p, r = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return tot.select("label", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support", "tp")


def class_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    return _class_scores(df, y, pred).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def f1_summary(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Macro F1 (classes count alike, those only predicted too), F1 weighted by support, and accuracy."""
    return _class_scores(df, y, pred).agg(
        F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 6).alias("weighted_f1"),
        F.round(F.try_divide(F.sum("tp"), F.sum("support")), 6).alias("accuracy"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def accuracy(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(F.round(F.avg((F.col(y) == F.col(pred)).cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


# --- fits -----------------------------------------------------------------


def balanced_weight(df: DataFrame, y: str) -> DataFrame:
    """Column ``weight`` = n / (2 n_class) from training rows."""
    train = df.where("is_train")
    n = train.agg(F.count(F.lit(1))).scalar().cast("double")
    pos = train.agg(F.sum(F.col(y).cast("double"))).scalar()
    return df.withColumn("weight", F.when(F.col(y).cast("int") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))


def feature_stages(numeric: Sequence[str], categorical: Sequence[str] = CATEGORICAL) -> list:
    """Indexed and one-hot categories (unseen levels become all zeros) with the numbers."""
    index = StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_h" for c in categorical], dropLast=True)
    vec = VectorAssembler(inputCols=[*numeric, *[f"{c}_h" for c in categorical]], outputCol="features")
    return [index, hot, vec]


def fit_binary(train: DataFrame, y: str, numeric: Sequence[str], kind: str = "gbt", categorical: Sequence[str] = CATEGORICAL, **params) -> PipelineModel | boosting.Booster:
    """``logistic`` or ``gbt`` with balanced weights (column ``weight``).

    The logistic fit drops the first level of each category, scales every feature to
    unit deviation, and carries the usual L2 penalty of one half per unit weight.
    """
    if kind != "logistic":
        return boosting.fit(train, y, numeric, categorical, "weight", **params)
    front = Pipeline(stages=feature_stages(numeric, categorical)).fit(train)
    keep, at = list(range(len(numeric))), len(numeric)
    for labels in front.stages[0].labelsArray:
        keep += range(at + 1, at + len(labels))
        at += len(labels)
    total = train.agg(F.sum("weight")).first()[0]
    rest = [
        VectorSlicer(inputCol="features", outputCol="_kept", indices=keep),
        StandardScaler(inputCol="_kept", outputCol="_scaled"),
        LogisticRegression(
            labelCol=y, featuresCol="_scaled", weightCol="weight", standardization=False, **{"maxIter": 1000, "regParam": 1.0 / total, **params}
        ),
    ]
    return PipelineModel([*front.stages, *Pipeline(stages=rest).fit(front.transform(train)).stages])


def fit_multiclass(train: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = CATEGORICAL, **params) -> boosting.Booster:
    """A boosted tree per class in every round."""
    return boosting.fit(train, label, numeric, categorical, **params)


def with_label(model: boosting.Booster, scored: DataFrame, out: str = "pred") -> DataFrame:
    """Predicted class name of a multiclass model."""
    names = F.array(*[F.lit(v) for v in model.labels])
    at = F.least(F.col("prediction").cast("int"), F.lit(max(len(model.labels) - 1, 0)))  # one class is predicted always
    return scored.withColumn(out, F.get(names, at))


def probability(scored: DataFrame) -> DataFrame:
    """``prob``: that of the second class."""
    p = F.col("probability")
    return scored.withColumn("prob", (p if isinstance(scored.schema["probability"].dataType, ArrayType) else vector_to_array(p))[1])


def coefficients(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str] = CATEGORICAL) -> list[tuple[str, float]]:
    """Feature names with their weights on the scale of unit deviations (one per feature, so driver-sized), largest magnitude first."""
    index = model.stages[0]
    names = list(numeric)
    for c, labels in zip(categorical, index.labelsArray):
        names += [f"{c}={v}" for v in labels[1:]]
    values = model.stages[-1].coefficients.toArray()
    return sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda t: (-abs(t[1]), t[0]))


def score_band(p: Column) -> Column:
    return F.when(p >= 0.65, "alta").when(p >= 0.45, "intermedia").otherwise("baja")


def align_for_scoring(rows: DataFrame, known_departments: Sequence[str]) -> DataFrame:
    """Missing numbers become 0 and unknown departments the tail group before scoring."""
    known = F.col("department_group").isin(*known_departments)
    return rows.fillna(0.0, [c for c in NUMERIC if c in rows.columns]).withColumn(
        "department_group", F.when(known, F.col("department_group")).otherwise("OTRO")
    )


def model_log(rows: Sequence[DataFrame]) -> DataFrame:
    """Metric rows with the best model marked: average precision, then AUC."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    best = out.agg(F.max(F.struct(F.coalesce("auc_pr", F.lit(-1.0)), F.coalesce("auc_roc", F.lit(-1.0)), "model"))["model"]).scalar()
    return out.withColumn("is_best", F.col("model") == best)
