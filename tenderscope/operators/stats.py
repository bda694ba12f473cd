"""Gap filling, decomposition and rank statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tenderscope.operators.ranks import average_ranks


def fill_months(panel: DataFrame, keys: Sequence[str], month: str = "month", value: str = "y") -> DataFrame:
    """A regular monthly grid with linear interpolation inside gaps."""
    keys = list(keys)
    span = panel.groupBy(*keys).agg(F.min(month).alias("_a"), F.max(month).alias("_z"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_z", F.expr("interval 1 month"))).alias(month))
    full = grid.join(panel.select(*keys, month, F.col(value).cast("double").alias(value)), [*keys, month], "left")
    idx = F.year(month) * 12 + F.month(month)
    full = full.withColumn("_i", idx).withColumn("_known", F.when(F.col(value).isNotNull(), F.struct("_i", F.col(value).alias("v"))))
    w = Window.partitionBy(*keys).orderBy(month)  # one row per calendar month
    prev = F.last("_known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.first("_known", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    full = full.withColumns({"_p": prev, "_n": nxt})
    slope = (F.col("_n.v") - F.col("_p.v")) / (F.col("_n._i") - F.col("_p._i"))
    return full.select(
        *keys,
        month,
        F.col(value).isNull().alias("filled"),
        F.coalesce(F.col(value), F.col("_p.v") + slope * (F.col("_i") - F.col("_p._i"))).alias(value),
    )


def decompose(panel: DataFrame, keys: Sequence[str], month: str = "month", value: str = "y") -> DataFrame:
    """Trend (2x12 centred moving average), additive month effects and residual."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(month)  # one row per calendar month
    y = F.col(value).cast("double")
    inner = F.sum(y).over(w.rowsBetween(-5, 5))
    trend = F.when(
        F.count(y).over(w.rowsBetween(-6, 6)) == 13, (inner + 0.5 * F.lag(y, 6).over(w) + 0.5 * F.lead(y, 6).over(w)) / 12.0
    )
    base = panel.select(*keys, month, y.alias("y"), trend.alias("trend"))
    effects = base.groupBy(*keys, F.month(month).alias("_cm")).agg(F.avg(F.col("y") - F.col("trend")).alias("_e"))
    effects = effects.withColumn("_e", F.col("_e") - F.avg("_e").over(Window.partitionBy(*keys)))  # twelve rows
    return (
        base.withColumn("_cm", F.month(month))
        .join(effects, [*keys, "_cm"], "left")
        .select(*keys, month, "y", "trend", F.col("_e").alias("seasonal"), (F.col("y") - F.col("trend") - F.col("_e")).alias("residual"))
    )


def strengths(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strength of season and trend: max(0, 1 - var(r) / var(component + r))."""

    def strength(component: str) -> Column:
        both = F.var_samp(F.when(F.col("residual").isNotNull(), F.col(component) + F.col("residual")))
        return F.round(F.greatest(F.lit(0.0), 1 - F.var_samp("residual") / both), 6)

    return parts.groupBy(*keys).agg(strength("seasonal").alias("seasonal_strength"), strength("trend").alias("trend_strength"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """Tie-corrected H over the groups; ranks come from distinct values and their counts."""
    cells = df.groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    freq = cells.groupBy("_v").agg(F.sum("_n").alias("_c"))
    ranked = average_ranks(freq, "_v", "_c", "_rank")
    ties = freq.agg(F.sum(F.col("_c").cast("double") * F.col("_c") * F.col("_c") - F.col("_c"))).scalar()
    per = cells.join(ranked.select("_v", "_rank"), "_v").groupBy(group).agg(
        F.sum(F.col("_rank") * F.col("_n")).alias("_r"), F.sum("_n").alias("_g")
    )
    n = F.sum("_g").cast("double")
    h = 12.0 / (n * (n + 1)) * F.sum(F.col("_r") * F.col("_r") / F.col("_g")) - 3 * (n + 1)
    return per.agg(
        (h / (1 - ties / (n * n * n - n))).alias("h"), (F.count(F.lit(1)) - 1).alias("df"), F.sum("_g").alias("n")
    )


def _chi2_tail_one(x: float, df: int) -> float:
    """Upper tail of chi-square from the finite sums for even and odd degrees."""
    if x <= 0:
        return 1.0
    if df % 2:
        tail = math.erfc(math.sqrt(x / 2))
        term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        for k in range(1, (df - 1) // 2 + 1):
            tail += term
            term *= x / (2 * k + 1)
        return tail
    tail = term = math.exp(-x / 2)
    for k in range(1, df // 2):
        term *= x / (2 * k)
        tail += term
    return tail


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_chi2_tail_one(float(a), int(b)) for a, b in zip(x, df)])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tie-averaged rank correlation of two columns over complete rows.

    Works on counts of distinct pairs, so a value shared by a third of the rows
    is one row of the rank table.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    ).agg(F.count(F.lit(1)).alias("_n"))
    rx = average_ranks(cells.groupBy("_x").agg(F.sum("_n").alias("_c")), "_x", "_c", "_rx").select("_x", "_rx")
    ry = average_ranks(cells.groupBy("_y").agg(F.sum("_n").alias("_c")), "_y", "_c", "_ry").select("_y", "_ry")
    both = cells.join(rx, "_x").join(ry, "_y")
    n = F.sum("_n").cast("double")
    # centred on the known mean rank to keep the sums small
    size = cells.agg(F.sum("_n").cast("double")).scalar()
    a, b = F.col("_rx") - (size + 1) / 2, F.col("_ry") - (size + 1) / 2
    w = F.col("_n")
    return both.agg(
        F.round(F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))), 6).alias("rho"),
        n.cast("long").alias("n"),
    )
