"""Column builders for market and forecast measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hhi(value: Column) -> Column:
    """Aggregate: concentration of summed values on the 0-10 000 scale.

    Σ share² = Σ v² / (Σ v)², so no join back to the total is needed.
    """
    v = value.cast("double")
    total = F.sum(value).cast("double")
    return F.try_divide(F.sum(v * v), total * total) * 10000.0


def hhi_band(h: Column) -> Column:
    return F.when(h < 1500, "baja").when(h < 2500, "moderada").otherwise("alta")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two set-valued columns."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def mape(actual: Column, predicted: Column) -> Column:
    """Aggregate: mean absolute percentage error over positive actuals."""
    return F.avg(F.when(actual > 0, F.abs(actual - predicted) / actual)) * 100.0


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))
