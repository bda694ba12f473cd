"""Exact order statistics and running totals that never sort everything in one task.

A value is first mapped to a coarse bucket by a fixed monotone rule (log scale),
so the number of buckets is bounded by the range of a double, not by the rows.
A bucket that holds very many rows all the same is cut by sampled bounds.
Totals per bucket are tiny; the running sum over buckets gives every bucket its
offset, and the detailed order is only needed inside a bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderscope.session import cut_lineage

#: Rows at one bucket of values from which it is cut into ranges.
RANGE_ROWS = 1 << 18
BUCKETS_PER_UNIT = 1024  # for each doubling: ~0.07 % relative width
SMALLEST = 1100 * BUCKETS_PER_UNIT  # lifts the bucket of the smallest double above zero


def log_bucket(value: Column) -> Column:
    """Monotone, data-independent bucket of a number, as narrow near zero as far from it."""
    v = value.cast("double")
    size = F.floor(F.log2(F.abs(v)) * BUCKETS_PER_UNIT) + SMALLEST
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * size).cast("long")


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def running_totals(
    df: DataFrame,
    order: str,
    ties: Sequence[str],
    sums: Mapping[str, str],
    keys: Sequence[str] = (),
    descending: bool = True,
    grouped: bool = False,
) -> DataFrame:
    """Add inclusive running sums of ``sums`` (output name -> input column).

    Rows are ordered by ``order`` and then ``ties`` within ``keys``; the window
    is partitioned by ranges of that order, so no task sees a whole key, nor all
    rows of one value.
    """
    keys = list(keys)
    part = [*keys, "_b", "_s"]
    tagged = order_ranges(df, order, ties, keys, descending)
    per_range = tagged.groupBy(*part).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_b", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(k).alias(f"_k_{k}") for k in part],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in part])
    inside = (
        Window.partitionBy(*part).orderBy(_first(order, descending), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = tagged.join(offsets, match, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_o_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()],
    )


def _first(order: str, descending: bool) -> Column:
    return F.col(order).desc() if descending else F.col(order).asc()


def order_ranges(
    df: DataFrame, order: str, ties: Sequence[str], keys: Sequence[str] = (), descending: bool = True, most: int | None = None
) -> DataFrame:
    """``df`` with ``_b, _s``: ranges that follow one another in the order of ``order`` and then ``ties``.

    ``_b`` is the bucket of the value. A bucket of more than ``most`` rows (many rows at one value,
    say) is cut further, by sampled bounds over value and ties, into ranges ``_s`` of about that size.
    """
    most = most or RANGE_ROWS
    keys = list(keys)
    bucket = log_bucket(F.col(order))
    tagged = cut_lineage(df.withColumn("_b", -bucket if descending else bucket))
    sizes = tagged.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    wide = sizes.agg(F.sum("_n")).first()[0]
    if not wide:
        return tagged.withColumn("_s", F.lit(0))
    marks = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_b"]])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_b"]])
    ranges = -(-int(wide) // most)
    heavy = tagged.join(marks, match, "left_semi").repartitionByRange(
        ranges, *[F.col(k).asc() for k in keys], F.col("_b").asc(), _first(order, descending), *[t if isinstance(t, Column) else F.col(t) for t in ties]
    )
    # written, so that sampled bounds are drawn once
    return tagged.join(marks, match, "left_anti").withColumn("_s", F.lit(0)).unionByName(cut_lineage(heavy.withColumn("_s", F.spark_partition_id())))


def exact_percentiles(
    df: DataFrame, value: str, probs: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key.

    Only the buckets that hold a wanted rank are ordered in detail. Equal values
    are pre-aggregated, so one value holding a third of the rows costs one row.
    """
    keys = list(keys)
    freq = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", log_bucket(F.col("_v")))
    )
    prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = (
        freq.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.coalesce(F.sum("_bn").over(prior), F.lit(0)))
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*keys)))
    )
    for name, p in probs.items():
        hist = hist.withColumn(f"_p_{name}", F.lit(float(p)) * (F.col("_total") - 1))

    def holds(rank: Column, start: Column, end: Column) -> Column:
        return (rank >= start) & (rank < end)

    bucket_end = F.col("_before") + F.col("_bn")
    wanted = reduce(
        lambda a, b: a | b,
        [
            holds(fn(F.col(f"_p_{n}")), F.col("_before"), bucket_end)
            for n in probs
            for fn in (F.floor, F.ceil)
        ],
    )
    hot = hist.where(wanted).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_b").alias("_hb"),
        "_before",
        *[f"_p_{n}" for n in probs],
    )
    match = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        F.col("_b") == F.col("_hb"),
    )
    inner = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = freq.join(hot, match).withColumn("_end", F.col("_before") + F.sum("_n").over(inner))
    start = F.col("_end") - F.col("_n")
    aggs = []
    for n in probs:
        pos = F.col(f"_p_{n}")
        aggs += [
            F.max(F.when(holds(F.floor(pos), start, F.col("_end")), F.col("_v"))).alias(f"_lo_{n}"),
            F.max(F.when(holds(F.ceil(pos), start, F.col("_end")), F.col("_v"))).alias(f"_hi_{n}"),
            F.max(pos - F.floor(pos)).alias(f"_f_{n}"),
        ]
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )


def average_ranks(freq: DataFrame, value: str, weight: str, name: str = "avg_rank") -> DataFrame:
    """Tie-averaged ranks for a table of distinct values and their counts."""
    done = running_totals(freq, value, [], {"_upto": weight}, descending=False, grouped=True)
    return done.withColumn(name, F.col("_upto") - (F.col(weight) - 1) / 2.0).drop("_upto")


def top_n_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark limits each map task first (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def shares_within(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Share of ``value`` in its group. Totals are aggregated map-side and joined
    back, so a hot group is split by the skew join instead of filling one task."""
    keys = list(keys)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return df.join(totals, keys).withColumn(
        name, F.try_divide(F.col(value).cast("double"), F.col("_total").cast("double"))
    ).drop("_total")


def mode_per(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent non-null value per key; equal counts go to the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(F.min(F.struct(-F.col("_c"), F.col(value))).getField(value).alias(name))
