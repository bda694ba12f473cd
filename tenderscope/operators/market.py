"""Concentration, shares, rotation and supplier profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderscope.functions.measures import hhi, hhi_band, jaccard
from tenderscope.operators.ranks import exact_percentiles, mode_per, running_totals, shares_within, top_n_per


def _pct(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, digits)


def supplier_totals(lines: DataFrame, keys: Sequence[str] = ("supplier_id", "supplier_name")) -> DataFrame:
    return lines.groupBy(*keys).agg(F.sum("value").alias("value"))


def market_table(lines: DataFrame) -> DataFrame:
    """Value, share and cumulative share per (id, name), largest first."""
    totals = supplier_totals(lines)
    run = running_totals(totals, "value", ["supplier_id", "supplier_name"], {"cum_value": "value"})
    total = lines.agg(F.sum("value")).scalar().cast("double")
    return run.select(
        "supplier_id",
        "supplier_name",
        "value",
        (F.col("value").cast("double") / total).alias("share"),
        (F.col("cum_value").cast("double") / total).alias("cum_share"),
    )


def concentration(staged: DataFrame, cut: float = 0.80) -> DataFrame:
    """Per stage (``stage, supplier_id, supplier_name, value``): HHI, band and Pareto count."""
    totals = staged.groupBy("stage", "supplier_id", "supplier_name").agg(F.sum("value").alias("value"))
    head = totals.groupBy("stage").agg(
        hhi(F.col("value")).alias("hhi"), F.count(F.lit(1)).alias("n_suppliers"), F.sum("value").alias("_total")
    )
    run = running_totals(totals, "value", ["supplier_id", "supplier_name"], {"_cum": "value"}, keys=["stage"])
    # at most one row per stage: the stages are the caller's few filters
    inside = run.join(F.broadcast(head.select("stage", "_total")), "stage").groupBy("stage").agg(
        F.count_if(F.col("_cum").cast("double") / F.col("_total").cast("double") <= cut).alias("_n")
    )
    return head.join(inside, "stage").select(
        "stage",
        F.round("hhi", 6).alias("hhi"),
        hhi_band(F.col("hhi")).alias("band"),
        "n_suppliers",
        (F.col("_n") + 1).alias("n_80"),
        F.round((F.col("_n") + 1) / F.col("n_suppliers"), 6).alias("pct_80"),
    )


def pareto_curve(lines: DataFrame, points: int = 40, start: float = 0.01) -> DataFrame:
    """Share of value held by the top k suppliers at evenly spaced percentiles of suppliers."""
    totals = supplier_totals(lines).withColumn("_one", F.lit(1))
    run = running_totals(totals, "value", ["supplier_id", "supplier_name"], {"k": "_one", "_cum": "value"})
    n = totals.agg(F.count(F.lit(1))).scalar()
    total = totals.agg(F.sum("value")).scalar().cast("double")
    step = (1.0 - start) / (points - 1)
    spark = lines.sparkSession
    grid = spark.range(points).select(
        F.col("id").alias("point"), (F.lit(start) + F.col("id") * F.lit(step)).alias("p")
    ).withColumn("k", F.greatest(F.lit(1), F.bround(F.col("p") * n).cast("long")))
    return run.join(F.broadcast(grid), "k").select(  # ``points`` rows
        "point",
        F.round(F.col("p") * 100, 4).alias("pct_suppliers"),
        F.col("k").cast("long").alias("k"),
        F.round(F.col("_cum").cast("double") / total * 100, 4).alias("pct_value"),
    )


def hhi_by_buyer(lines: DataFrame, min_processes: int = 20) -> DataFrame:
    named = lines.withColumn("buyer", F.coalesce("buyer", F.lit("Sin entidad")))
    per_pair = named.groupBy("buyer", "supplier_id").agg(F.sum("value").alias("value"))
    money = per_pair.groupBy("buyer").agg(
        F.round(hhi(F.col("value")), 6).alias("hhi"),
        F.count(F.lit(1)).alias("n_suppliers"),
        F.sum("value").alias("value"),
    )
    procs = named.groupBy("buyer").agg(F.countDistinct("process_id").alias("n_processes"))
    return money.join(procs, "buyer").where((F.col("value") > 0) & (F.col("n_processes") >= min_processes))


def concentrated_and_competitive(by_buyer: DataFrame, top: int = 8, bottom: int = 5) -> DataFrame:
    high = by_buyer.orderBy(F.desc("hhi"), "buyer").limit(top).withColumn("side", F.lit("concentrated"))
    low = by_buyer.orderBy(F.asc("hhi"), "buyer").limit(bottom).withColumn("side", F.lit("competitive"))
    return high.unionByName(low)


def yearly_rotation(lines: DataFrame, top: int = 50) -> DataFrame:
    """Per year: suppliers, the leader, and the overlap of leaders with the previous year present."""
    dated = lines.where(F.col("published_at").isNotNull()).withColumn("year", F.year("published_at"))
    per = dated.groupBy("year", "supplier_id").agg(F.sum("value").alias("value"))
    totals = per.groupBy("year").agg(F.count(F.lit(1)).alias("n_suppliers"), F.sum("value").alias("_total"))
    ranked = top_n_per(per, ["year"], [F.desc("value"), F.asc("supplier_id")], top)
    sets = ranked.groupBy("year").agg(
        F.collect_set("supplier_id").alias("_top"),  # at most ``top`` ids
        F.max(F.when(F.col("rank") == 1, F.col("supplier_id"))).alias("top1_id"),
        F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("top1_value"),
    )
    names = mode_per(
        dated.join(sets.select("year", F.col("top1_id").alias("supplier_id")), ["year", "supplier_id"], "left_semi"),
        ["year"],
        "supplier_name",
        "top1_name",
    )
    by_year = Window.orderBy("year")  # one row per calendar year
    return (
        totals.join(sets, "year")
        .join(names, "year", "left")
        .withColumn("_prev", F.lag("_top").over(by_year))
        .select(
            F.col("year").cast("long").alias("year"),
            "n_suppliers",
            "top1_id",
            "top1_name",
            F.col("top1_value").cast("double").alias("top1_value"),
            _pct(F.col("top1_value"), F.col("_total")).alias("top1_pct"),
            F.round(jaccard(F.col("_top"), F.col("_prev")) * 100.0, 6).alias("jaccard_pct"),
        )
    )


def share_by_year(lines: DataFrame, years: Sequence[int]) -> DataFrame:
    """Wide table: one share (percent) per supplier and year, 0 where absent."""
    year = F.year("published_at")
    wide = lines.where(year.isin(*years)).groupBy("supplier_id").agg(
        F.min("supplier_name").alias("supplier_name"),
        *[F.coalesce(F.sum(F.when(year == y, F.col("value"))), F.lit(0)).alias(f"v{y}") for y in years],
    )
    totals = wide.agg(F.struct(*[F.sum(f"v{y}").cast("double").alias(f"v{y}") for y in years]).alias("t")).scalar()
    return wide.select(
        "supplier_id",
        "supplier_name",
        *[F.coalesce(F.try_divide(F.col(f"v{y}").cast("double"), totals[f"v{y}"]) * 100.0, F.lit(0.0)).alias(f"pct_{y}") for y in years],
    )


def change_class(before: Column, after: Column, suffix: str = "") -> Column:
    return (
        F.when((before == 0) & (after > 0), f"Entrante{suffix}")
        .when((before > 0) & (after == 0), f"Saliente{suffix}")
        .when(after - before > 0, "Ganó participación")
        .otherwise("Perdió participación")
    )


def extremes(df: DataFrame, by: str, tie: str, k: int = 10) -> DataFrame:
    """The k largest and k smallest rows."""
    up = df.orderBy(F.desc(by), tie).limit(k).withColumn("side", F.lit("up"))
    down = df.orderBy(F.asc(by), tie).limit(k).withColumn("side", F.lit("down"))
    return up.unionByName(down)


def same_period(lines: DataFrame, years: Sequence[int]) -> DataFrame:
    """Lines from 1 January to the last day seen in the final year, in every year.

    The upper bound is that day at 00:00, so later hours of it are left out.
    """
    last = lines.where(F.year("published_at") == max(years)).agg(F.max("published_at")).scalar()
    year = F.year("published_at")
    end = F.make_date(year, F.month(last), F.dayofmonth(last)).cast("timestamp_ntz")
    return lines.where(year.isin(*years) & (F.col("published_at") <= end))


def relations(lines: DataFrame) -> DataFrame:
    """Buyer-supplier pairs with the share of the buyer and the dependence of the supplier."""
    pairs = lines.where(F.col("buyer").isNotNull() & F.col("supplier_id").isNotNull()).groupBy("buyer", "supplier_id").agg(
        F.min("supplier_name").alias("supplier_name"),
        F.countDistinct("process_id").alias("n_processes"),
        F.sum("value").alias("value"),
    )
    both = shares_within(pairs, ["buyer"], "value", "_b")
    both = shares_within(both, ["supplier_id"], "value", "_s")
    return both.select(
        *pairs.columns,
        F.round(F.col("_b") * 100.0, 6).alias("buyer_share_pct"),
        F.round(F.col("_s") * 100.0, 6).alias("dependence_pct"),
    )


def supplier_profile(rel: DataFrame, high: float = 80, medium: float = 50) -> DataFrame:
    """Buyers, processes, value, strongest dependence, principal buyer and class.

    ``max_by`` picks the principal buyer map-side; the buyer name breaks ties.
    """
    agg = rel.groupBy("supplier_id", "supplier_name").agg(
        F.count(F.lit(1)).alias("n_buyers"),
        F.sum("n_processes").alias("n_processes"),
        F.sum("value").alias("value"),
        F.max("dependence_pct").alias("max_dependence_pct"),
        F.min(F.struct((-F.col("value")).alias("v"), F.col("buyer").alias("b"))).getField("b").alias("principal_buyer"),
    )
    dep = F.col("max_dependence_pct")
    return agg.withColumn(
        "profile",
        F.when(dep >= high, "Alta dependencia").when(dep >= medium, "Dependencia moderada").otherwise("Diversificado"),
    )


def share_matrix(rel: DataFrame, buyers: int = 10, suppliers: int = 12) -> DataFrame:
    """Share of the top buyers' value held by the top suppliers, one column per supplier rank."""
    top_b = rel.groupBy("buyer").agg(F.sum("value").alias("_v")).orderBy(F.desc("_v"), "buyer").limit(buyers).select("buyer")
    one = Window.orderBy(F.desc("_v"), "supplier_id")  # over the limited rows only
    top_s = (
        rel.groupBy("supplier_id").agg(F.sum("value").alias("_v")).orderBy(F.desc("_v"), "supplier_id").limit(suppliers)
        .select("supplier_id", F.concat(F.lit("s"), F.lpad(F.row_number().over(one).cast("string"), 2, "0")).alias("slot"))
    )
    cells = rel.join(F.broadcast(top_b), "buyer").join(F.broadcast(top_s), "supplier_id")
    slots = [f"s{i:02d}" for i in range(1, suppliers + 1)]
    return cells.groupBy("buyer").pivot("slot", slots).agg(F.sum("buyer_share_pct")).fillna(0.0, slots)


def degree_distribution(lines: DataFrame, node: str, other: str, diversified: int = 5) -> DataFrame:
    """Distinct partners per node, described."""
    deg = lines.select(node, other).distinct().groupBy(node).agg(F.count(F.lit(1)).alias("degree"))
    base = deg.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("degree"), 6).alias("mean"),
        F.round(F.stddev_samp("degree"), 6).alias("std"),
        F.min("degree").alias("min"),
        F.max("degree").alias("max"),
        F.count_if(F.col("degree") >= diversified).alias("n_diversified"),
    )
    q = exact_percentiles(deg, "degree", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    quartiles = q.select(F.struct("q1", "median", "q3")).scalar()
    return base.withColumns({c: quartiles[c] for c in ("q1", "median", "q3")})


def award_rate(df: DataFrame, key: str, flag: str = "awarded") -> DataFrame:
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(
        F.round(F.avg(F.col(flag).cast("double")), 6).alias("rate"), F.count(F.lit(1)).alias("n")
    )


def availability_profile(df: DataFrame, key: str, column: str) -> DataFrame:
    """How often a column is informed and positive per group (null group kept), with its exact median."""
    c = F.col(column)
    base = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(c).alias("n_informed"),
        F.round(F.avg(c.isNotNull().cast("double")) * 100, 6).alias("pct_informed"),
        F.round(F.avg((F.coalesce(c, F.lit(0)) > 0).cast("double")) * 100, 6).alias("pct_positive"),
    )
    med = exact_percentiles(df, column, {"median": 0.5}, keys=[key]).withColumnRenamed(key, "_key")
    return base.join(med, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def daily_peaks(df: DataFrame, date: str) -> DataFrame:
    """Busiest day of every month and its part of the month."""
    daily = df.groupBy(F.to_date(date).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    return daily.groupBy(F.trunc("_day", "month").alias("month")).agg(
        F.sum("_n").alias("n"),
        F.max("_n").alias("peak_n"),
        F.dayofmonth(F.min(F.struct(-F.col("_n"), F.col("_day"))).getField("_day")).cast("long").alias("peak_day"),
        F.round(F.max("_n") / F.sum("_n"), 6).alias("peak_share"),
    )
