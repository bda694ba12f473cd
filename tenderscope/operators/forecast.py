"""Seasonal forecasters, backtests and model choice over a panel of monthly series.

A series is one row: ``y`` is its values in month order. Its length is bounded by
the calendar, the number of series is not, so every model is a column expression
on that row and a panel of any size runs without a shuffle after ``to_series``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tenderscope.functions.arrays import let

SEASON = 12
Z80 = 1.64
Model = Callable[[Column, int], Column]


def to_series(panel: DataFrame, keys: Sequence[str], month: str = "month", value: str = "y") -> DataFrame:
    """One row per key: values in month order, first and last month."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(month).alias("m"), F.col(value).cast("double").alias("v"))))
    return (
        panel.groupBy(*keys)
        .agg(pairs.alias("_p"))
        .select(
            *keys,
            F.transform("_p", lambda p: p["v"]).alias("y"),
            F.element_at("_p", 1)["m"].alias("first_month"),
            F.element_at("_p", -1)["m"].alias("last_month"),
        )
    )


# --- array helpers --------------------------------------------------------


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return let(a, lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)))


def _middle(s: Column) -> Column:
    n = F.size(s)
    lo = F.get(s, F.floor((n - 1) / 2).cast("int"))
    hi = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2.0)


def median(a: Column) -> Column:
    return let(F.array_sort(a), _middle)


def at_position(y: Column, m: Column) -> Column:
    """Values whose index is ``m`` modulo the season (position, not calendar month)."""
    return F.filter(y, lambda _v, i: i % SEASON == m)


def _steps(h: int) -> Column:
    return F.sequence(F.lit(1), F.lit(h))


def _last(y: Column) -> Column:
    return F.element_at(y, -1)


def _tail(y: Column, k: int) -> Column:
    return F.slice(y, F.greatest(F.size(y) - k + 1, F.lit(1)), F.lit(k))


def _factors(y: Column, fallback: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(SEASON - 1)), lambda m: F.coalesce(mean(at_position(y, m)), fallback))


def _or_one(c: Column) -> Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


# --- models ---------------------------------------------------------------


def naive(y: Column, h: int) -> Column:
    """Same month last season, repeated."""
    n = F.size(y)
    return F.transform(
        _steps(h),
        lambda k: F.when(n >= SEASON, F.get(y, (n - SEASON + (k - 1) % SEASON).cast("int"))).otherwise(_last(y)),
    )


def level(y: Column, h: int) -> Column:
    """Recent level times the relative seasonal factor."""
    n = F.size(y)

    def path(recent: Column, f: Column, centre: Column) -> Column:
        return F.transform(_steps(h), lambda k: recent * (F.get(f, ((n + k - 1) % SEASON).cast("int")) / centre))

    seasonal = let(
        mean(_tail(y, SEASON)),
        lambda recent: let(_factors(y, recent), lambda f: let(_or_one(mean(f)), lambda c: path(recent, f, c))),
    )
    return F.when(n < SEASON, naive(y, h)).otherwise(seasonal)


def anchored(y: Column, h: int) -> Column:
    """Seasonal pattern hung on the last value."""
    n, last = F.size(y), _last(y)

    def path(f: Column, base: Column) -> Column:
        return F.transform(_steps(h), lambda k: last * (F.get(f, ((n + k - 1) % SEASON).cast("int")) / base))

    here = ((n - 1) % SEASON).cast("int")
    out = let(_factors(y, last), lambda f: let(_or_one(F.get(f, here)), lambda b: path(f, b)))
    return F.when(last <= 0, level(y, h)).otherwise(out)


def seasonal_median(y: Column, h: int) -> Column:
    n = F.size(y)
    return F.transform(_steps(h), lambda k: F.coalesce(median(at_position(y, (n + k - 1) % SEASON)), _last(y)))


#: Candidates of the regression on log seasonal differences: difference twice, lag of the regressor, with a slope.
AR_CANDIDATES = ((False, 1, True), (True, 1, True), (False, 1, False), (False, SEASON, True))
HOLD_BACK = 6


def _logs(y: Column) -> Column:
    return F.transform(y, lambda v: F.log1p(F.greatest(v, F.lit(0.0))))


def _less(a: Column, k: int) -> Column:
    return F.when(F.size(a) > k, F.transform(F.sequence(F.lit(k), F.size(a) - 1), lambda t: F.get(a, t) - F.get(a, t - k)))


def _ar_path(z: Column, h: int, c: Column) -> Column:
    """Conditional least squares of the differences on their own lag, carried ``h`` steps on; null with too few points.

    ``c`` is a candidate; what it says is data, so all candidates share one expression.
    """
    skip = F.when(c["slope"], c["lag"]).otherwise(0)

    def fit(d: Column) -> Column:
        m = F.size(d) - skip
        pairs = F.arrays_zip(F.slice(d, F.lit(1), m).alias("x"), F.slice(d, skip + 1, m).alias("w"))
        centre = F.struct(mean(F.transform(pairs, lambda p: p["x"])).alias("x"), mean(F.transform(pairs, lambda p: p["w"])).alias("w"))

        def line(o: Column) -> Column:
            zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"))
            sums = F.aggregate(
                pairs,
                zero,
                lambda s, p: F.struct(
                    (s["xy"] + (p["x"] - o["x"]) * (p["w"] - o["w"])).alias("xy"), (s["xx"] + (p["x"] - o["x"]) * (p["x"] - o["x"])).alias("xx")
                ),
                lambda s: F.when(c["slope"], F.coalesce(F.try_divide(s["xy"], s["xx"]), F.lit(0.0))).otherwise(F.lit(0.0)),
            )
            return let(sums, lambda b: F.struct(b.alias("b"), (o["w"] - b * o["x"]).alias("a")))

        return let(centre, line)

    def step(s: Column, ab: Column) -> Column:
        move = ab["a"] + ab["b"] * F.get(s["d"], F.size(s["d"]) - c["lag"])
        season = F.when(c["twice"], s["s"]).otherwise(0.0) + move
        nxt = F.get(s["z"], F.size(s["z"]) - SEASON) + season
        return F.struct(F.concat(s["d"], F.array(move)).alias("d"), season.alias("s"), F.concat(s["z"], F.array(nxt)).alias("z"))

    def path(d: Column, seasonal: Column, ab: Column) -> Column:
        start = F.struct(d.alias("d"), F.element_at(seasonal, -1).alias("s"), z.alias("z"))
        out = F.aggregate(_steps(h), start, lambda s, _k: step(s, ab), lambda s: F.slice(s["z"], F.size(z) + 1, F.lit(h)))
        return F.when(ab["a"].isNotNull(), out)

    def of(seasonal: Column) -> Column:
        d = F.when(c["twice"], _less(seasonal, 1)).otherwise(seasonal)
        return let(d, lambda x: F.when(F.size(x) > skip, let(fit(x), lambda ab: path(x, seasonal, ab))))

    return let(_less(z, SEASON), of)


def seasonal_ar(y: Column, h: int, min_points: int = 30) -> Column:
    """The candidate that foretold the last ``HOLD_BACK`` months best (in logs), fitted anew on all months.

    Equal errors go to the earlier candidate; one without enough points takes no part.
    """
    candidates = F.array(*[F.struct(F.lit(t).alias("twice"), F.lit(lag).alias("lag"), F.lit(s).alias("slope")) for t, lag, s in AR_CANDIDATES])
    steps = max(h, HOLD_BACK)

    def error(path: Column, z: Column) -> Column:
        actual = F.slice(z, F.size(z) - HOLD_BACK + 1, F.lit(HOLD_BACK))
        gaps = mean(F.zip_with(F.slice(path, F.lit(1), F.lit(HOLD_BACK)), actual, lambda p, v: (p - v) * (p - v)))
        return F.coalesce(gaps, F.lit(float("inf")))

    def choose(z: Column) -> Column:
        ends = F.array(F.slice(z, F.lit(1), F.size(z) - HOLD_BACK), z)
        paths = F.transform(candidates, lambda c: F.transform(ends, lambda part: _ar_path(part, steps, c)))
        scored = F.transform(paths, lambda p, i: F.struct(error(F.get(p, F.lit(0)), z).alias("e"), i.alias("i"), F.get(p, F.lit(1)).alias("path")))
        return F.slice(F.array_min(scored)["path"], F.lit(1), F.lit(h))

    out = F.transform(let(_logs(y), choose), lambda v: F.greatest(F.expm1(v), F.lit(0.0)))
    return F.when(F.size(y) >= min_points, out)


SEASONAL_MODELS: dict[str, Model] = {
    "estacional_naive": naive,
    "estacional_nivel": level,
    "estacional_anclado": anchored,
    "estacional_mediana": seasonal_median,
}
MODELS: dict[str, Model] = {**SEASONAL_MODELS, "seasonal_ar": seasonal_ar}


def sigma_of(y: Column) -> Column:
    """Median absolute seasonal difference; the recent spread for short series."""
    n = F.size(y)
    gaps = F.transform(F.sequence(F.lit(SEASON), n - 1), lambda t: F.abs(F.get(y, t) - F.get(y, t - SEASON)))
    recent = F.when(n >= SEASON, _tail(y, SEASON)).otherwise(y)
    spread = let(
        recent, lambda r: let(mean(r), lambda mu: F.sqrt(mean(F.transform(r, lambda v: (v - mu) * (v - mu)))))
    )
    return F.when(n >= 2 * SEASON, median(gaps)).otherwise(spread)


def bands(pred: Column, sigma: Column) -> Column:
    """Path of (pred, lo, hi): 80 % bands that widen with the step, floored at zero."""

    def one(p: Column, i: Column) -> Column:
        width = Z80 * sigma * F.sqrt(1 + (i + 1) / 12.0)
        return F.struct(p.alias("pred"), F.greatest(p - width, F.lit(0.0)).alias("lo"), (p + width).alias("hi"))

    return F.transform(pred, one)


#: Smoothing weights that Holt-Winters tries: of the level, the trend and the season.
HW_LEVEL, HW_TREND, HW_SEASON = (0.05, 0.1, 0.2, 0.3, 0.5, 0.8), (0.0, 0.02, 0.05, 0.1, 0.2, 0.4), (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def holt_winters(y: Column, h: int) -> Column:
    """``pred, lo, hi``: additive trend and season on log1p, the weights of least squared one-step error.

    One fold of the series for each triple of weights; the season is a queue whose head is the
    current month. Null with fewer than two seasons.
    """
    grid = F.flatten(F.transform(_numbers(HW_LEVEL), lambda a: F.flatten(F.transform(_numbers(HW_TREND), lambda b: F.transform(_numbers(HW_SEASON), lambda g: F.struct(a.alias("a"), b.alias("b"), g.alias("g")))))))

    def advance(s: Column, v: Column, w: Column) -> Column:
        head, ahead = F.get(s["season"], F.lit(0)), s["level"] + s["trend"]

        def moved(level_: Column) -> Column:
            gap = v - (ahead + head)
            season = w["g"] * (v - level_) + (1 - w["g"]) * head
            return F.struct(
                (s["error"] + gap * gap).alias("error"), (s["gaps"] + gap).alias("gaps"), level_.alias("level"),
                (w["b"] * (level_ - s["level"]) + (1 - w["b"]) * s["trend"]).alias("trend"),
                F.concat(F.slice(s["season"], F.lit(2), F.lit(SEASON - 1)), F.array(season)).alias("season"),
            )

        return let(w["a"] * (v - head) + (1 - w["a"]) * ahead, moved)

    def best(z: Column, first: Column) -> Column:
        second = mean(F.slice(z, F.lit(SEASON + 1), F.lit(SEASON)))
        start = F.struct(
            F.lit(0.0).alias("error"), F.lit(0.0).alias("gaps"), first.alias("level"), ((second - first) / SEASON).alias("trend"),
            F.transform(F.slice(z, F.lit(1), F.lit(SEASON)), lambda v: v - first).alias("season"),
        )

        def tried(w: Column, i: Column) -> Column:
            end = F.aggregate(z, start, lambda s, v: advance(s, v, w))
            return let(end, lambda s: F.struct(s["error"].alias("error"), i.alias("i"), s["gaps"].alias("gaps"), s["level"].alias("level"), s["trend"].alias("trend"), s["season"].alias("season")))

        return F.array_min(F.transform(grid, tried))

    def path(s: Column, n: Column) -> Column:
        spread = F.sqrt(F.greatest(s["error"] / n - (s["gaps"] / n) * (s["gaps"] / n), F.lit(0.0)))

        def one(k: Column) -> Column:
            p = s["level"] + k * s["trend"] + F.get(s["season"], (k - 1) % SEASON)
            width = Z80 * spread * F.sqrt(1 + k / 12.0)
            return F.struct(*[F.greatest(F.expm1(x), F.lit(0.0)).alias(c) for c, x in (("pred", p), ("lo", p - width), ("hi", p + width))])

        return F.transform(_steps(h), one)

    out = let(_logs(y), lambda z: let(mean(F.slice(z, F.lit(1), F.lit(SEASON))), lambda m: let(best(z, m), lambda s: path(s, F.size(z)))))
    return let(
        F.when(F.size(y) >= 2 * SEASON, out),
        lambda p: F.struct(
            F.transform(p, lambda x: x["pred"]).alias("pred"), F.transform(p, lambda x: x["lo"]).alias("lo"), F.transform(p, lambda x: x["hi"]).alias("hi")
        ),
    )


def forecast(series: DataFrame, keys: Sequence[str], h: int, models: dict[str, Model] | None = None) -> DataFrame:
    """Long table: key, model, step, pred, lo, hi."""
    models = models or MODELS
    rows = [F.struct(F.lit(n).alias("model"), bands(fn(F.col("y"), h), F.col("_sigma")).alias("path")) for n, fn in models.items()]
    long = series.withColumn("_sigma", sigma_of(F.col("y"))).select(*keys, "last_month", F.inline(F.array(*rows)))
    return long.select(*keys, "last_month", "model", F.posexplode("path").alias("_i", "_p")).select(
        *keys,
        "model",
        (F.col("_i") + 1).alias("step"),
        F.add_months("last_month", F.col("_i") + 1).alias("month"),
        F.col("_p.pred").alias("pred"),
        F.col("_p.lo").alias("lo"),
        F.col("_p.hi").alias("hi"),
    )


# --- backtest -------------------------------------------------------------


def origins(n: Column, h: int, windows: int = 3, train: int = 24, fallback: int = 18) -> Column:
    """Train lengths from the end: up to ``windows`` with enough history, else one short one."""
    full = F.filter(F.transform(F.sequence(F.lit(1), F.lit(windows)), lambda k: n - h * k), lambda e: e >= train)
    short = F.when(n - h >= fallback, F.array(n - h)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(full) > 0, full).otherwise(short)


def cut_at_origins(series: DataFrame, h: int) -> DataFrame:
    """One row per series and origin: ``y`` up to it, ``test`` after it."""
    return series.withColumn("origin", F.explode(origins(F.size("y"), h))).withColumns(
        {"test": F.slice("y", F.col("origin") + 1, F.lit(h)), "y": F.slice("y", F.lit(1), F.col("origin"))}
    )


def array_mape(actual: Column, pred: Column) -> Column:
    pairs = F.filter(F.arrays_zip(actual.alias("a"), pred.alias("p")), lambda x: x["a"] > 0)
    err = F.transform(pairs, lambda x: F.abs((x["a"] - x["p"]) / x["a"]))
    return F.coalesce(mean(err) * 100.0, F.lit(float("inf")))


def array_rmse(actual: Column, pred: Column) -> Column:
    return F.sqrt(mean(F.zip_with(actual, pred, lambda a, p: (a - p) * (a - p))))


def backtest(series: DataFrame, keys: Sequence[str], h: int = 6, models: dict[str, Model] | None = None) -> DataFrame:
    """Rolling-origin error of each model and its rank within the series."""
    models = models or MODELS
    cut = cut_at_origins(series, h)
    scored = cut.select(
        *keys,
        "test",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("pos"), F.lit(name).alias("model"), fn(F.col("y"), h).alias("pred"))
                    for i, (name, fn) in enumerate(models.items())
                ]
            )
        ),
    ).where(F.col("pred").isNotNull())
    per = scored.select(
        *keys, "pos", "model", array_mape(F.col("test"), F.col("pred")).alias("mape"), array_rmse(F.col("test"), F.col("pred")).alias("rmse")
    )
    out = per.groupBy(*keys, "pos", "model").agg(
        F.round(F.avg("mape"), 2).alias("mape_pct"),
        F.round(F.percentile("mape", 0.5), 2).alias("mape_median_pct"),  # a handful of windows
        F.round(F.avg("rmse"), 1).alias("rmse"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    w = Window.partitionBy(*keys).orderBy("mape_median_pct", "mape_pct", "rmse", "pos")  # one row per model
    return out.withColumn("rank", F.row_number().over(w)).drop("pos")


def select_model(
    series: DataFrame, scores: DataFrame, keys: Sequence[str], h: int, continuity: bool = False, models: dict[str, Model] | None = None
) -> DataFrame:
    """The model to use per series: best ranked, or the smoothest good one.

    With ``continuity`` the naive copy is banned, anchoring needs a normal last
    value and an error near the best, and a large first jump is penalised.
    """
    models = models or MODELS
    if not continuity:
        return scores.where(F.col("rank") == 1).select(*keys, "model")
    paths = series.select(
        *keys,
        _last(F.col("y")).alias("_last"),
        mean(_tail(F.col("y"), SEASON)).alias("_level"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("model"), fn(F.col("y"), h).alias("_pred")) for n, fn in models.items()])),
    ).where(F.col("_pred").isNotNull())
    used = scores.select(
        *keys, "model", F.when(F.col("mape_median_pct") > 0, F.col("mape_median_pct")).otherwise(F.col("mape_pct")).alias("_m")
    )
    group = Window.partitionBy(*keys)  # one row per model
    c = paths.join(used, [*keys, "model"], "left").withColumns(
        {
            "_best": F.min("_m").over(group),
            "_m": F.coalesce("_m", F.lit(999.0)),
            "_jump": F.when(F.col("_last") <= 0, F.lit(0.0)).otherwise(F.abs(F.get("_pred", F.lit(0)) - F.col("_last")) / F.col("_last")),
            "_odd": (F.col("_level") > 0) & ((F.col("_last") < 0.55 * F.col("_level")) | (F.col("_last") > 1.8 * F.col("_level"))),
        }
    )
    anchor = F.col("model") == "estacional_anclado"
    c = c.where(F.col("model") != "estacional_naive").where(
        ~(anchor & (F.col("_odd") | F.coalesce(F.col("_m") > 1.25 * F.col("_best"), F.lit(False))))
    )
    c = c.withColumn("_floor", F.min("_m").over(group)).withColumn(
        "_ok", (F.col("_jump") <= 1.0) & (F.col("_m") <= 1.5 * F.col("_floor"))
    )
    calm = Window.partitionBy(*keys).orderBy("_jump", "_m", "model")
    c = c.withColumns({"_any": F.bool_or("_ok").over(group), "_calm": F.row_number().over(calm)})
    pool = c.where(F.when(F.col("_any"), F.col("_ok")).otherwise(F.col("_calm") <= 2))
    cost = F.struct((F.col("_m") + F.when(F.col("_jump") <= 1.0, 0.0).otherwise(40.0)).alias("c"), F.col("_jump"), F.col("model"))
    return pool.groupBy(*keys).agg(F.min_by("model", cost).alias("model"))


def with_custom_forecaster(series: DataFrame, keys: Sequence[str], fn: Callable[[np.ndarray, int], np.ndarray], h: int, name: str) -> DataFrame:
    """Plug in a user forecaster ``fn(y, h)``; series stay spread over the tasks."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(ys: pd.Series) -> pd.Series:
        return ys.map(lambda y: [float(v) for v in fn(np.asarray(y, dtype=float), h)])

    return series.select(*keys, F.lit(name).alias("model"), F.posexplode(run("y")).alias("step", "pred")).withColumn(
        "step", F.col("step") + 1
    )


# --- top-down by share ----------------------------------------------------


def share_paths(shares: DataFrame, keys: Sequence[str], part: str, h: int) -> DataFrame:
    """Projected shares per step and method from ``keys, part, month, share``.

    ``estacional_mes``: median share of the calendar month; ``reciente_12m``: mean
    of the last twelve months; ``estacional_blend``: 70/30. Parts sum to one.
    """
    keys = list(keys)
    of = [*keys, part]
    latest = Window.partitionBy(*of).orderBy(F.desc("month"))  # one row per month
    recent = (
        shares.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= SEASON)
        .groupBy(*of).agg(F.avg("share").alias("_recent"), F.max("month").alias("_last"))
    )
    by_month = shares.groupBy(*of, F.month("month").alias("_cm")).agg(F.percentile("share", 0.5).alias("_seasonal"))
    grid = recent.select(*of, "_recent", "_last", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")).withColumn(
        "_cm", F.month(F.add_months("_last", F.col("step")))
    )
    step = Window.partitionBy(*keys, "step")  # one row per part
    raw = grid.join(by_month, [*of, "_cm"], "left").withColumn("_seasonal", F.coalesce("_seasonal", "_recent"))
    unit = raw.withColumns(
        {
            "_recent": F.col("_recent") / F.sum("_recent").over(step),
            "_seasonal": F.col("_seasonal") / F.sum("_seasonal").over(step),
        }
    ).withColumn("_blend", 0.7 * F.col("_seasonal") + 0.3 * F.col("_recent"))
    unit = unit.withColumn("_blend", F.col("_blend") / F.sum("_blend").over(step))
    return unit.select(
        *of,
        "step",
        F.inline(
            F.array(
                F.struct(F.lit("topdown_blend").alias("method"), F.col("_blend").alias("share")),
                F.struct(F.lit("topdown_estacional").alias("method"), F.col("_seasonal").alias("share")),
                F.struct(F.lit("topdown_reciente").alias("method"), F.col("_recent").alias("share")),
            )
        ),
    )
