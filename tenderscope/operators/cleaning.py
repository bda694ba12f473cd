"""Lenient coercion, flags and filters over award lines and processes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderscope.operators.ranks import exact_percentiles

# Accepted spellings of a flag.
TRUE_TOKENS = ("1", "true", "si", "sí", "yes")
FALSE_TOKENS = ("0", "false", "no", "n")
BLANK_TOKENS = ("", "nan", "none")

# Columns known only after a process closes (never model inputs).
AFTER_CLOSE = (
    "respuestas_al_procedimiento",
    "conteo_de_respuestas_a_ofertas",
    "valor_total_adjudicacion",
    "valor_adjudicado_total",
    "fecha_adjudicacion",
    "nombre_del_proveedor",
    "nit_del_proveedor_adjudicado",
    "proveedores_con_invitacion",
    "proveedores_unicos_con",
)


# --- coercion -------------------------------------------------------------


def to_number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def to_timestamp(c: Column) -> Column:
    return F.trim(c).try_cast("timestamp_ntz")


def to_cents(x: Column) -> Column:
    """Half-up rounding to cents, as exact money."""
    return (F.floor(x * 100.0 + 0.5) / 100.0).cast("decimal(28,2)")


def flag_strict(c: Column) -> Column:
    """True only for a known spelling; missing is false (market tables)."""
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_TOKENS), F.lit(False))


def flag_lenient(c: Column) -> Column:
    """Missing or blank keeps the row (network tables)."""
    t = F.lower(F.trim(c))
    return F.when(c.isNull() | t.isin(*BLANK_TOKENS), True).otherwise(t.isin(*TRUE_TOKENS))


def flag_si_no(c: Column) -> Column:
    return F.when(c == "Si", True).when(c == "No", False)


def supplier_key(tax_id: Column, name: Column) -> Column:
    return F.coalesce(tax_id.cast("string"), name)


def supplier_label(tax_id: Column, name: Column) -> Column:
    return F.coalesce(name, tax_id.cast("string"))


def norm_tax_id(raw: Column) -> Column:
    """``0860.0`` and ``860`` become one key; blanks become the empty string."""
    # every step uses its argument once: the planner would evaluate it again for each further use
    s = F.trim(F.coalesce(raw, F.lit("")))
    digits = F.regexp_replace(s, r"^0*(\d+?)(?:\.0+)?$", "$1")
    return F.regexp_replace(digits, "(?i)^(?:" + "|".join(t for t in BLANK_TOKENS if t) + ")$", "")


def segment_code(c: Column) -> Column:
    return F.trim(F.regexp_replace(c.cast("string"), r"\.0$", ""))


def label_of(c: Column, labels: Mapping[str, str]) -> Column:
    """Lookup with the value itself as fallback."""
    if not labels:
        return c
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


# --- plausibility ---------------------------------------------------------


def implausible(
    value: Column, base: Column, rule: str = "base_floor", cap: float = 1e13, ratio: float = 100, floor: float = 1e6
) -> Column:
    """``base_floor``: the ratio counts only above a serious base price.
    ``base_min_one``: a base below 1 counts as 1. A null base never flags."""
    if rule == "base_floor":
        relative = (base > F.lit(floor)) & (value > F.lit(ratio) * base)
    elif rule == "base_min_one":
        relative = base.isNotNull() & (value > F.lit(ratio) * F.greatest(base, F.lit(1)))
    else:
        raise ValueError(f"unknown plausibility rule {rule}")
    return F.coalesce(value > F.lit(cap), F.lit(False)) | F.coalesce(relative, F.lit(False))


def threshold_ladder(df: DataFrame, value: str, cutoffs: Sequence[float]) -> DataFrame:
    """Rows and money above each cutoff, in one pass."""
    aggs = []
    for i, c in enumerate(cutoffs):
        above = F.col(value) > F.lit(c)
        aggs += [
            F.count_if(above).alias(f"n{i}"),
            F.coalesce(F.sum(F.when(above, F.col(value))), F.lit(0)).cast("double").alias(f"v{i}"),
        ]
    rows = [
        F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"n{i}").alias("n_above"), F.col(f"v{i}").alias("value_above"))
        for i, c in enumerate(cutoffs)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def flag_processes(processes: DataFrame, flagged_lines: DataFrame, own_rule: Column) -> DataFrame:
    """A process is flagged by any of its lines or by its own totals."""
    ids = flagged_lines.select("process_id").distinct().withColumn("_hit", F.lit(True))
    out = processes.join(ids, "process_id", "left").withColumn("by_lines", F.coalesce("_hit", F.lit(False)))
    return out.withColumn("flagged", F.col("by_lines") | own_rule).drop("_hit")


# --- filters --------------------------------------------------------------


def awarded_lines(df: DataFrame) -> DataFrame:
    return df.where(F.col("awarded") & F.col("value").isNotNull() & (F.col("value") > 0))


def competitive_universe(df: DataFrame, methods: Sequence[str]) -> DataFrame:
    return df.where(F.col("method").isin(*methods) & F.col("published_at").isNotNull())


def censor_filter(df: DataFrame, terminal_negative: Sequence[str]) -> DataFrame:
    """Open processes are dropped: their outcome is not known yet."""
    return df.where(F.col("awarded") | F.col("state").isin(*terminal_negative))


def resolved_subset(df: DataFrame, summary: str, state: str, word: str = "adjudicado", closed: str = "Cancelado") -> DataFrame:
    return df.where(
        F.coalesce(F.lower(F.col(summary)).contains(word), F.lit(False))
        | F.coalesce(F.col(state) == closed, F.lit(False))
    )


def drop_after_close(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Leakage guard for model inputs."""
    return df.drop(*AFTER_CLOSE, *extra)


def assert_no_leakage(df: DataFrame, extra: Sequence[str] = ()) -> None:
    found = sorted(set(df.columns) & {*AFTER_CLOSE, *extra})
    if found:
        raise ValueError(f"columns known only after closing: {found}")


def bucket_tail(df: DataFrame, column: str, k: int, out: str, other: str = "OTRO") -> DataFrame:
    """Keep the ``k`` most frequent categories; everything else, nulls too, is ``other``."""
    top = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), column)
        .limit(k)
        .select(F.col(column).alias("_top"))
    )
    # k rows by construction
    joined = df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left")
    return joined.withColumn(out, F.coalesce("_top", F.lit(other))).drop("_top")


def drop_incomplete_last(
    panel: DataFrame, keys: Sequence[str], month: str = "month", value: str = "y", share: float = 0.4, min_points: int = 14
) -> DataFrame:
    """Drop a series' last month when it is far below its calendar peers.

    A series has one row per month, so its window is bounded by the calendar.
    """
    keys = list(keys)
    series = Window.partitionBy(*keys)
    last = F.max(month).over(series)
    peer = (F.month(month) == F.month(last)) & (F.col(month) != last)
    marked = panel.select(
        "*",
        (F.col(month) == last).alias("_last"),
        F.count(F.lit(1)).over(series).alias("_n"),
        peer.alias("_peer"),
    ).withColumn("_avg", F.avg(F.when(F.col("_peer"), F.col(value).cast("double"))).over(series))
    bad = (
        F.col("_last")
        & (F.col("_n") >= min_points)
        & F.coalesce((F.col("_avg") > 0) & (F.col(value) < F.lit(share) * F.col("_avg")), F.lit(False))
    )
    return marked.where(~bad).select(*panel.columns)


# --- process level --------------------------------------------------------


def line_to_process(lines: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per process: money awarded, distinct winners, any award, lots."""
    exprs = {
        "value": lambda: F.coalesce(F.sum(F.when(F.col("awarded"), F.col("value"))), F.lit(0)).cast("decimal(28,2)"),
        "awarded": lambda: F.bool_or("awarded"),
        "n_suppliers": lambda: F.countDistinct(F.when(F.col("awarded"), F.col("supplier_id"))),
        "lots": lambda: F.count(F.lit(1)),
        "segment": lambda: F.min("segment"),
        "duration": lambda: F.max("duration"),
    }
    aggs = [exprs[c]().alias(c) for c in cols if c in exprs]
    if not aggs:
        return lines.select("process_id").distinct()
    return lines.groupBy("process_id").agg(*aggs)


def deflate(df: DataFrame, date: str, money: Sequence[str], index: DataFrame, base_month: str) -> DataFrame:
    """Constant-price columns ``<c>_real``; a month outside the index stays null.

    The index has one row per month; a repeated month or a missing base month is
    an error, raised by Spark itself while the query runs.
    """
    months = index.groupBy("month").agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("price index repeats a month")).cast("double"))
        .otherwise(F.max("index_value"))
        .alias("index_value")
    )
    base = (
        index.where(F.col("month") == F.to_date(F.lit(base_month)))
        .agg(F.coalesce(F.max("index_value"), F.raise_error(F.lit("no price index for the base month")).cast("double")))
        .scalar()
    )
    factors = months.select(F.col("month").alias("_month"), (base / F.col("index_value")).alias("factor"))
    out = df.join(factors, F.trunc(F.col(date), "month") == F.col("_month"), "left").drop("_month")
    return out.withColumns(
        {f"{c}_real": to_cents(F.col(c).cast("double") * F.col("factor")) for c in money}
    )


def flag_mega(df: DataFrame, value: str = "value_real", q: float = 0.995) -> DataFrame:
    """Awarded, plausible, one supplier, above the exact quantile of such awards."""
    ok = ~F.col("implausible") & F.col("awarded")
    limit = exact_percentiles(df.where(ok).select(value), value, {"q": q}).select("q").scalar()
    return df.withColumn(
        "is_mega",
        F.coalesce(ok & (F.col("n_suppliers") == 1) & (F.col(value).cast("double") > limit), F.lit(False)),
    )
