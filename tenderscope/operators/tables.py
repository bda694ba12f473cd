"""Keyed table maintenance, reshaping and small relational building blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Append ``new`` to ``old`` and keep the last row per key.

    ``max_by`` combines map-side, so a key with many versions never fills a task.
    """
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    latest = both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("_load", *seq)).alias("_r")
    )
    return latest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_over(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones with the same key."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, F.struct(*rest).alias("_n"))
    o = old.select(*keys, F.struct(*rest).alias("_o"))
    joined = o.join(n, list(keys), "full").withColumn("_r", F.coalesce("_n", "_o"))
    return joined.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def pending_keys(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def new_vs_known(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Every remote key once, marked new or known."""
    r = remote.select(key).distinct()
    known = local.select(key).distinct().withColumn("_k", F.lit(True))
    return r.join(known, key, "left").select(
        key, F.when(F.col("_k"), F.lit("known")).otherwise(F.lit("new")).alias("status")
    )


def merge_formats(docs: DataFrame, keys: Sequence[str], name: str, url: str, pos: str, editable: Column) -> DataFrame:
    """One row per document: the first name seen and the last URL of each format."""
    return docs.groupBy(*keys).agg(
        F.min_by(name, pos).alias(name),
        F.max_by(F.when(~editable, F.col(url)), F.when(~editable, F.col(pos))).alias("url_pdf"),
        F.max_by(F.when(editable, F.col(url)), F.when(editable, F.col(pos))).alias("url_editable"),
    )


def expand_urls(docs: DataFrame, columns: Sequence[tuple[str, str]], keep: Sequence[str]) -> DataFrame:
    """One row per non-blank URL column, with its format."""
    items = F.array(*[F.struct(F.lit(fmt).alias("format"), F.trim(F.col(c)).alias("url")) for c, fmt in columns])
    return docs.select(*keep, F.inline(items)).where(F.col("url") != "")


def enrich_left(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join where colliding right columns take a suffix."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c != key}
    return left.join(right.withColumnsRenamed(clash), key, "left")


def order_by_listing(df: DataFrame, listing: DataFrame, key: str, position: str, unknown: int = 10_000) -> DataFrame:
    """Attach the position of ``key`` in a listing; unknown keys come last."""
    pos = listing.groupBy(key).agg(F.min(position).alias("_pos"))
    return df.join(pos, key, "left").withColumn("list_rank", F.coalesce("_pos", F.lit(unknown))).drop("_pos")


def first_n_keys(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """All rows of the first ``n`` distinct keys in the given order."""
    firsts = (
        df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).orderBy("_first", key).limit(n).select(key)
    )
    return df.join(F.broadcast(firsts), key, "left_semi")  # n rows by construction


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of every value, null included."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 6))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column in one pass."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in df.columns])
    return one.select("_rows", F.inline(rows)).select(
        "column_name", "n_null", F.round(F.col("n_null") * 100.0 / F.col("_rows"), 6).alias("pct_null")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy, counted by grouping on every column."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def histogram(df: DataFrame, column: str, width: int) -> DataFrame:
    start = (F.floor(F.col(column) / width) * width).cast("long")
    return df.where(F.col(column).isNotNull()).groupBy(start.alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """Reproducible sample without replacement: the n smallest seeded hashes."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def prefix_share(df: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("pct", F.round(F.col(count) * 100.0 / F.sum(count).over(w), 6))
