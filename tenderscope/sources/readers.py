"""Readers for open-data CSV, price indexes, nested profile JSON and page tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tenderscope.functions import text
from tenderscope.functions.arrays import let
from tenderscope.operators import cleaning, profiles
from tenderscope.sources import schemas


def read_award_lines(spark: SparkSession, path: str, columns: Sequence[str] | None = None, missing_award_keeps: bool = False) -> DataFrame:
    """Award lines from the open-data CSV with canonical names and lenient types.

    ``columns`` (canonical names) prunes the scan. Bad numbers and dates become
    null, tax ids stay text. The award flag is false where missing, or true with
    ``missing_award_keeps`` (the network's reading).
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    out = []
    for source, name in schemas.AWARD_COLUMNS.items():
        if source not in raw.columns or (columns is not None and name not in columns):
            continue
        c = F.col(f"`{source}`")
        if name in schemas.MONEY:
            c = F.trim(F.replace(c, F.lit(","), F.lit(""))).try_cast("decimal(24,2)")
        elif name in schemas.NUMBERS:
            c = cleaning.to_number(c)
        elif name in schemas.DATES:
            c = cleaning.to_timestamp(c)
        elif name == "segment":
            c = cleaning.segment_code(c)
        out.append(c.alias(name))
    if columns is None or "awarded" in columns:
        flag = F.lit(None).cast("string")
        if "adjudicado_bool" in raw.columns:
            flag = F.col("adjudicado_bool")
        elif "adjudicado" in raw.columns:
            flag = F.col("adjudicado")
        read = cleaning.flag_lenient if missing_award_keeps else cleaning.flag_strict
        out.append(read(flag).alias("awarded"))
    return raw.select(*out)


def segment_of_category(category: "F.Column") -> "F.Column":
    """First two digits of a category code such as ``V1.80101500``."""
    return F.substring(F.regexp_replace(category, r"^V1\.", ""), 1, 2)


def read_price_index(spark: SparkSession, path: str) -> DataFrame:
    """``month, index_value`` from a CSV of year, month and index."""
    raw = spark.read.option("header", True).schema("anio int, mes int, indice double").csv(path)
    month = F.make_date("anio", "mes", F.lit(1))
    return raw.select(month.alias("month"), F.col("indice").alias("index_value")).dropna().dropDuplicates(["month"])


def load_profiles(spark: SparkSession, folder: str, multi_line: bool = False, min_chars: int = 40) -> DataFrame:
    """Profile documents keyed by id (or file stem) with their canonical text."""
    raw = spark.read.schema(schemas.PROFILE).option("multiLine", multi_line).json(folder)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    named = raw.withColumn("id", F.coalesce(F.nullif(F.trim("id"), F.lit("")), stem))
    return profiles.with_canonical_text(named).where(F.length("canonical_text") >= min_chars)


def load_extractions(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    raw = spark.read.schema(schemas.EXTRACTION).option("multiLine", multi_line).json(folder)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"(_nlp)?\.json$", "")
    return raw.withColumn("convocatoria", F.coalesce("convocatoria", stem))


def optional(spark: SparkSession, read: Callable[[], DataFrame], schema: str | T.StructType) -> DataFrame:
    """A source that may not exist yet: an absent path reads as an empty table."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            raise
        return spark.createDataFrame([], schema)


def page_rows(
    pages: DataFrame, key: str, html: str, url: str, number: str, id_rules: Sequence[tuple[str, str]], min_cells: int = 5
) -> DataFrame:
    """Links of every page with at least ``min_cells`` of them, and the page's stable id."""
    pattern = F.lit(r'<a href="([^"]*)">([^<]*)</a>')
    cells = F.arrays_zip(
        F.regexp_extract_all(F.col(html), pattern, F.lit(1)).alias("href"),
        F.regexp_extract_all(F.col(html), pattern, F.lit(2)).alias("title"),
    )
    call = F.coalesce(F.nullif(F.trim(F.col(number)), F.lit("")), text.id_from_url(F.col(url), id_rules))
    rows = pages.select(key, call.alias("call_id"), cells.alias("_cells")).where(F.size("_cells") >= min_cells)
    return rows.select(key, "call_id", F.posexplode("_cells").alias("pos", "_c")).select(
        key, F.col("pos").cast("long").alias("pos"), F.col("_c.href").alias("href"), F.trim("_c.title").alias("title"), "call_id"
    )


def plain_text(html: Column) -> Column:
    """Text of a piece of markup: tags out, the usual entities decoded, white space collapsed."""
    t = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def table_cells(html: Column) -> Column:
    """Rows of the first table as arrays of cells (inner markup); the header row is left out.

    Rows are those of the body where one is marked, else all but the first. Cells and rows
    end where the next begins, so closing tags may be missing; comments do not count.
    """
    shown = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    found = F.regexp_extract(shown, r"(?is)<table\b[^>]*>(.*?)(?:</table\s*>|\z)", 1)

    def rows(inner: Column) -> Column:
        body = F.regexp_extract(inner, r"(?is)<tbody\b[^>]*>(.*?)(?:</tbody\s*>|\z)", 1)
        marked = inner.rlike(r"(?i)<tbody\b")
        parts = F.split(F.when(marked, body).otherwise(inner), r"(?i)<tr\b[^>]*>")
        return F.slice(parts, F.when(marked, F.lit(2)).otherwise(3), F.size(parts))

    return let(found, lambda t: F.transform(rows(t), lambda r: let(F.split(r, r"(?i)<td\b[^>]*>"), lambda c: F.slice(c, F.lit(2), F.size(c)))))


def listing_rows(pages: DataFrame, key: str, html: str, base_url: str, id_rules: Sequence[tuple[str, str]], min_cells: int = 5) -> DataFrame:
    """Calls of listing pages: ``number, title, url, description, resources, opening``, one row for each url.

    A row needs ``min_cells`` cells. Its link is that of the second cell, relative ones hung on
    ``base_url``; a missing number is taken from it. Of rows with one url (or none) the first
    stays, by page and place; it is reduced before the shuffle, however often a url is listed.
    """
    cells = pages.select(key, F.posexplode(table_cells(F.col(html))).alias("pos", "c")).where(F.size("c") >= min_cells)
    link = F.regexp_extract("href_cell", r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)""", 1)
    anchor = F.regexp_extract("href_cell", r"(?is)<a\b[^>]*>(.*?)(?:</a\s*>|\z)", 1)
    linked = F.col("href_cell").rlike(r"(?i)<a\b[^>]*\bhref")
    wide = cells.select(key, "pos", F.get("c", F.lit(1)).alias("href_cell"), *[plain_text(F.get("c", F.lit(i))).alias(f"t{i}") for i in (0, 2, 3, 4)])
    href = F.replace(link, F.lit("&amp;"), F.lit("&"))
    full = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("/"), F.concat(F.lit(base_url), href)).otherwise(F.concat(F.lit(base_url + "/"), href))
    rows = wide.withColumn("url", F.when(linked, full)).withColumn("title", plain_text(F.when(linked, anchor).otherwise(F.col("href_cell"))))
    number = F.coalesce(F.nullif(F.col("t0"), F.lit("")), text.id_from_url(F.col("url"), id_rules), F.lit(""))
    fields = [number.alias("number"), "title", F.col("t2").alias("description"), F.col("t3").alias("resources"), F.col("t4").alias("opening")]
    first = rows.groupBy("url").agg(F.min_by(F.struct(*fields), F.struct(key, "pos")).alias("r"))
    return first.select("r.number", "r.title", "url", "r.description", "r.resources", "r.opening")
