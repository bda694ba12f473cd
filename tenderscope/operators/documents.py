"""Sections of long documents: headings, bodies, template coverage, context text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tenderscope.functions.arrays import let
from tenderscope.functions.text import norm_title, norm_upper, section_key, upper_ratio

# Shape of a contents line and of a heading line.
TOC_LINE = r"^(\d{1,2})\.?\s*([A-ZÁÉÍÓÚÑÜ][A-ZÁÉÍÓÚÑÜa-záéíóúñü\s,/()\-]{3,}?)\s*(?:\.{2,}|\s+)\s*(\d{1,3})\s*$"
BODY_LINE = r"^(\d{1,2})\.?\s*([A-ZÁÉÍÓÚÑÜ][A-ZÁÉÍÓÚÑÜ\s,/()\-]{3,100}?)(?:\s+\d{1,3})?\s*$"

# Words in a title that make its section a fallback for a key.
CONTEXT_WORDS: Mapping[str, Sequence[str]] = {
    "objetivo": ("OBJETIVO", "OBJETIVOS", "PRESENTACION"),
    "dirigida_a": ("DIRIGID", "PARTICIPACION", "MECANISMO", "ACTORES", "ELEGIBLE", "PRESENTACION"),
    "lineas_tematicas": ("OBJETIVO", "OBJETIVOS", "PARTICIPACION", "DEMANDA", "TERRITORIAL", "TEMATIC", "LINEA", "EJE"),
    "requisitos": ("REQUISITO", "HABILITANTE", "DOCUMENTO"),
    "criterios": ("EVALUACION", "EVALUACI", "CRITERIO", "PUNTAJE", "CALIFIC"),
    "rechazo": ("RECHAZO", "INHABIL", "CAUSAL", "CONDICION"),
    "financiacion": ("FINANCI", "RECURSO", "PRESUP", "CRONOGRAMA", "PLAZO", "DURACION", "MONTO", "VALOR", "COSTO"),
}


def _heading(line: Column, i: Column, pattern: str) -> Column:
    s = F.trim(line)
    title = F.trim(F.regexp_extract(s, pattern, 2))
    return F.struct(
        i.alias("line"),
        F.regexp_extract(s, pattern, 1).try_cast("int").alias("number"),
        title.alias("title"),
        norm_title(title).alias("title_norm"),
    )


def contents_entries(lines: Column) -> Column:
    """Contents-table entries from number 1 on, numbers rising; an early restart at 1 wins."""
    hits = F.filter(
        F.transform(lines, lambda s, i: F.when(F.trim(s).rlike(TOC_LINE), _heading(s, i, TOC_LINE))),
        lambda h: h.isNotNull() & (upper_ratio(h["title"]) >= 0.7) & (F.length(h["title_norm"]) >= 5),
    )

    def first_one(a: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter(a, lambda h: h["number"] == 1), F.lit(1))["line"], F.lit(0))

    def grow(seq: Column, h: Column, start: Column) -> Column:
        return (
            F.when(h["line"] < start, seq)
            .when((F.size(seq) == 0) | (h["number"] > F.try_element_at(seq, F.lit(-1))["number"]), F.concat(seq, F.array(h)))
            .when((h["number"] == 1) & (F.size(seq) < 5), F.array(h))
            .otherwise(seq)
        )

    return let(
        hits,
        lambda a: let(
            first_one(a), lambda start: F.aggregate(a, F.slice(a, F.lit(1), F.lit(0)), lambda seq, h: grow(seq, h, start))
        ),
    )


def body_headings(lines: Column) -> Column:
    return F.filter(
        F.transform(
            lines,
            lambda s, i: F.when(F.trim(s).rlike(BODY_LINE) & ~F.trim(s).rlike(TOC_LINE), _heading(s, i, BODY_LINE)),
        ),
        lambda h: h.isNotNull() & (upper_ratio(h["title"]) >= 0.85) & (F.length(h["title_norm"]) >= 4),
    )


def longest_chain(items: Column) -> Column:
    """From every start take each later heading with a higher number and a new title; keep the longest run.

    What a run takes next depends on its last heading alone, so runs that meet in a heading
    go on as one: the longest of them, the earliest start among equals. One pass keeps the
    runs by their last headings (about as many as there are different numbers, however many
    headings); the best start is then followed once.
    """
    marked = F.transform(items, lambda h, i: F.struct(i.alias("i"), h["number"].alias("number"), h["title_norm"].alias("title")))

    def takes(last: Column, h: Column) -> Column:
        return F.coalesce((last["number"] < h["number"]) & (last["title"] != h["title"]), F.lit(False))

    def visit(runs: Column, h: Column) -> Column:
        met = F.transform(F.filter(runs, lambda r: takes(r, h)), lambda r: F.struct((r["size"] + 1).alias("size"), r["start"].alias("start")))
        fresh = F.array(F.struct(F.lit(1).alias("size"), (-h["i"]).alias("start")))
        best = F.array_max(F.concat(fresh, met))
        last = let(best, lambda b: F.struct(b["size"].alias("size"), b["start"].alias("start"), h["number"].alias("number"), h["title"].alias("title")))
        return F.concat(F.filter(runs, lambda r: ~takes(r, h)), F.array(last))

    def follow(start: Column) -> Column:
        return F.aggregate(
            F.slice(items, start + 2, F.size(items)),
            F.array(F.get(items, start)),
            lambda seq, h: let(
                F.element_at(seq, -1),
                lambda last: F.when(
                    (h["number"] > last["number"]) & (h["title_norm"] != last["title_norm"]), F.concat(seq, F.array(h))
                ).otherwise(seq),
            ),
        )

    none = F.lit(None).cast("array<struct<size:int,start:int,number:int,title:string>>")
    runs = F.aggregate(marked, F.coalesce(none, F.array().cast("array<struct<size:int,start:int,number:int,title:string>>")), visit)
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["size"].alias("size"), r["start"].alias("start"))))
    return F.when(F.size(items) > 0, let(-best["start"], follow)).otherwise(items)


def _slice_sections(lines: Column, chain: Column) -> Column:
    def section(h: Column, i: Column) -> Column:
        end = F.coalesce(F.get(chain, i + 1)["line"], F.size(lines))
        return let(
            F.trim(F.array_join(F.slice(lines, h["line"] + 2, end - h["line"] - 1), "\n")),
            lambda body: F.struct(
                h["number"].alias("number"),
                h["title"].alias("title"),
                h["title_norm"].alias("title_norm"),
                body.alias("text"),
                F.length(body).alias("n_chars"),
            ),
        )

    return F.transform(chain, section)


def _related(h: Column, t: Column) -> Column:
    a, b = h["title_norm"], t["title_norm"]
    return (a == b) | a.startswith(b) | b.startswith(a)


def sections_of(text: Column) -> Column:
    """Array of sections: number, title, normalised title, text and length.

    Headings listed in the contents table are preferred, unless they leave too few.
    """

    def pick(toc: Column, heads: Column, listed: Column) -> Column:
        few = (F.size(toc) > 0) & (F.size(listed) < F.greatest(F.lit(5), F.floor(F.size(toc) / 2)))
        return F.when(few, longest_chain(heads)).otherwise(listed)

    def choose(toc: Column, heads: Column) -> Column:
        known = F.filter(heads, lambda h: (F.size(toc) == 0) | F.exists(toc, lambda t: _related(h, t)))
        return let(let(known, longest_chain), lambda listed: pick(toc, heads, listed))

    def split(lines: Column) -> Column:
        chain = let(contents_entries(lines), lambda toc: let(body_headings(lines), lambda heads: choose(toc, heads)))
        return let(chain, lambda c: _slice_sections(lines, c))

    return let(F.split(text, "\n"), split)


def with_sections(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("sections", sections_of(F.col(text)))


def section_rows(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.posexplode("sections").alias("pos", "_s")).select(key, "pos", "_s.*")


def canonical_sections(rows: DataFrame, key: str, pos: str, title: str) -> DataFrame:
    """First section of each canonical key per document."""
    keyed = rows.withColumn("section_key", section_key(F.col(title))).where(F.col("section_key").isNotNull())
    rest = [c for c in rows.columns if c != key]
    return keyed.groupBy(key, "section_key").agg(F.min_by(F.struct(*rest), pos).alias("_f")).select(key, "section_key", "_f.*")


def fingerprint(titles: Column) -> Column:
    return F.array_join(F.transform(titles, lambda t, i: F.concat((i + 1).cast("string"), F.lit("."), t)), " > ")


def structure_groups(docs: DataFrame, titles: str) -> DataFrame:
    """Documents per section structure."""
    fp = F.coalesce(F.nullif(fingerprint(F.col(titles)), F.lit("")), F.lit("(sin secciones)"))
    return docs.groupBy(fp.alias("fingerprint")).agg(F.count(F.lit(1)).alias("n_docs"))


def frequent_titles(docs: DataFrame, titles: str, k: int = 40) -> DataFrame:
    return (
        docs.select(F.explode(titles).alias("title")).groupBy("title").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "title").limit(k)
    )


def template_coverage(titles: Column, template: Sequence[str]) -> Column:
    """Coverage, missing and extra titles against a template."""
    t = F.array(*[F.lit(x) for x in template])
    return F.struct(
        F.round(F.size(F.array_intersect(titles, t)) / float(len(template)), 3).alias("coverage"),
        (titles == t).alias("exact"),
        F.array_join(F.filter(t, lambda x: ~F.array_contains(titles, x)), ";").alias("missing"),
        F.array_join(F.filter(titles, lambda x: ~F.array_contains(t, x)), ";").alias("extra"),
    )


def section_context(sections: Column, key: str) -> Column:
    """Text for a key: its own section, else sections with a related title, else all of them."""
    filled = F.filter(sections, lambda s: F.trim(s["text"]) != "")
    own = F.try_element_at(F.filter(sections, lambda s: section_key(s["title"]) == key), F.lit(1))["text"]
    words = CONTEXT_WORDS.get(key, ())
    pattern = "|".join(words) if words else r"(?!)"

    def joined(parts: Column) -> Column:
        return F.nullif(
            F.array_join(
                F.transform(parts, lambda s: F.concat(F.lit("Sección: "), F.coalesce(s["title"], F.lit("Sin título")), F.lit("\n"), F.trim(s["text"]))),
                "\n\n",
            ),
            F.lit(""),
        )

    related = F.filter(filled, lambda s: norm_upper(s["title"]).rlike(pattern))
    any_related = F.exists(sections, lambda s: norm_upper(s["title"]).rlike(pattern))
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), F.when(any_related, F.coalesce(joined(related), F.lit(""))), joined(filled), F.lit(""))


# Header cells of a budget table.
BUDGET_HEADERS = ("rubros", "rubro", "descripción / exclusiones", "descripcion")


def budget_items(tables: DataFrame, key: str, cells: str) -> DataFrame:
    """Item and description from tables of rows of cells; headers and incomplete rows dropped."""
    rows = tables.select(key, F.explode(cells).alias("_t")).select(key, F.explode("_t").alias("_r"))

    def cell(i: int) -> Column:
        return F.replace(F.trim(F.get("_r", F.lit(i))), F.lit("\n"), F.lit(" "))

    out = rows.select(key, cell(0).alias("item"), cell(1).alias("description"))
    return out.where((F.col("item") != "") & (F.col("description") != "") & ~F.lower("item").isin(*BUDGET_HEADERS))
