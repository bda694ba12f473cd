"""Text expressions: cleaning, classification and extraction, all JVM-side."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tenderscope.functions.dates import MONTHS

#: Latin letters that decompose into a plain letter and marks, by that rule.
_ACCENTED = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.normalize("NFD", c)[0] < "\x80")
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def first_match(subject: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Ordered regex rules; the first that matches gives the label."""
    out = None
    for label, pattern in rules:
        hit = subject.rlike(pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clip_text(c: Column, n: int) -> Column:
    s = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def short_label(c: Column, n: int) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def strip_accents(c: Column) -> Column:
    """Plain letters for accented Latin ones, composed or followed by combining marks."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def norm_upper(c: Column) -> Column:
    return F.upper(collapse(strip_accents(F.coalesce(c, F.lit("")))))


def norm_lower(c: Column) -> Column:
    return F.lower(collapse(strip_accents(F.coalesce(c, F.lit("")))))


def norm_title(c: Column) -> Column:
    """Upper case, no accents or punctuation, with the usual spelling variants unified."""
    s = collapse(F.regexp_replace(F.upper(strip_accents(c)), r"[^A-Z0-9_\s]", " "))
    s = F.replace(s, F.lit("DIRIGIDO A"), F.lit("DIRIGIDA A"))
    s = F.replace(s, F.lit("LINEA TEMATICA"), F.lit("LINEAS TEMATICAS"))
    full = "OBSERVACIONES AL LISTADO DE HABILITADOS Y ELEGIBLES"
    s = F.regexp_replace(s, r"^OBSERVACIONES LISTADO\b", full)
    return F.regexp_replace(s, r"^OBSERVACIONES AL LISTADO DE ELEGIBLES\b", full)


def upper_ratio(c: Column) -> Column:
    """Share of letters in upper case; 0 without letters."""
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    upper = F.length(F.regexp_replace(c, r"\P{Lu}", ""))
    return F.coalesce(F.try_divide(upper, letters), F.lit(0.0))


def glued_text(c: Column, sample: int = 4000, minimum: int = 15) -> Column:
    """True where words seem glued: too few short stop words stand alone."""
    head = F.substring(F.coalesce(c, F.lit("")), 1, sample)
    hits = F.regexp_count(head, F.lit(r"(?iU)\b(de|la|el|en|y|del|los|las|para|que|con|una|por)\b"))
    return (F.trim(head) == "") | (hits < minimum)


def degenerate_text(c: Column, max_chars: int = 9000, probe: int = 40, repeats: int = 4) -> Column:
    """Overlong, leaked reasoning, or a passage repeated in a loop."""
    n = F.length(c)
    start = (F.floor(n / 3) + 1).cast("int")
    piece = F.substring(c, start, F.lit(probe))
    times = (n - F.length(F.replace(c, piece, F.lit("")))) / F.lit(probe)
    looped = (n > probe * repeats) & (F.trim(piece) != "") & (times >= repeats)
    return (n > max_chars) | c.rlike(r"(?i)self-correction|draft (&|and) refinement|as an ai") | looped


def node_slug(kind: str, c: Column) -> Column:
    s = F.substring(F.regexp_replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), r"[^a-zA-Z0-9]+", "_"), 1, 48)
    return F.concat(F.lit(f"{kind}:"), F.coalesce(F.nullif(s, F.lit("")), F.lit("X")))


def clean_person_name(name: Column, *fallbacks: Column) -> Column:
    """Remove identifiers and links, turn slugs into words; ``Docente`` when nothing is left."""

    def usable(c: Column) -> Column:
        t = F.trim(c)
        return F.when(~F.lower(t).isin("", "nan", "none"), t)

    def humanise(c: Column) -> Column:
        return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))

    slug = r"^[a-z0-9]+(-[a-z0-9]+)+$"
    raw = F.coalesce(usable(name), *[usable(f) for f in fallbacks], F.lit(""))
    for pattern in (
        r"(?i)https?://(www\.)?orcid\.org/\S+",
        r"(?i)\s*[|/]\s*orcid\.org/\S+",
        r"(?i)\borcid\.org/\S+",
        r"(?i)\bORCID\s*[:=]?\s*\d{4}-\d{4}-\d{4}-\d{3}[\dXx]\b",
        r"\b\d{4}-\d{4}-\d{4}-\d{3}[\dXx]\b",
        r"\s*[|/]\s*$",
    ):
        raw = F.regexp_replace(raw, pattern, "")
    raw = F.regexp_replace(F.regexp_replace(raw, r"\s{2,}", " "), r"^[ \-|/]+|[ \-|/]+$", "")
    one_word = F.contains(raw, F.lit("-")) & ~F.contains(raw, F.lit(" ")) & (F.lower(raw) == raw)
    spaced = F.regexp_replace(raw, r"([A-Za-zÁÉÍÓÚáéíóúÑñ])-(?=[A-Za-zÁÉÍÓÚáéíóúÑñ])", "$1 ")
    done = F.when(raw.rlike(slug) | one_word, humanise(raw)).otherwise(spaced)
    last = [F.when(F.trim(f).rlike(slug), humanise(F.trim(f))).otherwise(F.nullif(F.trim(f), F.lit(""))) for f in fallbacks]
    return F.coalesce(F.nullif(done, F.lit("")), *last, F.lit("Docente"))


# Words and acronyms that mark a higher-education institution.
IES_WORDS = (
    r"(?i)\bUNIVERSIDAD\b|\bCOLEGIO\s+MAYOR\b|\bPOLIT[EÉ]CNICO\b|\bESCUELA\s+SUPERIOR\b"
    r"|\bINSTITUTO\s+TECNOL|\bFUNDACI[OÓ]N\s+UNIVERSIT|\bCORPORACI[OÓ]N\s+UNIVERSIT"
    r"|\bINSTITUCI[OÓ]N\s+UNIVERSIT|\bCENTRO\s+DE\s+FORMACI"
)
IES_ACRONYMS = (
    "UNISALLE", "UNIMINUTO", "UPTC", "UIS", "UDEA", "EAFIT", "ICESI", "JAVERIANA", "EXTERNADO", "CES",
    "ECCI", "UPB", "UTB", "USB", "UAN", "UDCA", "UCATOLICA", "CUN", "UNAB", "UNINORTE", "UNIVALLE",
    "UNAL", "UNIANDES", "UNBOSQUE", "UDES", "UMNG", "ESAP", "ITM", "PASCUAL BRAVO", "POLI",
)


def is_university(name: Column, words: str = IES_WORDS, acronyms: Sequence[str] = IES_ACRONYMS) -> Column:
    """Institution test on a legal name: words, a known acronym, or a ``UNI…`` compound."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    key = collapse(F.regexp_replace(F.upper(raw), r"[^A-Z0-9ÁÉÍÓÚÑÜ\s]", ""))
    known = F.array(*[F.lit(a) for a in acronyms])
    compact = F.replace(key, F.lit(" "), F.lit(""))
    return (raw != "") & (
        raw.rlike(words)
        | F.array_contains(known, key)
        | F.arrays_overlap(F.split(key, " "), known)
        | compact.rlike(r"^UNI[A-ZÁÉÍÓÚÑÜ]{3,}$")
    )


# Document classes, first match wins.
DOCUMENT_RULES = (
    ("resolucion", r"(?i)resoluci[oó]n"),
    ("terminos_referencia", r"(?i)t[eé]rminos?\s+de\s+referencia"),
    ("modificacion", r"(?i)nota\s+aclaratoria|adenda|adendo|modificaci[oó]n"),
    ("resultado", r"(?i)listado|resultados?\s+(preliminar|definitiv)"),
    ("comunicado", r"(?i)respuesta\s+(a\s+)?observaciones|respuesta\s+radicado|comunicado"),
    ("anexo", r"(?i)anexo[\s_]*(\d+)"),
)
ANNEX_RULES = (
    ("aval_institucional", r"(?i)aval|compromiso institucional|gobernanza"),
    ("talento_hv", r"(?i)hoja de vida|investigador|jóvenes investigadores|semilleros"),
    ("finanzas", r"(?i)presupuesto|rubros? financiables?"),
    ("tecnico", r"(?i)contenido t[eé]cnico|documento t[eé]cnico|madurez tecnol[oó]gica|categorizaci[oó]n"),
    ("apropiacion_social", r"(?i)apropiaci[oó]n social|divulgaci[oó]n"),
    ("poblacion_especifica", r"(?i)enfoque[\s_]+diferencial|comunidad|territorial"),
    ("procedimental", r"(?i)instructivo|procedimiento|mga"),
    ("alianzas", r"(?i)carta de experiencia|empresa nacional|convenio"),
)


def document_type(name: Column) -> Column:
    return first_match(name, DOCUMENT_RULES, "otro")


def annex_number(name: Column) -> Column:
    return F.when(document_type(name) == "anexo", F.regexp_extract(name, r"(?i)anexo[\s_]*(\d+)", 1))


def annex_subtype(name: Column) -> Column:
    return F.when(document_type(name) == "anexo", first_match(name, ANNEX_RULES, "otro"))


def is_editable(name: Column, url: Column) -> Column:
    return F.contains(F.lower(name), F.lit("editable")) | F.lower(url).rlike(r"\.(doc|docx|xls|xlsx)$")


def document_key(name: Column) -> Column:
    """Name shared by the PDF and the editable copy of one document."""
    base = collapse(F.regexp_replace(name, r"(?i)\(editable\)\.?", ""))
    return F.lower(F.regexp_replace(base, r"[. ]+$", ""))


def is_reference_document(kind: Column, name: Column, *urls: Column) -> Column:
    hit = (kind == "terminos_referencia") | F.coalesce(
        name.rlike(r"(?iU)t[eé]rminos?\s+de\s+referencia|\btdr\b"), F.lit(False)
    )
    for u in urls:
        hit = hit | F.coalesce(u.rlike(r"(?i)(^|/)(tdr[_-]|terminos?(_de)?_referencia)"), F.lit(False))
    return hit


def preferred_url(pdf: Column, editable: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(F.trim(pdf), blank), F.nullif(F.trim(editable), blank))


# Families of calls, first match wins.
CALL_RULES = (
    ("SGR (regalias)", r"(?U)regal|\bsgr\b"),
    ("Becas / formacion", r"beca|caldas|maestr|doctorad"),
    ("Publindex", r"publindex|revistas cient"),
    ("Movilidad academica", r"movilidad"),
    ("Convocatoria (regular)", r"ministerio de ciencia"),
)


def call_type(*parts: Column, rules: Sequence[tuple[str, str]] = CALL_RULES) -> Column:
    s = F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))
    return F.when(F.trim(s) == "", F.lit("sin_dato")).otherwise(first_match(s, rules, "sin_clasificar"))


# Section titles and their canonical keys, first match wins.
SECTION_RULES = (
    ("objetivo", r"^(OBJETIVO|OBJETIVOS|OBJETO)$"),
    ("dirigida_a", r"^(DIRIGID[AO] A|MECANISMOS DE PARTICIPACION)$"),
    (
        "lineas_tematicas",
        r"LINEAS? TEMATICAS|EJES Y LINEAS|EJES TEMATICOS|MODALIDADES DE PARTICIPACION|LINEAS? DE ACCION|^TEMATICAS$",
    ),
    ("requisitos", r"REQUISITOS HABILITANTES|^REQUISITOS$"),
    ("rechazo", r"CAUSALES DE RECHAZO|CONDICIONES DE RECHAZO|CONDICIONES INHABILITANTES|INHABILIDADES"),
    ("financiacion", r"DURACION Y FINANCIACION|DURACION Y RECURSOS|^FINANCIACION"),
    ("criterios", r"CRITERIOS DE EVALUACION"),
)


def section_key(title: Column) -> Column:
    return first_match(norm_upper(title), SECTION_RULES)


def file_name(url: Column) -> Column:
    path = F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("PATH"))), F.lit(""))
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    name = F.coalesce(F.nullif(name, F.lit("")), F.lit("archivo_sin_nombre"))
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def file_extension(url: Column, default: str = ".pdf") -> Column:
    ext = F.regexp_extract(F.lower(file_name(url)), r"[^.](\.[^.]+)$", 1)
    return F.coalesce(F.nullif(ext, F.lit("")), F.lit(default))


def id_from_url(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Stable id from the first URL pattern (one group) that matches."""
    return F.coalesce(
        *[F.when(url.rlike(p), F.concat(F.lit(prefix), F.regexp_extract(url, p, 1))) for p, prefix in rules]
    )


# Where listing URLs carry an id when the number is missing.
LISTING_ID_RULES = ((r"/node/(\d+)", "node_"), (r"(?i)/convocatorias?/(\d+)", ""))


def usable_link(url: Column, old_host: str, current: str, param: str = "cod_rh") -> Column:
    """A profile link that can be followed: http, moved off the old host, carrying its id; else empty."""
    code = F.regexp_extract(url, rf"{param}=(\d+)", 1)
    moved = F.when(
        F.contains(url, F.lit(old_host)), F.when(code != "", F.concat(F.lit(f"{current}?{param}="), code)).otherwise("")
    ).otherwise(url)
    ok = F.lower(url).startswith("http") & F.contains(moved, F.lit(f"{param}="))
    return F.when(F.coalesce(ok, F.lit(False)), moved).otherwise(F.lit(""))


# What a profile link points to, by keyword.
LINK_RULES = (
    ("cvlac", r"cvlac"),
    ("orcid", r"orcid"),
    ("google_scholar", r"scholar"),
    ("scopus", r"scopus"),
    ("pure", r"pure"),
    ("linkedin", r"linkedin"),
)


def link_kind(url: Column) -> Column:
    return first_match(F.lower(url), LINK_RULES, "otros")


def norm_call_id(raw: Column) -> Column:
    s = F.trim(raw.cast("string"))
    number = s.try_cast("double").cast("bigint").cast("string")
    slug = F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.when(s != "", F.coalesce(number, F.nullif(slug, F.lit("")))), F.lit("sin_numero"))


def parse_money(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "").try_cast("double")


# Administrative percentage formulas.
PCT_RULES = (
    ("minimo_obligatorio_pct", r"(?is)m[íi]nimo\s+al?\s+(\d+)\s*%.{0,100}?obligatoria"),
    ("maximo_pct", r"(?is)no\s+podr[áa]\s+ser\s+mayor\s+al\s+(\d+)\s*%"),
    ("tope_pct", r"(?is)no\s+(?:debe\s+)?super(?:e|a)(?:r)?\s+el\s+(\d+)\s*%"),
)


def pct_rules(c: Column) -> Column:
    """Array of (rule, percentage, up to 60 characters before it)."""

    def hits(rule: str, pattern: str) -> Column:
        whole = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        # what stands between the hits, and so before each of them
        gaps = F.split(c, pattern)
        before = F.transform(
            whole,
            lambda _w, i: F.concat(
                F.array_join(F.zip_with(F.slice(gaps, F.lit(1), i), F.slice(whole, F.lit(1), i), lambda g, w: F.concat(g, w)), ""),
                F.get(gaps, i),
            ),
        )

        def one(v: Column, text: Column) -> Column:
            near = F.substr(text, F.greatest(F.length(text) - 59, F.lit(1)))
            context = F.replace(F.trim(F.regexp_replace(near, r"(?U)^\s+|\s+$", "")), F.lit("\n"), F.lit(" "))
            return F.struct(F.lit(rule).alias("rule"), v.cast("int").alias("pct"), context.alias("context"))

        return F.zip_with(value, before, one)

    found = [hits(rule, pattern) for rule, pattern in PCT_RULES]
    return F.concat(*found)


def money_mentions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\$\s?[\d.,]{4,}"), F.lit(0))


def article_title(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r'"([^"]+)"', 1), F.lit(""))


def article_doi(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(c, r"(?i)DOI:\s*([^\s,]+)", 1), r"\.+$", ""), F.lit(""))


def article_year(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)), F.lit(-1))


# Stop words of the keyword shortlist.
KEYWORD_STOP = (
    "para", "con", "del", "los", "las", "que", "como", "entre", "sobre",
    "desde", "hacia", "este", "esta", "estos", "estas", "mediante", "dentro",
)


def keywords(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-záéíóúñ]{6,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*KEYWORD_STOP))


def simplify_category(c: Column) -> Column:
    hit = F.regexp_extract(c, r"Investigador\s+(Junior|Asociado|Senior|Em[eé]rito)", 0)
    return F.coalesce(F.nullif(hit, F.lit("")), F.substring(c, 1, 40))


def term_snippet(text: Column, term: Column, window: int = 110) -> Column:
    """Passage around the first hit of the term, or of its first word that occurs."""
    low, t = F.lower(text), F.lower(term)
    words = F.concat(F.array(t), F.when(F.contains(t, F.lit(" ")), F.split(t, " ")).otherwise(F.array().cast("array<string>")))
    hit = F.try_element_at(F.filter(words, lambda w: (w != "") & F.contains(low, w)), F.lit(1))
    pos = F.instr(low, hit) - 1
    start = F.greatest(F.lit(0), pos - window // 3)
    end = F.least(F.length(text), pos + F.length(hit) + window)
    body = F.replace(F.trim(F.substring(text, start + 1, end - start)), F.lit("\n"), F.lit(" "))
    left = F.when(start > 0, "…").otherwise("")
    right = F.when(end < F.length(text), "…").otherwise("")
    return F.when(hit.isNotNull(), F.concat(left, body, right))


def content_key(model: str, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(model + "\n"), text), 256), 1, 16)


def label_number(c: Column, label: str) -> Column:
    """Number standing before a label; thousand separators removed."""
    raw = F.regexp_extract(c, rf"([\d.,]+)\s+{label}", 1)
    return F.regexp_replace(raw, r"[.,]", "").try_cast("bigint")


def surname(c: Column) -> Column:
    return F.trim(F.split(c, ",", 2)[0])


def given_name(c: Column) -> Column:
    return F.trim(F.coalesce(F.get(F.split(c, ",", 2), F.lit(1)), F.lit("")))


def spanish_date_text(ts: Column) -> Column:
    """``27 agosto 2026 04:00 pm``."""
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(ts))
    return F.concat_ws(" ", F.dayofmonth(ts).cast("string"), month, F.year(ts).cast("string"), F.lit("04:00 pm"))


def money_text(n: Column) -> Column:
    """Short display of an amount of pesos."""
    a = F.abs(n)
    return (
        F.when(n.isNull(), F.lit("—"))
        .when(a >= 1e12, F.format_string("$ %.2f billones", n / 1e12))
        .when(a >= 1e9, F.format_string("$ %.1f mil millones", n / 1e9))
        .when(a >= 1e6, F.format_string("$ %.0f millones", n / 1e6))
        .otherwise(F.concat(F.lit("$ "), F.translate(F.format_number(n, 0), ",", ".")))
    )


def money_text_short(n: Column) -> Column:
    a = F.abs(n)
    return (
        F.when(a >= 1e12, F.format_string("%.1f B", n / 1e12))
        .when(a >= 1e9, F.format_string("%.0f MM", n / 1e9))
        .when(a >= 1e6, F.format_string("%.0f M", n / 1e6))
        .otherwise(F.format_string("%.0f", n))
    )
