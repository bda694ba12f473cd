"""Text rules on single phrases with stated results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tenderscope.functions import text as tx

CASES = {}


def _cases(name, inputs, build, expected):
    CASES[name] = inputs, build, expected


_cases(
    "clean_person_name",
    ["luis-antonio-orozco", "Ana Ruiz | orcid.org/0000-0002-1825-0097", "Javier-Leonardo Gómez", " nan ", "ORCID: 0000-0002-1825-009X", "María  Peña https://orcid.org/0000"],
    lambda s: {"clean": tx.clean_person_name(s, F.lit("rosa-diaz"))},
    {"clean": ["Luis Antonio Orozco", "Ana Ruiz", "Javier Leonardo Gómez", "Rosa Diaz", "Rosa Diaz", "María Peña"]},
)
_cases(
    "classify_document",
    ["Resolución 12 términos de referencia", "Terminos de Referencia", "Adenda No 1", "Resultados preliminares", "Respuesta a observaciones", "Anexo 3 presupuesto", "ANEXO_12 carta", "Cartilla"],
    lambda s: {"kind": tx.document_type(s), "annex": tx.annex_number(s), "subtype": tx.annex_subtype(s)},
    {
        "kind": ["resolucion", "terminos_referencia", "modificacion", "resultado", "comunicado", "anexo", "anexo", "otro"],
        "annex": [None, None, None, None, None, "3", "12", None],
        "subtype": [None, None, None, None, None, "finanzas", "otro", None],
    },
)
_cases(
    "classify_call",
    ["Fondo de Regalías", "Becas de doctorado", "Índice Publindex", "Movilidad docente", "Ministerio de Ciencia", "Otra cosa", ""],
    lambda s: {"kind": tx.call_type(s)},
    {"kind": ["SGR (regalias)", "Becas / formacion", "Publindex", "Movilidad academica", "Convocatoria (regular)", "sin_clasificar", "sin_dato"]},
)
_cases(
    "pick_reference_doc",
    ["Términos de Referencia 2024", "tdr final", "Guía", "Anexo"],
    lambda s: {
        "is_reference": tx.is_reference_document(F.lit("otro"), s, F.when(s == "Guía", F.lit("http://x.org/a/tdr_v2.pdf"))),
        "url": tx.preferred_url(F.when(s != "Guía", F.lit(" http://x.org/a.pdf ")), F.lit("http://x.org/a.docx")),
    },
    {"is_reference": [True, True, True, False], "url": ["http://x.org/a.pdf", "http://x.org/a.pdf", "http://x.org/a.docx", "http://x.org/a.pdf"]},
)
_cases(
    "link_usable",
    ["http://old.example.org/view?cod_rh=77", "http://old.example.org/view", "https://new.example.org/cv?cod_rh=5", "No", "https://new.example.org/query", None],
    lambda s: {"url": tx.usable_link(s, "old.example.org", "https://new.example.org/cv")},
    {"url": ["https://new.example.org/cv?cod_rh=77", "", "https://new.example.org/cv?cod_rh=5", "", "", ""]},
)
_cases(
    "link_kind",
    ["https://x.org/cvlac/1", "https://orcid.org/0000", "https://scholar.example.com/a", "https://www.scopus.com/b", "https://linkedin.com/in/c", "https://other.org"],
    lambda s: {"kind": tx.link_kind(s)},
    {"kind": ["cvlac", "orcid", "google_scholar", "scopus", "linkedin", "otros"]},
)
_cases(
    "norm_call_id",
    ["978.0", " 12 ", "", "conv 5/2024", None, "--"],
    lambda s: {"call_id": tx.norm_call_id(s)},
    {"call_id": ["978", "12", "sin_numero", "conv_5_2024", "sin_numero", "--"]},
)
_cases(
    "parse_money",
    ["$749.982.430.291", "COP 1,200", "sin dato", None],
    lambda s: {"amount": tx.parse_money(s)},
    {"amount": [749982430291.0, 1200.0, None, None]},
)
_cases(
    "article_meta",
    ['"Redes y mercados", 1999. DOI: 10.1/ab.c., 2015', "sin metadatos", 'A "B" 18 2024'],
    lambda s: {"title": tx.article_title(s), "doi": tx.article_doi(s), "year": tx.article_year(s)},
    {"title": ["Redes y mercados", None, "B"], "doi": ["10.1/ab.c", None, None], "year": ["2015", None, "2024"]},
)
_cases(
    "simplify_category",
    ["Investigador Senior (IS) hasta 2025", "Categoría Investigador   Emérito", "Sin categoría reconocida por la convocatoria 2021", "Junior"],
    lambda s: {"category": tx.simplify_category(s)},
    {"category": ["Investigador Senior", "Investigador   Emérito", "Sin categoría reconocida por la convocat", "Junior"]},
)
_cases(
    "split_name",
    ["Pérez Gil, Ana María", "Ruiz,Juan, PhD", "Sola"],
    lambda s: {"surname": tx.surname(s), "given": tx.given_name(s)},
    {"surname": ["Pérez Gil", "Ruiz", "Sola"], "given": ["Ana María", "Juan, PhD", ""]},
)
_cases(
    "label_numbers",
    ["Hay 1.250 Laboratorios y 12,300 Publicaciones", "3 Laboratorios", "ninguno"],
    lambda s: {"labs": tx.label_number(s, "Laboratorios"), "papers": tx.label_number(s, "Publicaciones")},
    {"labs": [1250, 3, None], "papers": [12300, None, None]},
)


@pytest.mark.parametrize("name", CASES)
def test_phrases(spark, name):
    inputs, build, expected = CASES[name]
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, s string")
    got = rows.select("i", *[c.alias(k) for k, c in build(F.col("s")).items()]).orderBy("i").collect()
    assert {c: [r[c] for r in got] for c in expected} == expected
