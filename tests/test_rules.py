"""Small frames for the rules that are easy to get wrong."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tenderscope.functions import dates, text
from tenderscope.functions.measures import hhi, jaccard
from tenderscope.operators import cleaning as cl, decisions as de, documents as dc, market as mk, network as nw, profiles as pr, tables as tb
from tenderscope.sources import readers, schemas, sinks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).collect()[0][0]


def test_flags_differ_on_missing(spark):
    assert one(spark, cl.flag_strict, None) is False
    assert one(spark, cl.flag_lenient, None) is True
    assert one(spark, cl.flag_lenient, " No ") is False
    assert one(spark, cl.flag_si_no, "otro") is None


def test_two_plausibility_rules(spark):
    df = spark.createDataFrame([(200.0, 1.0), (2e9, 1e7), (50.0, 0.1), (1e14, None), (10.0, None)], "v double, b double")
    v, b = F.col("v"), F.col("b")
    a = [r[0] for r in df.select(cl.implausible(v, b)).collect()]
    m = [r[0] for r in df.select(cl.implausible(v, b, "base_min_one")).collect()]
    assert a == [False, True, False, True, False]
    assert m == [True, True, False, True, False]
    with pytest.raises(ValueError):
        cl.implausible(v, b, "other")


def test_tax_id(spark):
    for raw, want in (("860.0", "860"), ("00860", "860"), ("000", "0"), (" nan ", ""), (None, ""), ("AB-1", "AB-1")):
        assert one(spark, cl.norm_tax_id, raw) == want


def test_bucket_tail_sends_null_to_other(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    got = sorted(r["g"] for r in cl.bucket_tail(df, "c", 1, "g").collect())
    assert got == ["OTRO", "OTRO", "a", "a"]


def test_leakage_guard(spark):
    df = spark.createDataFrame([(1, 2)], "precio_base int, fecha_adjudicacion int")
    assert cl.drop_after_close(df).columns == ["precio_base"]
    with pytest.raises(ValueError):
        cl.assert_no_leakage(df)


def test_deflator_rejects_repeated_month(spark):
    rows = spark.createDataFrame([(dt.datetime(2020, 1, 5), 10.0)], "at timestamp_ntz, v double")
    index = spark.createDataFrame([(dt.date(2020, 1, 1), 100.0), (dt.date(2020, 2, 1), 110.0)], "month date, index_value double")
    got = cl.deflate(rows, "at", ["v"], index, "2020-02-01").collect()[0]
    assert float(got["v_real"]) == 11.0
    with pytest.raises(Exception, match="repeats a month"):
        cl.deflate(rows, "at", ["v"], index.union(index), "2020-02-01").collect()
    with pytest.raises(Exception, match="base month"):
        cl.deflate(rows, "at", ["v"], index, "2021-02-01").collect()


def test_upsert_is_idempotent_and_keeps_last(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, s int, v string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, "d"), (3, 5, "e")], "k int, s int, v string")
    once = tb.upsert_latest(old, new, ["k"], ["s"])
    twice = tb.upsert_latest(once, new, ["k"], ["s"])
    want = [(1, "a"), (2, "c"), (3, "e")]
    assert sorted((r["k"], r["v"]) for r in once.collect()) == want
    assert sorted((r["k"], r["v"]) for r in twice.collect()) == want


def test_market_table_splits_spellings_but_buyer_hhi_does_not(spark):
    df = spark.createDataFrame([("1", "A", 10, "b", 1), ("1", "A.", 10, "b", 2)], "supplier_id string, supplier_name string, value int, buyer string, process_id int")
    assert mk.market_table(df).count() == 2
    assert mk.hhi_by_buyer(df, 1).collect()[0]["hhi"] == 10000.0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=30))
def test_hhi_bounds(spark, values):
    h = spark.createDataFrame([(v,) for v in values], "v long").agg(hhi(F.col("v"))).collect()[0][0]
    assert 10000 / len(values) - 1e-6 <= h <= 10000 + 1e-6


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 9), min_size=1), st.sets(st.integers(0, 9), min_size=1))
def test_jaccard_symmetric(spark, a, b):
    df = spark.createDataFrame([(list(a), list(b))], "a array<int>, b array<int>")
    x, y = df.select(jaccard(F.col("a"), F.col("b")), jaccard(F.col("b"), F.col("a"))).collect()[0]
    assert x == y == len(a & b) / len(a | b)


SECTIONS = [
    ("OBJETIVO", "objetivo"),
    ("Mecanismos de Participación", "dirigida_a"),
    ("EJES Y LÍNEAS", "lineas_tematicas"),
    ("REQUISITOS HABILITANTES", "requisitos"),
    ("CONDICIONES INHABILITANTES", "rechazo"),
    ("DURACIÓN Y RECURSOS", "financiacion"),
    ("CRITERIOS DE EVALUACIÓN", "criterios"),
    ("DEMANDAS TERRITORIALES", None),
    ("PROCEDIMIENTO DE EVALUACIÓN", None),
]


def test_section_titles_do_not_hijack(spark):
    df = spark.createDataFrame([(t,) for t, _ in SECTIONS], "t string")
    assert [r[0] for r in df.select(text.section_key(F.col("t"))).collect()] == [k for _, k in SECTIONS]
    rows = spark.createDataFrame(
        [(1, 0, "PROCEDIMIENTO DE EVALUACIÓN", "x"), (1, 1, "CRITERIOS DE EVALUACIÓN", "y"), (1, 2, "CRITERIOS DE EVALUACION", "z")],
        "d int, pos int, title string, body string",
    )
    got = dc.canonical_sections(rows, "d", "pos", "title").collect()
    assert [(r["section_key"], r["body"]) for r in got] == [("criterios", "y")]


def test_split_sections_uses_contents_and_longest_chain(spark):
    doc = "\n".join(
        [
            "1. PRESENTACION ........ 3", "2. OBJETIVO ........ 4", "intro",
            "1. PRESENTACION", "uno", "1. RUIDO SUELTO", "2. OBJETIVO", "dos", "tres", "3. no es titulo",
        ]
    )
    df = dc.with_sections(spark.createDataFrame([(doc,)], "t string"), "t")
    got = [(s["number"], s["title_norm"], s["text"]) for s in df.collect()[0]["sections"]]
    assert got[0][:2] == (1, "PRESENTACION")
    assert got[1] == (2, "OBJETIVO", "dos\ntres\n3. no es titulo")


def test_long_dates(spark):
    assert one(spark, dates.parse_long_date, "jueves 27 agosto 2026 04:00 pm") == dt.date(2026, 8, 27)
    assert one(spark, dates.parse_long_date, "31 febrero 2026") is None
    assert one(spark, dates.parse_long_date, "por definir") is None


def test_money_text(spark):
    assert one(spark, text.money_text, 2.5e12, "double") == "$ 2.50 billones"
    assert one(spark, text.money_text, 3.2e9, "double") == "$ 3.2 mil millones"
    assert one(spark, text.money_text, None, "double") == "—"
    assert one(spark, text.money_text_short, 5e6, "double") == "5 M"


def call(actors, alliance):
    return [("c", actors, alliance)]


CALL = "convocatoria string, actores_elegibles array<struct<tipo:string,rol:string,condicion:string>>, alianza_obligatoria boolean"


@pytest.mark.parametrize(
    ("actors", "alliance", "can", "mode", "role"),
    [
        ([], None, None, "desconocido", None),
        ([("Empresa", "x", None)], None, False, "no_elegible", None),
        ([("IES", "aliado", None)], None, True, "solo_como_aliado", "aliado"),
        ([("IES", "aliado", "como entidad ejecutora")], True, True, "solo_en_alianza", "ejecutora"),
        ([("Universidades", None, None)], False, True, "puede_sola_o_alianza", "ejecutora"),
        ([("Universidades", "asesor", None)], None, True, "elegible_alianza_indefinida", "asesor"),
    ],
)
def test_rule_verdict(spark, actors, alliance, can, mode, role):
    r = de.rule_verdict(spark.createDataFrame(call(actors, alliance), CALL)).collect()[0]
    assert (r["puede_postularse"], r["modo"], r["rol_sugerido"]) == (can, mode, role)


def test_repair_keeps_good_items(spark):
    rows = [([("a", None, "técnico", None), (None, "b", None, None), (None, None, "otro", None), ("c", None, "raro", None)],)]
    df = spark.createDataFrame(rows, "r array<struct<texto:string,text:string,tipo:string,severidad:string>>")
    got = df.select(pr.repair_requirements(F.col("r")).alias("r")).collect()[0]["r"]
    assert [(x["texto"], x["tipo"]) for x in got] == [("a", "tecnico"), ("b", "otro")]


def test_components_by_brute_force(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("z", "z2"), ("z2", "x")]
    got = {r["id"]: r["component"] for r in nw.components(spark.createDataFrame(links, "source string, target string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "x": "x", "y": "x", "z": "x", "z2": "x"}


def test_readers_and_sinks(spark, tmp_path):
    csv = tmp_path / "lines.csv"
    csv.write_text(
        "id_del_proceso,entidad,valor_total_adjudicacion,precio_base,adjudicado_bool,nit_del_proveedor_adjudicado,fecha_de_publicacion_del,segmento_unspsc\n"
        'P1,E,"1,200.50",x,si,0900,2024-01-02,80.0\nP2,E,,5,,,mal,81\n'
    )
    rows = readers.read_award_lines(spark, str(csv)).orderBy("process_id").collect()
    assert float(rows[0]["value"]) == 1200.5 and rows[0]["base_price"] is None and rows[0]["segment"] == "80"
    assert rows[0]["supplier_tax_id"] == "0900" and rows[1]["awarded"] is False and rows[1]["published_at"] is None
    few = readers.read_award_lines(spark, str(csv), ["process_id", "value"])
    assert few.columns == ["process_id", "value"]
    gone = readers.optional(spark, lambda: spark.read.schema(schemas.PROFILE).json(str(tmp_path / "none")), schemas.PROFILE)
    assert gone.isEmpty()
    out = str(tmp_path / "t.csv")
    sinks.write_table(few, out, "csv")
    assert spark.read.option("header", True).csv(out).count() == 2
    inventory = str(tmp_path / "inv")
    sinks.write_table(spark.createDataFrame([(1, 1, "a")], "k int, s int, v string"), inventory)
    path = sinks.upsert_table(spark, spark.createDataFrame([(1, 2, "b")], "k int, s int, v string"), inventory, ["k"], ["s"])
    assert spark.read.parquet(path).collect()[0]["v"] == "b"


def test_profiles_take_the_file_stem(spark, tmp_path):
    (tmp_path / "ana-ruiz.json").write_text('{"nombre": "Ana", "facultad_csv": "Facultad de Economía y Finanzas", "cvlac": {"datos_generales": {"Categoría": "Investigador Senior"}}}')
    (tmp_path / "corta.json").write_text('{"id": "corta"}')
    got = readers.load_profiles(spark, str(tmp_path)).collect()
    assert [r["id"] for r in got] == ["ana-ruiz"]
    assert "Investigador Senior" in got[0]["canonical_text"]


def test_longest_chain_of_thousands_of_headings(spark):
    import random

    from tenderscope.operators.documents import longest_chain

    def plain(items):
        best = []
        for i, first in enumerate(items):
            run = [first]
            for h in items[i + 1 :]:
                if h[1] is not None and run[-1][1] is not None and h[1] > run[-1][1] and h[3] != run[-1][3]:
                    run.append(h)
            best = run if len(run) > len(best) else best
        return best

    r = random.Random(7)
    docs = [[(i, r.randint(1, 12), "T", r.choice("ABC")) for i in range(r.randint(0, 25))] for _ in range(150)]
    docs.append([(i, r.choice([None, *range(1, 99)]), "T", r.choice("ABCDE")) for i in range(2000)])
    docs.append([(i, 99 - i % 99, "T", "A") for i in range(2000)])
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, h array<struct<line:int,number:int,title:string,title_norm:string>>")
    got = {x["id"]: [tuple(h) for h in x["c"]] for x in df.select("id", longest_chain(F.col("h")).alias("c")).collect()}
    assert all(got[i] == plain(d) for i, d in enumerate(docs))


def test_listing_rows_of_odd_markup(spark):
    page = (
        "<p><TABLE class=x><thead><tr><th>n</th></tr></thead><tbody><!-- <tr><td>1<td>2<td>3<td>4<td>5 -->"
        "<TR><td> </td><td><a title='a' href='/node/7?x=1&amp;y=2'>One &amp; <b>two</b></a><td>d<br>e</td><td>$ 1&nbsp;000</td><td>May</td></TR>"
        "<tr><td>9<td><a href='https://else.org/c'>Nine</a><td>d<td>r<td>o<td>more"
        "<tr><td>8<td>short<td>x<td>y</tr>"
        "<tr><td>5<td>no link<td>d<td>r<td>o</tr><tr><td>6<td>no link either<td>d<td>r<td>o</tr></tbody></table>"
    )
    twice = "<table><tr><td>head<td>h<td>h<td>h<td>h</tr><tr><td>10<td><a href='c/1'>Later</a><td>d<td>r<td>o</tr><tr><td>11<td><a href='https://else.org/c'>Again</a><td>d<td>r<td>o"
    df = spark.createDataFrame([(1, page), (2, twice), (3, "no table"), (4, None), (5, "<table></table>")], "id int, html string")
    got = readers.listing_rows(df, "id", "html", "https://b.org", text.LISTING_ID_RULES).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(
        [
            ("node_7", "One & two", "https://b.org/node/7?x=1&y=2", "d e", "$ 1 000", "May"),
            ("9", "Nine", "https://else.org/c", "d", "r", "o"),
            ("5", "no link", None, "d", "r", "o"),
            ("10", "Later", "https://b.org/c/1", "d", "r", "o"),
        ],
        key=repr,
    )
