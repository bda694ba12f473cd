"""Canonical texts of people and calls, and repair of extracted items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tenderscope.functions.text import clean_person_name, clip_text, strip_accents

# Accepted requirement types.
REQUIREMENT_TYPES = ("habilitante", "documental", "tecnico", "financiero", "alianza", "otro")
REQUIREMENT_SEVERITIES = ("obligatorio", "deseable", "desconocido")


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _joined(prefix: str, items: Column) -> Column:
    """``prefix a; b; c``, or null when there is nothing."""
    return F.when(F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(items, "; ")))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def person_category() -> Column:
    general = F.col("cvlac.datos_generales")
    return F.coalesce(_filled(F.try_element_at(general, F.lit("Categoría"))), _filled(F.try_element_at(general, F.lit("Categoria"))))


def person_text(limit: int = 3500) -> Column:
    head = F.concat(
        F.lit("Docente: "), F.coalesce(_filled(F.col("nombre")), F.col("id"), F.lit("")),
        F.lit(". Facultad: "), F.coalesce(F.col("facultad_csv"), F.lit("")),
        F.lit(". Cargo: "), F.coalesce(_filled(F.col("cargo_csv")), F.col("cargo_principal"), F.lit("")), F.lit("."),
    )
    own = F.transform(F.col("proyectos"), lambda p: F.coalesce(_filled(p["titulo"]), F.substring(F.to_json(p), 1, 120)))
    from_cv = F.transform(F.col("cvlac.proyectos"), lambda p: clip_text(p, 120))
    projects = F.when(F.size(_list(from_cv)) > 0, from_cv).otherwise(_list(own))
    parts = F.concat_ws(
        "\n",
        head,
        F.concat(F.lit("Categoría: "), person_category()),
        _joined("Áreas: ", F.slice(_list(F.col("areas_investigacion")), 1, 12)),
        F.when(F.col("perfil_profesional") != "", F.concat(F.lit("Perfil: "), clip_text(F.col("perfil_profesional"), 600))),
        _joined("Líneas: ", F.transform(F.slice(_list(F.col("cvlac.lineas_investigacion")), 1, 10), lambda x: clip_text(x, 120))),
        _joined("Áreas de actuación: ", F.transform(F.slice(_list(F.col("cvlac.areas_actuacion")), 1, 8), lambda x: clip_text(x, 100))),
        _joined("Proyectos: ", F.slice(projects, 1, 8)),
    )
    return clip_text(parts, limit)


def call_text(limit: int = 3500) -> Column:
    def tail(value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(" ("), _filled(value.cast("string")), F.lit(")")), F.lit(""))

    lines = F.transform(
        F.slice(F.col("lineas_tematicas"), 1, 12), lambda x: F.concat(F.coalesce(x["nombre"], F.lit("")), tail(x["modalidad"]))
    )
    needs = F.transform(
        F.filter(F.slice(F.col("requisitos"), 1, 8), lambda x: F.coalesce(x["texto"], F.lit("")) != ""),
        lambda x: F.substring(x["texto"], 1, 180),
    )
    criteria = F.transform(
        F.slice(F.col("criterios_evaluacion"), 1, 6),
        lambda x: F.concat(F.coalesce(x["nombre"], F.lit("")), tail(x["puntaje_max"])),
    )
    alliance = F.when(F.col("alianza_obligatoria"), "Alianza obligatoria: sí").when(
        ~F.col("alianza_obligatoria"), "Alianza obligatoria: no"
    )
    parts = F.concat_ws(
        "\n",
        F.concat(F.lit("Objetivo: "), _filled(F.col("objetivo"))),
        _joined("Líneas temáticas: ", lines),
        _joined("Requisitos: ", needs),
        _joined("Criterios: ", criteria),
        alliance,
    )
    s = clip_text(parts, limit)
    return F.when(s == "", "Convocatoria sin texto NLP estructurado").otherwise(s)


def with_canonical_text(people: DataFrame) -> DataFrame:
    return people.withColumn("canonical_text", person_text())


def person_meta(people: DataFrame) -> DataFrame:
    """The columns the ranker and its users need."""
    return people.select(
        "id",
        clean_person_name(F.col("nombre"), F.col("nombre_completo"), F.col("id")).alias("nombre"),
        F.col("facultad_csv").alias("facultad"),
        F.coalesce(_filled(F.col("cargo_csv")), F.col("cargo_principal")).alias("cargo"),
        F.col("cvlac").isNotNull().alias("tiene_cvlac"),
        person_category().alias("categoria"),
        F.size(_list(F.col("areas_investigacion"))).alias("n_areas"),
    )


def repair_requirements(items: Column) -> Column:
    """Fix aliases and accents item by item, drop only the items that stay invalid.

    Input items carry ``texto``, ``text`` (an alias), ``tipo`` and ``severidad``.
    """
    fixed = F.transform(
        F.coalesce(items, F.array().cast("array<struct<texto:string,text:string,tipo:string,severidad:string>>")),
        lambda x: F.struct(
            F.coalesce(x["texto"], x["text"]).alias("texto"),
            F.when(x["tipo"].isNull(), F.lit("otro"))
            .otherwise(F.coalesce(_known(F.lower(F.trim(strip_accents(x["tipo"]))), REQUIREMENT_TYPES), x["tipo"]))
            .alias("tipo"),
            F.coalesce(x["severidad"], F.lit("obligatorio")).alias("severidad"),
        ),
    )
    return F.filter(
        fixed,
        lambda x: x["texto"].isNotNull() & x["tipo"].isin(*REQUIREMENT_TYPES) & x["severidad"].isin(*REQUIREMENT_SEVERITIES),
    )


def _known(c: Column, values: Sequence[str]) -> Column:
    return F.when(c.isin(*values), c)


def merge_partials(partials: DataFrame) -> DataFrame:
    """Per-section extraction results (``call_id, key, ok, data``) to one record per call.

    A key has at most one result per call, so ``max_by`` over (ok, key) is exact;
    failed sections leave their fields empty.
    """
    good = F.col("ok") & F.col("data").isNotNull()

    def of(key: str, field: str) -> Column:
        return F.max(F.when(good & (F.col("key") == key), F.col(f"data.{field}")))

    def listed(key: str, field: str, kind: str) -> Column:
        return F.coalesce(of(key, field), F.array().cast(f"array<{kind}>"))

    return partials.groupBy("call_id").agg(
        of("objetivo", "objetivo").alias("objetivo"),
        listed("dirigida_a", "actores", "string").alias("actores"),
        of("dirigida_a", "alianza").alias("alianza_obligatoria"),
        listed("requisitos", "requisitos", "string").alias("requisitos"),
        listed("criterios", "criterios", "string").alias("criterios"),
        of("financiacion", "monto").alias("monto_total_cop"),
        F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("key")))).alias("failed_sections"),
    )


def completeness(fields: Sequence[Column]) -> Column:
    """How many of the given fields are populated."""
    return sum((F.when(f, 1).otherwise(0) for f in fields), F.lit(0))


def extraction_quality(calls: DataFrame) -> DataFrame:
    """Populated fields out of six; a structure counts only if a member is set."""

    def has_items(c: str) -> Column:
        return F.coalesce(F.size(F.col(c)) > 0, F.lit(False))

    money = ("monto_total_texto", "monto_total_cop", "plazo_min_meses", "plazo_max_meses",
             "contrapartida_pct_min", "contrapartida_pct_max", "fuente_recursos", "notas")
    financed = F.coalesce(*[F.col(f"financiacion.{m}").cast("string") for m in money]).isNotNull()
    n = completeness(
        [
            F.coalesce(F.col("objetivo") != "", F.lit(False)),
            has_items("actores_elegibles"),
            has_items("lineas_tematicas"),
            has_items("requisitos"),
            has_items("criterios_evaluacion"),
            financed,
        ]
    )
    return calls.select("convocatoria", n.alias("fields_populated")).withColumn(
        "completeness", F.concat(F.col("fields_populated").cast("string"), F.lit("/6"))
    )
