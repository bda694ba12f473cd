"""Nested calls and outlined documents derived from the documents table.

The benchmark has no call documents, so each document is reshaped into one: its
own sentences become objective, requirements and sections. Every document and
every sentence is used, so the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenderscope.plans.inputs import table

TITLES = (
    "PRESENTACION", "OBJETIVO", "DIRIGIDA A", "LINEAS TEMATICAS",
    "REQUISITOS HABILITANTES", "DURACION Y FINANCIACION", "CRITERIOS DE EVALUACION", "CRONOGRAMA",
)


def _sentences() -> Column:
    return F.filter(F.transform(F.split("text", r"[.\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def outlined(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, outline``: the document's sentences under numbered headings."""
    docs = table(spark, d, "documents").select("doc_id", _sentences().alias("s"))
    titles = F.array(*[F.lit(t) for t in TITLES])
    used = F.filter(titles, lambda _t, i: (F.col("doc_id") + i) % 4 != 0)
    docs = docs.withColumn("t", used)
    n = F.size("t")

    def block(t: Column, i: Column) -> Column:
        own = F.coalesce(F.get("s", i), F.lit(""))
        rest = F.array_join(F.slice("s", i + 1, F.greatest(F.size("s") - i, F.lit(0))), "\n")
        return F.concat((i + 1).cast("string"), F.lit(". "), t, F.lit("\n"), F.when(i == n - 1, rest).otherwise(own))

    return docs.select("doc_id", F.array_join(F.transform("t", block), "\n").alias("outline"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """One typed extraction per document."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").withColumn("s", _sentences())
    kinds = F.array(*[F.lit(x) for x in ("habilitante", "documental", "tecnico", "otro")])
    needs = F.transform(
        F.slice("s", F.lit(2), F.size("s")),
        lambda x, i: F.struct(
            x.alias("texto"),
            F.get(kinds, (i % 4).cast("int")).alias("tipo"),
            F.when(i % 7 == 0, "deseable").otherwise("obligatorio").alias("severidad"),
        ),
    )
    actor = F.struct(
        F.when(k % 3 == 0, "Instituciones de Educación Superior (IES)").when(k % 3 == 1, "Centros de investigación").otherwise("Universidades públicas").alias("tipo"),
        F.when(k % 4 == 0, "aliado").when(k % 4 == 1, "ejecutora").when(k % 4 == 2, "").otherwise("proponente").alias("rol"),
        F.when(k % 5 == 0, "Sede en la región y acreditación vigente").when(k % 5 == 1, "Actuar como entidad ejecutora").otherwise(F.lit(None).cast("string")).alias("condicion"),
    )
    no_actor = F.array().cast("array<struct<tipo:string,rol:string,condicion:string>>")
    return docs.select(
        F.concat(F.lit("convocatoria_"), k.cast("string")).alias("convocatoria"),
        "doc_id",
        F.get("s", F.lit(0)).alias("objetivo"),
        F.when(k % 11 == 0, no_actor).otherwise(F.array(actor)).alias("actores_elegibles"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("alianza_obligatoria"),
        F.transform(
            F.slice("s", 1, 3),
            lambda x: F.struct(x.alias("nombre"), F.lit(None).cast("string").alias("modalidad"), F.lit(None).cast("string").alias("descripcion_corta")),
        ).alias("lineas_tematicas"),
        needs.alias("requisitos"),
        F.transform(
            F.slice("s", 1, 4),
            lambda x, i: F.struct(x.alias("nombre"), (i * 10.0).alias("puntaje_max"), F.lit(None).cast("double").alias("peso_pct"), F.lit(None).cast("string").alias("descripcion")),
        ).alias("criterios_evaluacion"),
        F.struct(
            F.lit(None).cast("string").alias("monto_total_texto"),
            F.when(k % 2 == 0, F.col("n_chars") * 1e6).alias("monto_total_cop"),
            F.lit(None).cast("int").alias("plazo_min_meses"),
            F.when(k % 5 != 0, (F.col("n_chars") % 90).cast("int")).alias("plazo_max_meses"),
            F.when(k % 7 == 0, 10.0).alias("contrapartida_pct_min"),
            F.lit(None).cast("double").alias("contrapartida_pct_max"),
            F.when(k % 4 == 0, "Sistema general de regalías").otherwise(F.col("source")).alias("fuente_recursos"),
            F.lit(None).cast("string").alias("notas"),
        ).alias("financiacion"),
    )
