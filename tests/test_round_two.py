"""Cases that earlier data did not show."""

from __future__ import annotations

import types

import pytest
from pyspark.sql import functions as F

from tenderscope import session
from tenderscope.functions import text as tx
from tenderscope.operators import learning as ln, matching, network, ranks, stats


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_rules_within_sixty_characters(spark):
    got = one(spark, tx.pct_rules, "no podrá ser mayor al 10 % y no podrá ser mayor al 20 %")
    assert [(r["rule"], r["pct"], r["context"]) for r in got] == [
        ("maximo_pct", 10, ""),
        ("maximo_pct", 20, "no podrá ser mayor al 10 % y"),
    ]
    assert len(one(spark, tx.pct_rules, "x" * 200 + " no podrá ser mayor al 7 %")[0]["context"]) == 59


def test_accents_by_rule(spark):
    assert one(spark, tx.strip_accents, "São Tomé Ångström Łódź ñ é ț") == "Sao Tome Angstrom Łodz n e t"


def test_tokens_of_any_script(spark):
    assert one(spark, matching.tokens, "Čeština ő слово x 東京 a_1") == ["čeština", "слово", "東京", "a_1"]


def test_many_equal_values_do_not_overflow(spark):
    df = spark.range(2_200_000).select((F.col("id") % 2).alias("g"), F.lit(1.0).alias("v"))
    more = df.unionByName(spark.createDataFrame([(0, 5.0), (1, 7.0)], "g long, v double"))
    row = stats.kruskal_wallis(more, "g", "v").first()
    assert row["n"] == 2_200_002 and row["h"] >= 0


def test_components_of_a_path_take_few_rounds(spark, monkeypatch):
    writes = []
    keep = network.cut_lineage
    monkeypatch.setattr(network, "cut_lineage", lambda df: writes.append(1) or keep(df))
    n = 1024
    links = spark.range(n - 1).select((n - F.col("id")).alias("source"), (n - 1 - F.col("id")).alias("target"))
    got = network.components(links).collect()
    assert len(got) == n and {r["component"] for r in got} == {1}
    assert (len(writes) - 1) / 2 <= 20


def test_components_with_hub_loop_and_nulls(spark):
    rows = [(1, 1), (5, 3), (3, 2), (9, 8), (None, 4), (7, None)] + [(100, k) for k in range(101, 400)]
    got = {r["id"]: r["component"] for r in network.components(spark.createDataFrame(rows, "source long, target long")).collect()}
    assert (got[1], got[5], got[9], got[399]) == (1, 2, 8, 100) and 4 not in got and 7 not in got
    assert network.components(spark.createDataFrame([], "source long, target long")).collect() == []


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    conf = types.SimpleNamespace(get=lambda key, default=None: default)
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(types.SimpleNamespace(conf=conf, sparkContext=context))


def test_stage_tables_can_be_cleared(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.clear_scratch(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_small_scores_spread_over_buckets(spark):
    df = spark.range(4000).select((F.col("id") / 1e9).alias("s"))
    per = df.groupBy(ranks.log_bucket(F.col("s"))).count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert per[0] < 40 and per[1] > 1000
    signs = spark.createDataFrame([(x,) for x in (-5.0, -1e-9, 0.0, 1e-300, 0.5, 2.0, 1e18)], "v double")
    buckets = [r[0] for r in signs.select(ranks.log_bucket(F.col("v"))).collect()]
    assert buckets == sorted(set(buckets))


def test_coefficients_rank_by_deviation_not_by_unit(spark):
    df = spark.range(4000).select(
        (F.rand(1) * 1e6).alias("large"), F.rand(2).alias("small"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("kind")
    )
    df = df.withColumn("y", (F.col("small") + 0.1 * F.col("large") / 1e6 + 0.2 * F.randn(3) > 0.55).cast("int")).withColumn("weight", F.lit(1.0))
    model = ln.fit_binary(df, "y", ["large", "small"], "logistic", categorical=["kind"])
    ranked = ln.coefficients(model, ["large", "small"], ["kind"])
    assert ranked[0][0] == "small" and {n for n, _ in ranked} == {"large", "small", "kind=b", "kind=c"}
    assert abs(dict(ranked)["large"]) > 0.05
