"""Tables that the small data does not show: many anchors, texts with telling words, dense networks."""

from __future__ import annotations

import os

import duckdb
import pytest

from tenderscope.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem documents benchmark labels embeddings".split()


@pytest.fixture
def changed(data, tmp_path):
    """A folder of the small tables, some of them replaced by a select over their file."""

    def make(**selects):
        con = duckdb.connect()
        for t in TABLES:
            source = f"{data}/{t}.parquet"
            if t in selects:
                con.execute(f"copy ({selects[t].format(f=source)}) to '{tmp_path}/{t}.parquet' (format parquet)")
            else:
                os.symlink(source, tmp_path / f"{t}.parquet")
        return str(tmp_path)

    return make


def agree(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]

    def plain(v):
        return float(v) if hasattr(v, "as_tuple") else v

    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert sorted(df.columns) == sorted(names) and got == want
    return got


def test_every_anchor_is_ranked_among_its_peers(spark, changed):
    names = "case when s_suppkey % 3 = 0 then 'Supplier#000' || s_suppkey || '007' when s_suppkey % 3 = 1 then 'Supplier#00' || s_suppkey || '5' else s_name end"
    folder = changed(supplier=f"select * replace ({names} as s_name) from '{{f}}'")
    assert len(agree(spark, folder, "peer_rank")) > 1


def test_kind_of_a_call_follows_its_funding_source(spark, changed):
    texts = "case when doc_id % 5 = 1 then 'Beca de doctorado. ' || text when doc_id % 5 = 2 then null when doc_id % 5 = 3 then 'movilidad regalías' else text end"
    folder = changed(documents=f"select * replace ({texts} as text, case when doc_id % 7 = 3 then null when doc_id % 7 = 5 then ' ' else source end as source) from '{{f}}'")
    assert len(agree(spark, folder, "panorama_by_type")) == 2


def test_edges_shuffle_only_what_is_asked(spark, data):
    from tenderscope.operators import network as nw
    from tenderscope.plans import network as plan

    lean = plan.edges(spark, data, ["supplier_name", "n_processes"])
    text = lean._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in text and "p_type" not in text and "s_nationkey" in text
    full = plan.edges(spark, data).orderBy("buyer", "supplier_id")
    again = nw.with_modes(lean, plan.net_lines(spark, data)).select(full.columns).orderBy("buyer", "supplier_id")
    assert again.collect() == full.collect()


def test_cells_copy_the_pool_seldom_and_rank_as_before(spark):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from tenderscope.operators import matching as mt

    r = np.random.default_rng(3)

    def side(n, name, pre):
        vectors = [v if i % 11 else np.array([np.nan, 1.0]) for i, v in enumerate(np.round(r.normal(size=(n, 2)), 1))]
        return pd.DataFrame({name: np.arange(n), f"{pre}terms": [None] * n, f"{pre}weights": [None] * n, f"{pre}vector": vectors, "bonus": 0.0})

    q, p = side(300, "q", "q_"), side(500, "id", "")
    got = mt._cell_scorer(5, 1.0, 0.0, False, False, True)(q, p)
    score = np.round(np.stack(q["q_vector"]) @ np.stack(p["vector"]).T, 6)
    for j in range(len(q)):
        ids = np.array([i for i in range(len(p)) if i != j])
        want = ids[np.lexsort((ids, -score[j, ids]))[:5]]
        assert got.loc[got["q"] == j, "id"].tolist() == want.tolist()
    rows = spark.range(3000).select(F.col("id").alias("q"), *[F.lit(None).cast(t).alias(c) for c, t in (("terms", "array<string>"), ("weights", "array<double>"))], F.array(F.lit(1.0)).alias("vector"))
    top = mt.grid_top_k(rows, rows.withColumnRenamed("q", "id").withColumn("bonus", F.lit(0.0)), 2)
    plan = top._jdf.queryExecution().analyzed().toString()
    assert "cast(1 as bigint)" in plan and "cast(11 as bigint)" not in plan  # two blocks of queries, not twelve


def test_network_moves_edges_seldom(spark, data):
    from tenderscope.operators import network as nw
    from tenderscope.plans import network as plan
    from tenderscope.session import cut_lineage

    e = cut_lineage(plan.edges(spark, data, ["supplier_name", "n_processes"]))
    rivals = nw.ego_rivals(e, plan.SUPPLIER, plan._peer())
    # the anchor's few edges are a table of their own, whose size the planner knows
    assert len({f.rsplit("/", 1)[0] for f in rivals.inputFiles()}) == 2
    totals = nw.end_totals(e)
    assert sorted(nw.named_totals(totals).select("kind", "node", "name", "value", "degree").collect()) == sorted(nw.node_totals(e).select("kind", "node", "name", "value", "degree").collect())


def test_terms_of_a_document_are_counted_where_it_lies(spark, data):
    assert "Exchange" not in QUERIES["tfidf_weights"](spark, data)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [3, 12, 1000])
def test_terms_of_repeated_and_null_ids_are_added_up(spark, most):
    import math
    import re
    from collections import Counter

    from tenderscope.operators import matching as mt

    docs = [(1, "Uno dos, uno DOS tres"), (2, None), (None, "dos tres"), (1, "dos_a ñandú a uno dos"), (None, "uno dos"), (2**60 + 1, "tres tres x"), (5, ""), (6, "Ωmega 77 uno—dos")]
    counts, every = {}, Counter()
    for i, text in docs:
        w = [x for x in re.split(r"\W+", (text or "").lower()) if len(x) > 1]
        found = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
        counts[i] = counts.get(i, Counter()) + found
        every += found
    known = sorted(every, key=lambda t: (-every[t], t.encode()))[:most]
    want = {}
    for i, c in counts.items():
        w = {t: (1 + math.log(c[t])) * (math.log((1 + len(docs)) / (1 + sum(t in o for o in counts.values()))) + 1) for t in known if t in c}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, t): round(x / norm, 9) for t, x in w.items()}
    held, fitted = mt.fit_tfidf(spark.createDataFrame(docs, "id long, text string").repartition(3), "id", "text", most)
    assert fitted.vocabulary == known
    got = {(r["id"], r["term"]): round(r["weight"], 9) for r in fitted.rows(held, "id").collect()}
    assert got == want
    packed = {(r["id"], fitted.vocabulary[t]): round(w, 9) for r in fitted.weights(held, "id").collect() for t, w in zip(r["terms"], r["weights"])}
    assert packed == want
