"""A slice of the registered queries on the smallest data, and the shape of the registry."""

from __future__ import annotations

import os
import re

import pytest

from tenderscope.plans.catalog import QUERIES, SQL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["hhi_before_after", "pareto_curve", "yearly_rotation", "hybrid_rank", "network_sample", "backtest", "portfolio_plan"]


def test_registry():
    assert len(QUERIES) > 150 and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_small_scale_matches_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]

    def plain(v):
        return float(v) if hasattr(v, "as_tuple") else v

    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert sorted(df.columns) == sorted(names)
    assert got == want


def test_pareto_curve_never_falls(spark, data):
    rows = QUERIES["pareto_curve"](spark, data).orderBy("point").collect()
    values = [r["pct_value"] for r in rows]
    assert values == sorted(values) and values[-1] == 100.0


def test_no_banned_constructs_in_the_library():
    banned = re.compile(r"localCheckpoint|crossJoin|\.toPandas\(|pkill")
    for folder, _dirs, files in os.walk(os.path.join(ROOT, "tenderscope")):
        for f in files:
            if f.endswith(".py"):
                assert not banned.search(open(os.path.join(folder, f), encoding="utf-8").read()), f
