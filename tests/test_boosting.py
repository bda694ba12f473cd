from __future__ import annotations

import numpy as np
import pandas as pd

from tenderscope.operators import boosting, learning as ln


def rows_of(spark, n=900, classes=("a", "b", "c"), parts=3):
    r = np.random.default_rng(5)
    x, z = r.integers(0, 20, n).astype(float), r.choice(["p", "q", "r", "s"], n)
    y = np.where(z == "q", 1, np.where(x > 11, 2, 0)) % len(classes)
    flip = r.random(n) < 0.1
    y = np.where(flip, r.integers(0, len(classes), n), y)
    table = pd.DataFrame({"id": range(n), "x": x, "z": z, "label": [classes[i] for i in y], "y": (y > 0).astype(int), "weight": 1.0})
    return table, spark.createDataFrame(table).repartition(parts)


def test_jobs_do_not_grow_with_the_classes(spark):
    made = {}
    for classes in (("a", "b", "c"), ("a", "b", "c", "d", "e", "f")):
        _, df = rows_of(spark, classes=classes)
        spark.sparkContext.setJobGroup(f"fit{len(classes)}", "fit")
        ln.fit_multiclass(df, "label", ["x"], ["z"], rounds=2, depth=2)
        made[len(classes)] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit{len(classes)}"))
        spark.sparkContext.setJobGroup("", "")
    assert made[3] == made[6] < 25


def test_every_class_is_found(spark):
    table, df = rows_of(spark)
    model = ln.fit_multiclass(df, "label", ["x"], ["z"], rounds=20, depth=3)
    got = ln.with_label(model, model.transform(df)).select("id", "pred").toPandas().sort_values("id")
    want = np.where(table["z"] == "q", "b", np.where(table["x"] > 11, "c", "a"))
    assert (got["pred"].to_numpy() == want).all()


def test_trees_are_those_of_one_block(spark):
    """The first tree against sums over all rows, however they are dealt."""
    table, df = rows_of(spark)
    model = boosting.fit(df, "y", ["x"], ["z"], "weight", rounds=1, depth=2)
    p = table["y"].mean()
    sides = {}
    for name, right in [(("z", v), table["z"] == v) for v in "pqrs"] + [(("x", t), table["x"] > t) for t in range(20)]:
        if min(right.sum(), (~right).sum()) >= boosting.LEAST:
            sides[name] = sum((p - table["y"][s]).sum() ** 2 / (p * (1 - p) * s.sum()) for s in (right, ~right))
    best = max(sides, key=sides.get)
    tree = model.trees[0]
    assert best[0] == ["x", "z"][tree.feature[0, 0]] and (model.bins.levels[0][tree.cut[0, 0]] == best[1] if best[0] == "z" else model.bins.cuts[0][tree.cut[0, 0]] == best[1])
    others = [boosting.fit(rows_of(spark, parts=n)[1], "y", ["x"], ["z"], "weight", rounds=3, depth=3).trees[-1].value for n in (1, 5)]
    assert np.allclose(*others, atol=1e-6)


def test_odd_rows(spark):
    _, df = rows_of(spark)
    model = boosting.fit(df, "y", ["x"], ["z"], rounds=3, depth=2)
    odd = spark.createDataFrame([(None, "q"), (float("nan"), None), (1e300, "new"), (-5.0, "")], "x double, z string")
    got = [r["probability"] for r in model.transform(odd).collect()]
    assert all(0 < g[1] < 1 and abs(sum(g) - 1) < 1e-9 for g in got)
    one = boosting.fit(df.where("y = 1"), "y", ["x"], ["z"], rounds=3)
    assert one.labels == [1] and not one.trees and one.transform(odd).count() == 4
