"""Streams over several triggers: leaders that change, periods that close, ids that are forgotten."""

from __future__ import annotations

import datetime as dt
import glob
import os

from tenderscope.plans.catalog import QUERIES
from tenderscope.streaming import streams as st

DAY = dt.datetime(2024, 3, 1)


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_leaders_rise_and_fall_and_other_parts_stay_untouched(spark, tmp_path):
    schema = "key string, member bigint, amount bigint"
    folder, kept, state = (str(tmp_path / x) for x in ("in", "kept", "state"))
    keys = [f"k{i}" for i in range(12)]
    batches = [
        [(k, m, 10 * m) for k in keys for m in range(1, 6)],
        [("k3", 5, -45), ("k3", 1, 1), ("k5", 2, 100)],  # k3's leader falls behind 4, k5 gets a new one
        [("k7", 1, 0)],  # nothing changes
    ]
    want, files = {}, []
    for rows in batches:
        for k, m, a in rows:
            want[k, m] = want.get((k, m), 0) + a
        arrive(spark, folder, rows, schema)
        stream = st.file_stream(spark, folder, schema, pattern="*.parquet")
        st.keep_leaders(st.running_leader(stream, "key", "member", "amount"), kept, state).awaitTermination()
        files.append({f: os.stat(f).st_mtime_ns for f in glob.glob(f"{kept}/part=*/*.parquet")})
        found = st.leaders_of(st.read_inventory(spark, kept)).collect()
        best = {k: max((t, -m) for (key, m), t in want.items() if key == k) for k in keys}
        assert {r["key"]: (r["total"], -r["leader"]) for r in found} == best
    same = files[0].items() & files[1].items()
    assert len({os.path.dirname(f) for f, _ in same}) >= len({os.path.dirname(f) for f in files[0]}) - 2 > 0
    assert files[1] == files[2]


def test_a_period_closes_by_the_watermark_and_what_follows_is_late(spark, tmp_path):
    schema = "id bigint, key string, amount bigint, ts timestamp"
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    at = lambda days, hours=0: DAY + dt.timedelta(days=days, hours=hours)
    batches = [
        [(1, "a", 5, at(0, 1)), (2, "a", 7, at(0, 20)), (3, "b", 1, at(1, 3))],  # nothing is a day past its end yet
        [(4, "a", 2, at(0, 5)), (5, "a", 9, at(3))],  # day 0 still takes 4; then the third day closes it
        [(6, "a", 100, at(0, 6)), (7, "b", 4, at(3, 2)), (8, "a", 50, at(-30))],  # 6 is late, 8 too old to be kept
    ]
    for rows in batches:
        arrive(spark, folder, rows, schema)
        stream = st.file_stream(spark, folder, schema, pattern="*.parquet")
        st.drain(st.closing_periods(stream, "ts", "key", "id", "amount", "day", "1 day", "10 days"), out, state)
    marked = spark.read.parquet(out)
    got = {(r["key"], r["start"]): (r["n_closed"], r["amount_closed"], r["n_late"], r["amount_late"]) for r in st.period_totals(marked).collect()}
    # day 1 of b ends at day 2 and closes once day 3 was seen; day 3 is still open
    assert got == {("a", DAY): (3, 14, 1, 100), ("b", DAY + dt.timedelta(days=1)): (1, 1, 0, 0)}


def test_an_id_is_new_again_beyond_the_bound(spark, tmp_path):
    schema = "id bigint, seen timestamp"
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for day, ids in enumerate([(1, 2), (1, 3), (4,), (1,), (1, 2), (2,)]):
        arrive(spark, folder, [(i, DAY + dt.timedelta(days=day)) for i in ids], schema)
        st.drain(st.first_seen(st.file_stream(spark, folder, schema, pattern="*.parquet"), "seen", ["id"], "1 day"), out, state)
    got = sorted((r["id"], (r["seen"] - DAY).days) for r in spark.read.parquet(out).collect())
    # forgotten once the day before lies twice the bound after the day it was kept
    assert got == [(1, 0), (1, 3), (2, 0), (2, 4), (3, 1), (4, 2)]


def test_registered_streams_hold_late_and_returning_rows(spark, data):
    late = QUERIES["stream_late"](spark, data).collect()
    assert sum(r["n_late"] for r in late) > 0 and sum(r["n_in_time"] for r in late) > sum(r["n_late"] for r in late)
    seen = QUERIES["stream_first_seen"](spark, data).groupBy("user_id").count().collect()
    assert max(r["count"] for r in seen) >= 2
