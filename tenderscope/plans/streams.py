"""Stream queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderscope.plans.inputs import table
from tenderscope.plans.registry import query
from tenderscope.session import scratch_path
from tenderscope.streaming import streams as st


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return st.file_stream(spark, d, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_counts",
    """with e as (select *, time_bucket(interval 1 day, ts, timestamp '2000-01-01') as start from events)
    select start, start + interval 1 day as end, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from e
    where start + interval 1 day <= (select max(ts) - interval 2 hour from events) group by 1, 2, 3""",
)
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily totals of closed windows; equal to the batch result over the same days."""
    e = event_stream(spark, d).withColumn("value", F.col("value").cast("decimal(18,2)"))
    out = st.run_to_table(st.windowed_counts(e, "ts", "event_type", "value", "1 day", "2 hours"), "counts")
    return out.select(
        F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n",
        F.col("total").cast("double").alias("total"),
    )


@query(
    "stream_dedup",
    """select user_id, ts, event_id from (select *, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as r from events)
    where r = 1 and cast(ts as date) + interval 1 day <= (select max(ts) - interval 1 day from events)""",
)
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First event of every user and closed day: a user comes back on later days, once on each."""
    e = event_stream(spark, d).select("user_id", "event_id", "ts").withColumn("day", F.to_date("ts"))
    out = st.run_to_table(st.first_of_period(e, "ts", ["user_id", "day"], "event_id", "1 day"), "dedup")
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@query(
    "stream_sync",
    """select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1""",
)
def stream_sync(spark: SparkSession, d: str) -> DataFrame:
    """Three snapshots of ten days (the last with what is left of the month), upserted one after the other."""
    folder, out = scratch_path(spark, "snapshots"), {x: scratch_path(spark, f"sync-{x}") for x in ("inventory", "new", "state")}
    period = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int")
    listing = table(spark, d, "events").select("user_id", "event_id", "event_type", period.alias("period"))
    for p in range(3):  # each listing is a job of its own and drained before the next one arrives
        listing.where(F.col("period") == p).drop("period").write.mode("append").parquet(folder)
        stream = st.file_stream(spark, folder, "user_id bigint, event_id bigint, event_type string", pattern="*.parquet")
        q = st.sync_listing(stream, out["inventory"], "user_id", "event_id", out["new"], out["state"])
        q.awaitTermination()
    return st.read_inventory(spark, out["inventory"]).select("user_id", "event_type", "event_id")


def arrivals(rows: DataFrame, number: str, count: int):
    """Write a table into one folder, batch after batch; yields the folder each time one has arrived."""
    folder = scratch_path(rows.sparkSession, "arrivals")
    for i in range(count):
        rows.where(F.col(number) == i).drop(number).write.mode("append").parquet(folder)
        yield folder


@query(
    "stream_leader",
    """with t as (select event_type, user_id, sum(cast(value as decimal(18,2))) as total from events group by 1, 2)
    select event_type, arg_max(user_id, (total, -user_id)) as leader, cast(max(total) as double) as total from t group by 1""",
)
def stream_leader(spark: SparkSession, d: str) -> DataFrame:
    """Two triggers, each of half a month; only leaders that change are merged."""
    cents = (F.col("value").cast("decimal(18,2)") * 100).cast("long").alias("cents")
    rows = table(spark, d, "events").select("event_type", "user_id", cents, F.when(F.dayofmonth("ts") < 16, 0).otherwise(1).alias("half"))
    kept, state = scratch_path(spark, "leaders"), scratch_path(spark, "leaders-state")
    for folder in arrivals(rows, "half", 2):
        stream = st.file_stream(spark, folder, "event_type string, user_id bigint, cents bigint", pattern="*.parquet")
        st.keep_leaders(st.running_leader(stream, "event_type", "user_id", "cents"), kept, state).awaitTermination()
    found = st.leaders_of(st.read_inventory(spark, kept, "key string, share int, leader bigint, total bigint, part int"))
    return found.select(F.col("key").alias("event_type"), "leader", (F.col("total").cast("decimal(20,0)") / 100).cast("double").alias("total"))


#: Days of a snapshot, and how long a listed id is remembered.
SNAPSHOT_DAYS, REMEMBER = 5, "4 days"


@query(
    "stream_first_seen",
    """with recursive l as (
      select distinct user_id, cast(least((day(ts) - 1) // 5, 5) as int) as k from events where event_type = 'purchase'
    ), first as (
      -- forgotten once the snapshot before lies twice the bound after the one at which it was kept
      select user_id, min(k) as k from l group by 1
      union all
      select f.user_id, (select min(l.k) from l where l.user_id = f.user_id and 5 * (l.k - 1) >= 5 * f.k + 8) from first f
      where exists (select 1 from l where l.user_id = f.user_id and 5 * (l.k - 1) >= 5 * f.k + 8)
    ) select user_id, date '2024-01-01' + 5 * k as seen from first""",
)
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Buyers as six listings show them: kept when first seen, and again once they have been forgotten."""
    k = F.least(F.floor((F.dayofmonth("ts") - 1) / SNAPSHOT_DAYS), F.lit(5)).cast("int")
    rows = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", k.alias("k")).distinct()
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("k") * SNAPSHOT_DAYS)
    rows = rows.withColumn("seen", day.cast("timestamp"))
    out, state = scratch_path(spark, "seen"), scratch_path(spark, "seen-state")
    for folder in arrivals(rows, "k", 6):
        stream = st.file_stream(spark, folder, "user_id bigint, seen timestamp", pattern="*.parquet")
        st.drain(st.first_seen(stream, "seen", ["user_id"], REMEMBER), out, state)
    return spark.read.schema("user_id bigint, seen timestamp").parquet(out).select("user_id", F.col("seen").cast("date").alias("seen"))


@query(
    "stream_late",
    """with e as (
      select event_type, cast(cast(value as decimal(18,2)) * 100 as bigint) as cents, ts, date_trunc('day', ts) as start,
             least((day(ts) - 1) // 10 + case when event_id % 40 = 7 then 1 else 0 end, 2) as b from events
    ), w as (select k as b, (select max(ts) from e where e.b < k) as seen from range(0, 4) t(k)),
    m as (
      select e.*, coalesce(w.seen >= e.start + interval 1 day + interval 6 hours, false) as late from e join w using (b)
    )
    select event_type, start, count(*) filter (where not late) as n_in_time, count(*) filter (where late) as n_late,
           cast(coalesce(sum(cents) filter (where not late), 0) as bigint) as cents_in_time,
           cast(coalesce(sum(cents) filter (where late), 0) as bigint) as cents_late
    from m where start + interval 1 day + interval 6 hours <= (select seen from w where b = 3) group by 1, 2""",
)
def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Daily totals as three triggers of ten days see them; one event in forty comes a trigger late."""
    b = F.least(F.floor((F.dayofmonth("ts") - 1) / 10) + F.when(F.col("event_id") % 40 == 7, 1).otherwise(0), F.lit(2)).cast("int")
    cents = (F.col("value").cast("decimal(18,2)") * 100).cast("long").alias("cents")
    rows = table(spark, d, "events").select("event_id", "event_type", cents, F.col("ts").cast("timestamp").alias("ts"), b.alias("b"))
    out, state = scratch_path(spark, "periods"), scratch_path(spark, "periods-state")
    for folder in arrivals(rows, "b", 3):
        stream = st.file_stream(spark, folder, "event_id bigint, event_type string, cents bigint, ts timestamp", pattern="*.parquet")
        st.drain(st.closing_periods(stream, "ts", "event_type", "event_id", "cents", "day", "6 hours", "40 days"), out, state)
    marked = spark.read.schema("key string, start timestamp, status string, n bigint, amount bigint").parquet(out)
    return st.period_totals(marked).select(
        F.col("key").alias("event_type"), F.col("start").cast("timestamp_ntz").alias("start"), F.col("n_closed").alias("n_in_time"), "n_late",
        F.col("amount_closed").alias("cents_in_time"), F.col("amount_late").alias("cents_late"),
    )
