"""Structured Streaming jobs: listing sync, first-seen dedup, windowed counts, leaders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tenderscope.operators import tables
from tenderscope.session import cut_lineage, scratch_path


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", pattern: str | None = None, per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(folder)


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet under the shared folder and read the result."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str, delay: str) -> DataFrame:
    """Counts and sums per tumbling window and key; late rows beyond the delay are dropped."""
    w = F.window(F.col(time), width)
    return (
        events.withWatermark(time, delay).groupBy(w.alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")
    )


def first_seen(events: DataFrame, time: str, keys: Sequence[str], bound: str) -> DataFrame:
    """First event per key within the bound; state older than it is dropped."""
    return events.withWatermark(time, bound).dropDuplicatesWithinWatermark(list(keys))


def first_of_period(events: DataFrame, time: str, keys: Sequence[str], order: str, bound: str) -> DataFrame:
    """Earliest row per key (ties by ``order``), given out once the watermark closes the key's day.

    ``keys`` hold a period derived from ``time``, so state is dropped with the period.
    """
    day = F.window(F.col(time), "1 day")
    return (
        events.withWatermark(time, bound).groupBy(day.alias("w"), *keys).agg(F.min(F.struct(time, order)).alias("r")).select(*keys, f"r.{time}", f"r.{order}")
    )


#: Parts into which an inventory is dealt by key; a batch rewrites only those it touches.
PARTS = 32


def sync_listing(snapshots: DataFrame, inventory_path: str, key: str, seq: str, new_path: str, state: str) -> StreamingQuery:
    """Each micro-batch is a listing snapshot: report unknown ids, then upsert the latest row.

    The inventory lies in parts by key hash. A batch joins and rewrites only the parts
    that its keys fall in; a replayed batch writes the same rows again.
    """
    spark = snapshots.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        once = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), seq).alias("_r"))
        part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")
        rows = cut_lineage(once.select(key, "_r.*").select(*batch.columns, part))
        touched = [r["part"] for r in rows.select("part").distinct().collect()]  # PARTS at most
        old = read_inventory(spark, inventory_path, rows.schema).where(F.col("part").isin(touched))
        merged = cut_lineage(tables.upsert_latest(old, rows, [key], [seq]).select(*rows.columns))
        fresh = tables.pending_keys(rows.drop("part"), old.drop("part"), key)
        fresh.select(key, F.lit(batch_id).alias("batch")).write.mode("overwrite").parquet(f"{new_path}/b={batch_id}")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(inventory_path)

    return snapshots.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()


def read_inventory(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The inventory as it stands; no rows before the first batch."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside hold their state in RocksDB, which timers and state maps need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Shares into which the rows of one key are dealt by a hash, so that a hot key is not one task's.
SPREAD = 8


def dealt(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")


class _LeaderOfShare(StatefulProcessor):
    """Totals of all members of a share, and which of them leads; given out only when that changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getMapState("totals", "member long", "total long")
        self.best = handle.getValueState("best", "member long, total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat([f.groupby("member")["amount"].sum() for f in rows]).groupby(level=0).sum()
        best = tuple(self.best.get()) if self.best.exists() else None
        lead = best
        for member, amount in came.items():
            held = self.totals.getValue((int(member),)) if self.totals.containsKey((int(member),)) else (0,)
            total = int(held[0]) + int(amount)
            self.totals.updateValue((int(member),), (total,))
            if lead is not None and lead[0] == member:
                lead = (int(member), total)
            elif lead is None or (total, -member) > (lead[1], -lead[0]):
                lead = (int(member), total)
        if best is not None and best[0] in came.index and lead[1] < best[1]:  # the leader fell: anyone may lead now
            lead = max(((m, t) for (m,), (t,) in self.totals.iterator()), key=lambda x: (x[1], -x[0]))
        if lead != best:
            self.best.update(lead)
            yield pd.DataFrame({"key": [key[0]], "share": [key[1]], "leader": [lead[0]], "total": [lead[1]]})


def running_leader(events: DataFrame, key: str, member: str, amount: str) -> DataFrame:
    """``key, share, leader, total`` of every share whose leading member or leading total changed.

    Members (longs) are dealt into shares of their key; state is one total per member,
    and sums may fall as well as rise. Equal totals go to the smaller member.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), dealt(member).alias("share"), F.col(member).alias("member"), F.col(amount).alias("amount"))
    return rows.groupBy("key", "share").transformWithStateInPandas(
        _LeaderOfShare(), "key string, share int, leader long, total long", outputMode="Update", timeMode="None"
    )


def keep_leaders(leaders: DataFrame, path: str, state: str) -> StreamingQuery:
    """Merge changed leaders into a table in parts by key; parts that no changed key falls in stay untouched."""
    spark = leaders.sparkSession

    def merge(batch: DataFrame, _batch_id: int) -> None:
        rows = cut_lineage(batch.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")))
        touched = [r["part"] for r in rows.select("part").distinct().collect()]  # PARTS at most
        if not touched:
            return
        old = read_inventory(spark, path, rows.schema).where(F.col("part").isin(touched))
        stay = old.join(rows.select("key", "share"), ["key", "share"], "left_anti").select(rows.columns)
        merged = cut_lineage(stay.unionByName(rows))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    with keyed_state(spark):
        return leaders.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()


def leaders_of(kept: DataFrame) -> DataFrame:
    """The leader of each key among those of its shares (SPREAD rows a key)."""
    return kept.groupBy("key").agg(F.max_by("leader", F.struct("total", -F.col("leader"))).alias("leader"), F.max("total").alias("total"))


class _Periods(StatefulProcessor):
    """Counts and sums of a period until the watermark closes it; what comes later is marked as late."""

    def __init__(self, ahead_ms: int) -> None:
        self.ahead_ms = ahead_ms  # from a period's end to the watermark that closes it

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, amount long")

    def _row(self, key, n: int, amount: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "start": [key[1]], "status": [status], "n": [n], "amount": [amount]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = amount = 0
        for f in rows:
            n, amount = n + len(f), amount + int(f["amount"].sum())
        closes = int(key[2]) + self.ahead_ms
        if timerValues.getCurrentWatermarkInMs() >= closes:
            yield self._row(key, n, amount, "late")
            return
        if self.sums.exists():
            held = self.sums.get()
            n, amount = n + int(held[0]), amount + int(held[1])
        else:
            self.handle.registerTimer(closes)
        self.sums.update((n, amount))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, amount = self.sums.get()
        self.sums.clear()
        yield self._row(key, int(n), int(amount), "closed")


def _millis(spark: SparkSession, length: str) -> int:
    return int(spark.range(1).select((F.unix_millis(F.lit("2000-01-01").cast("timestamp") + F.expr(f"interval {length}")) - F.unix_millis(F.lit("2000-01-01").cast("timestamp"))).alias("m")).first()["m"])


def closing_periods(events: DataFrame, time: str, key: str, id_col: str, amount: str, period: str, grace: str, keep: str) -> DataFrame:
    """``key, start, status, n, amount``: sums of closed periods, and of rows that came after the close.

    A period (``day``, ``week``, ``month``, ...) closes when the latest event seen in earlier
    triggers lies ``grace`` after its end: an event-time timer fires. Rows that come later are
    given out at once as ``late``. ``keep`` (at least ``grace``) is the delay of the watermark: rows older than
    that are dropped by the engine and counted in its progress. Periods still open give no rows.
    Rows of a period are dealt into shares by ``id_col``; ``period_totals`` adds them up.
    """
    spark = events.sparkSession
    ahead = _millis(spark, grace) - _millis(spark, keep)
    start = F.date_trunc(period, F.col(time))
    rows = events.withWatermark(time, keep).select(
        F.col(key).cast("string").alias("key"), start.alias("start"), F.unix_millis(start + F.expr(f"interval 1 {period}")).alias("end_ms"),
        dealt(id_col).alias("share"), F.col(amount).alias("amount"), F.col(time),
    )
    return rows.groupBy("key", "start", "end_ms", "share").transformWithStateInPandas(
        _Periods(ahead), "key string, start timestamp, status string, n long, amount long", outputMode="Append", timeMode="EventTime"
    )


def period_totals(marked: DataFrame) -> DataFrame:
    """One row for each key and period: what came in time and what came late."""
    sums = [F.sum(F.when(F.col("status") == s, F.col(c)).otherwise(0)).alias(f"{c}_{s}") for s in ("closed", "late") for c in ("n", "amount")]
    return marked.groupBy("key", "start").agg(*sums)


def drain(stream: DataFrame, out: str, state: str) -> None:
    """Append what a stream gives out for all input that is there now; called again, it goes on from there."""
    with keyed_state(stream.sparkSession):
        q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def mark_incomplete(windows: DataFrame, watermark: pd.Timestamp | str, end: str = "end") -> DataFrame:
    """A window is complete once the watermark has passed its end."""
    return windows.withColumn("complete", F.col(end) <= F.lit(watermark).cast("timestamp_ntz"))
