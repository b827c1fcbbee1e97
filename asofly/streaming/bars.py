"""Structured Streaming twins: incremental bars, exactly-once intake, routing, and exits of open positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_bars(ticks: DataFrame, width: str, *, late: str = "5 minutes") -> DataFrame:
    """OHLCV bars of a tick stream (asset, event_time, tie, value), emitted once the watermark has passed their end."""
    order = F.struct("event_time", "tie")
    return (
        ticks.withWatermark("event_time", late).groupBy("asset", F.window("event_time", width).alias("w"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("volume"))
        .select("asset", F.col("w.start").alias("event_time"), "open", "high", "low", "close", "volume")
    )


def once(records: DataFrame, key: list[str], *, late: str = "1 day") -> DataFrame:
    """Re-delivered records dropped within the watermark."""
    return records.withWatermark("event_time", late).dropDuplicatesWithinWatermark(key)


def finished(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Rows of the batches that append_new has finished, with their writer and batch; None while there's no batch at all."""
    keys = T.StructType([T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())])
    try:
        commits = spark.read.schema(T.StructType([T.StructField("n", T.LongType()), *keys])).parquet(f"{path}/commits").select("writer", "batch").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    rows = spark.read.schema(T.StructType([*schema, *keys, T.StructField("day", T.DateType())])).option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(F.broadcast(commits), ["writer", "batch"], "left_semi")  # a row for each batch


def append_new(batch: DataFrame, batch_id: int, path: str, key: list[str], *, day: str = "event_time", writer: str = "intake") -> None:
    """foreachBatch sink: rows whose key isn't in the table yet are appended, so a replay changes nothing.

    A batch has a folder of its own, by writer (one for each query with its own checkpoint) and number, which a replay
    overwrites; readers (`finished`) see it from its commit on, which is written last. So a crash at any moment leaves
    nothing half done behind. Rows are partitioned by day; only the days that the batch touches are looked at.
    """
    spark, schema = batch.sparkSession, batch.schema
    new = batch.dropDuplicates(key).withColumn("day", F.to_date(day))
    seen = finished(spark, path, schema)
    if seen is not None:
        days = [r[0] for r in new.select("day").distinct().collect()]  # of one batch
        others = seen.filter(F.col("day").isin(days) & ((F.col("writer") != writer) | (F.col("batch") != batch_id)))
        new = new.join(others.select(*key), key, "left_anti").select(*schema.names, "day")
    at = f"writer={writer}/batch={batch_id}"
    new.write.mode("overwrite").partitionBy("day").parquet(f"{path}/data/{at}")
    spark.range(1).select(F.col("id").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{at}")


def route(records: DataFrame, *, now: str, stale_minutes: int, future_minutes: int = 1) -> DataFrame:
    """Every record with a reason why it's rejected, null if it's accepted: malformed, from the future, or stale."""
    at, t = F.col("event_time"), F.lit(now).cast(records.schema["event_time"].dataType)
    reason = (
        F.when(at.isNull() | F.col("value").isNull(), "MALFORMED").when(at > t + F.make_dt_interval(mins=F.lit(future_minutes)), "FUTURE").when(at < t - F.make_dt_interval(mins=F.lit(stale_minutes)), "STALE")
    )
    return records.withColumn("reason", reason)


def exits(bars: DataFrame, positions: DataFrame, *, late: str = "1 day", horizon: str = "365 days") -> DataFrame:
    """The first bar, in event time, that closes each open position: outcome, price, profit or loss. positions: position_id,
    asset, side (1 long, -1 short), opened, entry, stop, target, notional, stop_risk. event_time and opened are timestamps.

    The stop wins a bar that hits both. A hit is held until the watermark (`late` behind the newest bar) has passed it, so a
    late bar that hit earlier still wins; later hits of a closed position are ignored. A position is watched for `horizon`
    from its opening; once the watermark has passed that, its state is dropped. The session's state store must be RocksDB
    (spark.sql.streaming.stateStore.providerClass), as for any operator with timers.
    """
    live = bars.withWatermark("event_time", late)
    ends = F.col("opened") + F.expr(f"interval {horizon}")
    j = live.join(positions, "asset").withColumn("ends", ends).filter((F.col("event_time") > F.col("opened")) & (F.col("event_time") <= F.col("ends")))
    long = F.col("side") == 1
    stop = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    goal = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    gain = F.when(F.col("outcome") == "STOP", -F.col("stop_risk")).otherwise(F.try_divide(F.col("notional") * F.col("side") * (F.col("target") - F.col("entry")), F.col("entry")))
    hits = j.withColumn("outcome", F.when(stop, "STOP").when(goal, "TARGET")).filter("outcome is not null")
    hits = hits.select("position_id", "asset", "event_time", "outcome", F.when(F.col("outcome") == "STOP", F.col("stop")).otherwise(F.col("target")).alias("price"), gain.alias("pnl"), "ends")
    schema = hits.drop("ends").schema
    return hits.groupBy("position_id").transformWithStateInPandas(FirstExit(schema), schema, "append", "EventTime")


class FirstExit(StatefulProcessor):
    """Holds a position's earliest hit until event time has passed it, then gives it once; forgets the position at its end."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", T.StructType([f for f in self.schema if f.name != "position_id"]))
        self.ends = handle.getValueState("ends", "at long, closed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        top = pd.concat([f.nsmallest(1, "event_time") for f in rows]).nsmallest(1, "event_time").iloc[0]
        known = self.ends.get() if self.ends.exists() else None
        if known is None:
            known = (_millis(top["ends"]), False)
            self.ends.update(known)
            self.handle.registerTimer(known[0])
        if not known[1]:
            held = self.best.get() if self.best.exists() else None
            at = None if held is None else _millis(held[1])
            if at is None or _millis(top["event_time"]) < at:
                if at is not None and at != known[0]:
                    self.handle.deleteTimer(at)
                self.best.update(tuple(top[f.name] for f in self.schema if f.name != "position_id"))
                self.handle.registerTimer(_millis(top["event_time"]))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, (ends, _) = expiredTimerInfo.getExpiryTimeInMs(), self.ends.get()
        if self.best.exists():
            yield pd.DataFrame([(key[0], *self.best.get())], columns=self.schema.names)
            self.best.clear()
            self.ends.update((ends, True))
        if at >= ends:
            self.ends.clear()

    def close(self) -> None:
        pass


def _millis(t) -> int:
    t = pd.Timestamp(t)
    return int((t.tz_localize("UTC") if t.tzinfo is None else t).timestamp() * 1000)
