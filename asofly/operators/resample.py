"""Bars from ticks and from finer bars, knowable no earlier than all that they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket(column: str, width: str):
    """Start of a left-closed bucket; widths must divide a day, so buckets start at midnight."""
    return F.window(column, width)["start"].cast("timestamp_ntz")


def bars_from_ticks(ticks: DataFrame, width: str) -> DataFrame:
    """OHLCV bars of ticks (asset, event_time, tie, value); (event_time, tie) orders them totally."""
    order = F.struct("event_time", "tie")
    return (
        ticks.groupBy("asset", bucket("event_time", width).alias("bucket"))
        .agg(
            F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
            F.sum("value").alias("volume"), F.count(F.lit(1)).alias("trades"), F.sum(F.col("value") * F.col("value")).alias("quote_volume"),
            F.sum(F.when(F.col("tie") % 2 == 0, F.col("value"))).alias("taker_buy_base"),
        )
        .withColumnRenamed("bucket", "event_time")
        .withColumn("available_time", F.expr(f"event_time + interval {width}"))
    )


HOW = {
    "first": lambda c, t: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), t)),
    "last": lambda c, t: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), t)),
    "max": lambda c, t: F.max(c), "min": lambda c, t: F.min(c), "mean": lambda c, t: F.avg(c),
    "sum": lambda c, t: F.coalesce(F.sum(c), F.lit(0)),
}


def resample(frame: DataFrame, width: str, how: dict[str, str], *, order: str = "event_time") -> DataFrame:
    """Named aggregations per asset and bucket; first and last skip nulls. available_time (and ingested_at) is the latest of
    the rows, source (if there) the first.

    Buckets in which nothing is available vanish. A sum over nulls alone is 0.
    """
    aggs = [HOW[h](c, F.col(order)).alias(c) for c, h in how.items()]
    carried = {"ingested_at": "max", "source": "first"}
    more = [HOW[h](c, F.col(order)).alias(c) for c, h in carried.items() if c in frame.columns and c not in how]
    out = frame.groupBy("asset", bucket("event_time", width).alias("bucket")).agg(*aggs, F.max("available_time").alias("available_time"), *more)
    return out.withColumnRenamed("bucket", "event_time").filter("available_time is not null")


def resample_ohlcv(frame: DataFrame, width: str) -> DataFrame:
    """Coarser OHLCV bars; buckets without a full price are dropped."""
    out = resample(frame, width, {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"})
    return out.dropna(subset=["open", "high", "low", "close"])
