"""Market-data frames derived from the given tables: bars, funding, open interest, membership and others.

Times are UTC without a zone; `available_time` is when a row could first be known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asofly.operators.resample import bars_from_ticks


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, hours: int = 1, asset: Column | None = None) -> DataFrame:
    """OHLCV bars of `events`; asset is the event type unless another expression is given."""
    events = read(spark, sf_dir, "events").select((asset if asset is not None else F.col("event_type")).alias("asset"), F.col("ts").alias("event_time"), F.col("event_id").alias("tie"), "value")
    return bars_from_ticks(events, f"{hours} hours")


def wide_bars(spark: SparkSession, sf_dir: str, hours: int = 4) -> DataFrame:
    """Sparser bars of sixteen assets."""
    return bars(spark, sf_dir, hours, F.concat(F.lit("u"), (F.col("user_id") % 16).cast("string")))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter("event_id % 8 = 0").select(F.col("event_type").alias("asset"), F.col("ts").alias("event_time"), F.col("ts").alias("available_time"), ((F.col("value") - 35) / 1e5).alias("funding_rate"), F.lit(8).alias("funding_interval_hours"))


def open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter("event_id % 5 = 0").select(
        F.col("event_type").alias("asset"), F.col("ts").alias("event_time"), F.expr("ts + interval 5 minutes").alias("available_time"),
        (F.col("value") + 1000).alias("open_interest"), (F.col("value") * 1000).alias("sum_open_interest_value"), F.lit("BINANCE_METRICS_DELAY_5M").alias("availability_assumption"),
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day the three assets with the highest value of the day before."""
    from asofly.operators.universe import top_by_day

    days = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("asset"), F.expr("date_trunc('day', ts) + interval 1 day").alias("selection_time")).agg(F.sum("value").alias("v"))
    return top_by_day(days, 3)


def long_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), F.col("l_shipdate").alias("event_time")).agg(F.avg(F.expr("l_extendedprice / l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


def long_history_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, n: at least as many as its rows in long_history."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset")).agg(F.count(F.lit(1)).alias("n"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.expr("l_extendedprice * (l_discount - 0.05)").alias("pnl"), F.col("l_returnflag").alias("outcome"), F.col("l_shipdate").alias("exit_time"), F.col("l_suppkey").alias("asset"), F.col("l_orderkey").alias("trade_id"), F.col("l_linenumber").alias("leg"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("slot"), F.col("o_totalprice").alias("equity_after"), F.col("o_orderkey").alias("seq"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("factor_id"), F.col("text").alias("formula"), F.col("source").alias("research_family"), F.col("lang").alias("mechanism"))
