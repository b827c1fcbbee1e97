"""Daily asset universes."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STABLE = ("USDCUSDT", "FDUSDUSDT", "TUSDUSDT", "USDPUSDT", "DAIUSDT", "BUSDUSDT")
EXCLUSIONS = ("LISTING_METADATA_UNAVAILABLE", "LISTING_AGE_BELOW_180_DAYS", "OHLCV_DAYS_INSUFFICIENT", "FUNDING_DAYS_INSUFFICIENT", "METRICS_OI_DAYS_INSUFFICIENT", "MEDIAN_UNAVAILABLE")


def top_by_day(days: DataFrame, k: int) -> DataFrame:
    """asset, selection_time, rank of the k assets with the highest v of each selection time, ties by name."""
    w = Window.partitionBy("selection_time").orderBy(F.desc("v"), "asset")
    return days.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("asset", "selection_time", "rank")


def excluded_name(asset: Column) -> Column:
    """Stable pairs, leveraged tokens and wrapped assets."""
    return asset.isin(*STABLE) | asset.rlike("(UP|DOWN|BULL|BEAR)USDT$") | asset.rlike("^W(BTC|ETH|BETH)")


def competition_rank(value: str, by: list[str]) -> Column:
    """1 for the highest; equal values share the best rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value)))


def trailing_stats(days: DataFrame, rows: DataFrame, value: str, window_days: int = 30) -> DataFrame:
    """Per selection time and asset: distinct days and the median of a value over the trailing days, strictly known before.

    selection times are midnights. A row enters the window on the first day that knows it and leaves it window_days after its
    own, so it's sent to the stretch of days (at least four windows long) that it enters in and, at most, the next one; in a
    stretch a sorted window takes rows in and gives them up again. Null values count for days, not for the median.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    own = day(F.to_date("event_time"))
    ready = day(F.to_date("available_time")) + F.when(F.col("available_time") > F.date_trunc("day", "available_time"), 1).otherwise(0)
    span = max(4 * window_days, 120)
    sent = rows.select("asset", own.alias("own"), F.greatest(own + 1, ready).alias("come"), (own + window_days).alias("go"), F.col(value).cast("double").alias("value")).filter("come <= go")
    sent = sent.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("come") / span), F.floor(F.col("go") / span))))

    def slide(table: pa.Table) -> pa.Table:
        stretch, asset = table.column("stretch")[0].as_py(), table.column("asset").slice(0, 1)
        come, go, when, values = (table.column(c).to_pylist() for c in ("come", "go", "own", "value"))
        first, last = stretch * span, (stretch + 1) * span - 1
        enter, leave = defaultdict(list), defaultdict(list)
        for i in range(len(come)):
            enter[max(come[i], first)].append(i)
            leave[go[i] + 1].append(i)
        held, seen, out = [], Counter(), []
        for d in range(min(enter), min(max(go), last) + 1):
            for i in enter.get(d, ()):
                seen[when[i]] += 1
                if values[i] is not None:
                    insort(held, values[i])
            for i in leave.get(d, ()):
                seen[when[i]] -= 1
                if not seen[when[i]]:
                    del seen[when[i]]
                if values[i] is not None:
                    del held[bisect_left(held, values[i])]
            if seen:
                n = len(held)
                out.append((d, len(seen), None if not n else held[n // 2] if n % 2 else (held[n // 2 - 1] + held[n // 2]) / 2))
        columns = [pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.float64()))]
        return pa.table([pa.chunked_array([asset.combine_chunks()]).take(pa.array([0] * len(out), pa.int64())), *columns], schema.names)

    schema = T.StructType([T.StructField("asset", rows.schema["asset"].dataType), T.StructField("d", T.IntegerType()), T.StructField("days", T.LongType()), T.StructField("median", T.DoubleType())])
    found = sent.groupBy("asset", "stretch").applyInArrow(slide, schema)
    at = F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")).cast("timestamp_ntz")
    return found.select(at.alias("selection_time"), "asset", "days", "median").join(days.select("selection_time").distinct(), "selection_time", "left_semi")


def select_universe(candidates: DataFrame, k: int, minimum: int) -> DataFrame:
    """Rank by summed competition ranks of quote volume and open interest, ties by name; a short day is marked.

    candidates: selection_time, asset, median_quote_volume, median_oi_value and reason (null if eligible).
    """
    ok = candidates.filter("reason is null")
    ranks = competition_rank("median_quote_volume", ["selection_time"]) + competition_rank("median_oi_value", ["selection_time"])
    w = Window.partitionBy("selection_time").orderBy("score", "asset")
    out = ok.withColumn("score", ranks).withColumn("rank", F.row_number().over(w))
    out = out.withColumn("eligible", F.count(F.lit(1)).over(Window.partitionBy("selection_time")))
    return out.filter(F.col("rank") <= k).withColumn("short", F.col("eligible") < minimum).select("selection_time", "asset", "score", "rank", "eligible", "short")


def core_plus_top(volumes: DataFrame, core: list[str], k: int = 8, least: int = 5) -> DataFrame:
    """The k assets of highest median volume besides fixed core ones; with fewer than `least` the core alone."""
    w = Window.orderBy(F.desc("median_volume"), "asset")
    extra = volumes.filter(~F.col("asset").isin(core)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    n = volumes.filter(~F.col("asset").isin(core)).agg(F.count(F.lit(1)).alias("n"))
    chosen = extra.crossJoin(n).filter(F.col("n") >= least).select("asset", "rank")
    fixed = volumes.filter(F.col("asset").isin(core)).select("asset", F.lit(0).alias("rank"))
    return fixed.unionByName(chosen)


def listings(bars: DataFrame) -> DataFrame:
    """First event of each asset, and when it was available."""
    return bars.groupBy("asset").agg(F.min("event_time").alias("listing_time"), F.min_by("available_time", "event_time").alias("listing_available_time"))


def migration_universe(daily: DataFrame, hourly: DataFrame, t: str, *, least_days: int = 180, most_missing: float = 0.01, window_days: int = 30) -> DataFrame:
    """Completed daily bars, share of hourly bars missing in the last days, median volume, and whether an asset may stay."""
    at = F.lit(t).cast("timestamp_ntz")
    days = daily.filter(F.col("available_time") <= at).groupBy("asset").agg(F.count(F.lit(1)).alias("daily_bars"), F.median("volume").alias("median_volume"))
    hours = hourly.filter((F.col("event_time") >= at - F.make_dt_interval(days=F.lit(window_days))) & (F.col("available_time") <= at)).groupBy("asset").agg((1 - F.count(F.lit(1)) / (24.0 * window_days)).alias("missing_share"))
    return days.join(hours, "asset").withColumn("eligible", (F.col("daily_bars") >= least_days) & (F.col("missing_share") <= most_missing))
