"""Market regimes and cycles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofly.functions import factors as fx
from asofly.operators.asof import asof_join
from asofly.operators.prefix import prefix_quantiles
from asofly.operators.timeblocks import by_length, in_blocks, numbered, with_episodes
from asofly.plans.shared import stash

#: Quantiles of the regime inputs; members of a full universe, gain of the sigmoid, least coverage and most effect of funding.
QUANTILES = {"volatility": 0.75, "trend": 0.60, "illiquidity": 0.95}
MEMBERS, GAIN, LEAST_COVERAGE, MOST_FUNDING = 12, 3.0, 0.5, 0.10


def composite(bars: DataFrame) -> DataFrame:
    """One bar per time over all assets."""
    return bars.groupBy("event_time").agg(F.avg("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.avg("close").alias("close"), F.sum("volume").alias("volume"))


def _inputs(f: DataFrame, n: int) -> DataFrame:
    f = f.withColumn("_lr", fx.log_return("close")).withColumn("_il", F.abs("_lr") / F.nullif(F.col("close") * F.col("volume"), F.lit(0.0)))
    f = f.withColumns({"volatility": fx.realized_volatility("_lr", n), "illiquidity": fx.amihud("_il", n), "_ret": F.abs(fx.change("close", n))})
    return f.withColumn("trend", F.col("_ret") / F.nullif(F.col("volatility"), F.lit(0.0))).drop("_lr", "_il", "_ret")


def inputs(frame: DataFrame, n: int = 48, *, sizes: DataFrame | None = None) -> DataFrame:
    """Volatility, trend strength and illiquidity over n rows. sizes: see timeblocks.by_length."""
    return in_blocks(frame, lambda f: _inputs(f, n), before=n, sizes=sizes)


def thresholds(frame: DataFrame, by: list[str]) -> DataFrame:
    """Exact, linearly interpolated quantiles of the inputs."""
    return frame.groupBy(*by).agg(*(F.percentile(c, F.lit(q)).alias(f"q_{c}") for c, q in QUANTILES.items()))


def with_thresholds(frame: DataFrame, until: Column, n: int = 48, *, sizes: DataFrame | None = None) -> DataFrame:
    """The frame with its inputs and their thresholds over the asset's rows before `until`; assets without such rows, and rows
    without an asset, are left out. sizes: see timeblocks.by_length."""
    fit = F.col("event_time") < until

    def short(f: DataFrame) -> DataFrame:
        w = Window.partitionBy("asset")
        f = _inputs(f.filter("asset is not null"), n)
        f = f.withColumns({"_fit": F.max(fit).over(w), **{f"q_{c}": F.percentile(F.when(fit, F.col(c)), F.lit(q)).over(w) for c, q in QUANTILES.items()}})
        return f.filter("_fit").drop("_fit")

    def long(f: DataFrame) -> DataFrame:
        f = stash(inputs(f, n), "inputs")
        return f.join(thresholds(f.filter(fit), ["asset"]), "asset")

    return by_length(frame, sizes, short, long)


def label() -> Column:
    """Regime by thresholds; stress overrides, and a null input counts as not above."""
    above = lambda c: F.coalesce(F.col(c) > F.col(f"q_{c}"), F.lit(False))
    return (
        F.when(above("illiquidity"), "liquidity_stress").when(above("trend") & above("volatility"), "trend_high_vol").when(above("trend"), "trend_low_vol").when(above("volatility"), "range_high_vol").otherwise("range_low_vol")
    )


def expanding_thresholds(frame: DataFrame, *, initial: int, every: int, sizes: DataFrame | None = None) -> DataFrame:
    """Thresholds of each block of `every` rows from all rows before the block, refitted block by block.

    A row at position p counts from the first block after it on. No row is sent to the blocks it serves: prefix_quantiles
    merges counts. An asset that fits into a chunk is looked through where its rows lie (sizes: see timeblocks.by_length).
    """
    if sizes is not None:
        return by_length(frame, sizes, lambda f: _short_thresholds(f, initial, every), lambda f: expanding_thresholds(f, initial=initial, every=every))
    pos = stash(numbered(frame).select("asset", "pos", *QUANTILES), "positions")
    last = pos.groupBy("asset").agg(F.floor((F.max("pos") - initial) / every).alias("last")).filter("last >= 0")
    first = F.greatest(F.floor((F.col("pos") - initial) / every) + 1, F.lit(0)).alias("block")
    return prefix_quantiles(pos.select("asset", first, *QUANTILES), last, QUANTILES, key="asset", prefix="q_")


def _short_thresholds(frame: DataFrame, initial: int, every: int) -> DataFrame:
    """expanding_thresholds of assets of a few thousand rows at most: the window leaves each in one task, in order."""
    names = ["asset", "block", *(f"q_{c}" for c in QUANTILES)]

    def quantile(x: np.ndarray, q: float) -> float:
        x = x[~np.isnan(x)]
        if not len(x):
            return np.nan
        place = (len(x) - 1) * q
        low = int(place)
        if low == place:
            return np.partition(x, low)[low]
        x = np.partition(x, (low, low + 1))
        return (1 - (place - low)) * x[low] + (place - low) * x[low + 1]

    def solved(rows: pa.Table) -> pa.RecordBatch:
        starts = np.flatnonzero(rows.column("pos").to_numpy() == 0)
        values = [rows.column(c).to_numpy() for c in QUANTILES]
        at, blocks, out = [], [], []
        for lo, hi in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            for block in range((hi - lo - 1 - initial) // every + 1):
                end = lo + initial + every * block
                at.append(lo)
                blocks.append(block)
                out.append([quantile(v[lo:end], q) for v, q in zip(values, QUANTILES.values(), strict=True)])
        found = np.array(out, float).reshape(-1, len(QUANTILES))
        assets = rows.column("asset").take(pa.array(at, pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([assets, pa.array(blocks, pa.int64()), *(pa.array(found[:, i], from_pandas=True) for i in range(len(QUANTILES)))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            starts = np.flatnonzero(b.column(1).to_numpy() == 0)
            if len(starts):
                done, held = [*held, b.slice(0, starts[-1])], [b.slice(starts[-1])]
                yield solved(pa.Table.from_batches(done))
            else:
                held.append(b)
        if held:
            yield solved(pa.Table.from_batches(held))

    rows = frame.withColumn("pos", (F.row_number().over(fx.W()) - 1).cast("long")).select("asset", "pos", *(F.col(c).cast("double").alias(c) for c in QUANTILES))
    kinds = [frame.schema["asset"].dataType, T.LongType(), *(T.DoubleType() for _ in QUANTILES)]
    return rows.sortWithinPartitions("asset", "pos").mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def episode_summary(frame: DataFrame, state: str, least: int = 30, volatility: str | None = None) -> DataFrame:
    """Rows of each state and whether they're enough; if so its episodes, their mean duration and the mean volatility."""
    value = F.col(volatility) if volatility else F.lit(None).cast("double")
    runs = with_episodes(frame, state, "_e").groupBy("asset", state, "_e").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"), F.count(value).alias("_k"))
    out = runs.groupBy("asset", state).agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("_ep"), F.avg("_n").alias("_d"), F.try_divide(F.sum("_v"), F.sum("_k")).alias("_mv"))
    enough = F.col("n_rows") >= least
    given = [F.when(enough, F.col(a)).alias(b) for a, b in (("_ep", "episodes"), ("_d", "mean_duration"), ("_mv", "mean_volatility"))]
    return out.select("asset", state, "n_rows", *given, F.when(enough, "sufficient_evidence").otherwise("insufficient_evidence").alias("status"))


def universe_features(bars: DataFrame, volume: str, oi: str | None = None) -> DataFrame:
    """Per time: members, medians and the three largest's share of what's positive (0 without any)."""
    w = Window.partitionBy("event_time").orderBy(F.desc(volume), "asset")
    more = [F.median(oi).alias("median_oi_value")] if oi else []
    some = F.when(F.col(volume) > 0, F.col(volume))
    top = F.coalesce(F.try_divide(F.sum(F.when(F.col("_rn") <= 3, some)), F.sum(some)), F.lit(0.0))
    return bars.withColumn("_rn", F.row_number().over(w)).groupBy("event_time").agg(F.count(F.lit(1)).alias("member_count"), F.median(volume).alias("median_quote_volume"), top.alias("top3_share"), *more)


def cycle_features(daily: DataFrame, *, rows: int = 30) -> DataFrame:
    """What the cycle is judged by, of each day: breadth, medians of the last rows against those before, concentration.

    The baseline is the `rows` days before the last `rows`, or the very first `rows` while there aren't that many. Changes
    against a baseline that isn't positive count as 0. One row per day, so one window.
    """
    w = Window.orderBy("event_time")
    now, before, all_ = w.rowsBetween(-(rows - 1), 0), w.rowsBetween(-(2 * rows - 1), -rows), w.rowsBetween(Window.unboundedPreceding, 0)
    mid = lambda c, over: F.percentile(c, F.lit(0.5)).over(over)
    out = daily.withColumn("sample_count", F.row_number().over(w)).withColumns({"breadth": clamp(F.avg("member_count").over(now) / MEMBERS), "concentration": mid("top3_share", now)})
    for name, c in (("volume", "median_quote_volume"), ("oi", "median_oi_value")):
        first = F.when(F.col("sample_count") <= rows, F.col(c))
        base = F.when(F.col("sample_count") >= 2 * rows, mid(c, before)).otherwise(mid(first, all_))
        out = out.withColumn(f"trailing_{name}", mid(c, now)).withColumn(f"baseline_{name}", base)
        change = F.when(F.col(f"baseline_{name}") > 0, F.try_divide(F.col(f"trailing_{name}") - F.col(f"baseline_{name}"), F.col(f"baseline_{name}")))
        out = out.withColumn(f"{name}_momentum", F.coalesce(change, F.lit(0.0)))
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-20.0)), F.lit(20.0))))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def market_cycle(daily: DataFrame, funding: DataFrame | None = None, *, rows: int = 30, least: int = 30) -> DataFrame:
    """Probabilities of bull, neutral and risk-off of every day, the likeliest (ties: larger name) and its confidence.

    funding: event_time, share_positive, coverage, of which the latest at or before the day shifts the bull score, if it
    covers enough assets; it never lifts a bull score that lies under the risk. Fewer than `least` days: insufficient evidence.
    """
    out = cycle_features(daily, rows=rows)
    if funding is None:
        out = out.withColumn("_share", F.lit(None).cast("double"))
    else:
        seen = asof_join(out, funding.select("event_time", "share_positive", "coverage"), on="event_time", prefix="funding_")
        out = seen.withColumn("_share", F.when(F.col("coverage") >= LEAST_COVERAGE, F.col("share_positive")))
    score = lambda parts, p: sum((F.col(c) * k for c, k in parts.items()), p)
    out = out.withColumns({"_b": F.col("breadth"), "_v": sigmoid(GAIN * F.col("volume_momentum")), "_o": sigmoid(GAIN * F.col("oi_momentum")), "_p": clamp((F.col("concentration") - 0.55) / 0.35)})
    out = out.withColumns({f"_not{c}": 1 - F.col(c) for c in ("_b", "_v", "_o", "_p")})
    out = out.withColumn("_bull", score({"_b": 0.40, "_v": 0.30, "_o": 0.25, "_not_p": 0.05}, F.lit(0.0))).withColumn("_risk", score({"_not_b": 0.35, "_not_v": 0.30, "_not_o": 0.25, "_p": 0.10}, F.lit(0.0)))
    term = (1 - 2 * F.col("_share")) * MOST_FUNDING
    out = out.withColumn("funding_term", F.when(term.isNotNull(), F.when((term > 0) & (F.col("_risk") > F.col("_bull")), 0.0).otherwise(F.least(F.greatest(term, F.lit(-MOST_FUNDING)), F.lit(MOST_FUNDING)))))
    out = out.withColumn("_bull", F.when(F.col("funding_term").isNull(), F.col("_bull")).otherwise(clamp(F.col("_bull") + F.col("funding_term"))))
    out = out.withColumn("_neutral", F.greatest(F.lit(0.05), 1 - F.abs(F.col("_bull") - F.col("_risk")))).withColumn("_sum", F.col("_bull") + F.col("_neutral") + F.col("_risk"))
    enough = F.col("sample_count") >= least
    out = out.withColumns({f"p_{n}": F.when(enough, F.col(c) / F.col("_sum")).otherwise(0.0) for n, c in (("bull", "_bull"), ("neutral", "_neutral"), ("risk_off", "_risk"))})
    best = F.when((F.col("p_risk_off") >= F.col("p_neutral")) & (F.col("p_risk_off") >= F.col("p_bull")), "risk_off").when(F.col("p_neutral") >= F.col("p_bull"), "neutral").otherwise("bull")
    out = out.withColumn("label", F.when(enough, best).otherwise("insufficient_evidence")).withColumn("confidence", F.greatest("p_bull", "p_neutral", "p_risk_off")).withColumn("funding_term", F.when(enough, F.col("funding_term")))
    return out.select("event_time", "p_bull", "p_neutral", "p_risk_off", "label", "confidence", "funding_term", "sample_count", "breadth", "volume_momentum", "oi_momentum", "concentration")
