"""Recursive and swing indicators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.functions.factors import W, change, full
from asofly.functions.patterns import engulfing, inside_bar, pin_bar
from asofly.operators.timeblocks import POS, in_blocks, numbered, running

CHUNK = 256


def ewms(frame: DataFrame, averages: dict[str, tuple[str, float]]) -> DataFrame:
    """y_t = (1 - alpha) y_{t-1} + alpha x_t, y_0 = x_0, per asset, to about 1e-13, for each name and (column, alpha).

    The recursion is affine, so it splits into chunks: a running sum within each, and the value carried in from the chunks
    before, whose weights fall so fast that a fixed number of them is enough: each chunk's end goes to so many later ones.
    """
    out = numbered(frame, "_at").withColumn("_c", F.struct(F.struct("asset").alias("key"), F.floor(F.col("_at") / CHUNK).alias("k"))).withColumn("_i", (F.col("_at") % CHUNK).cast("double"))
    inner = Window.partitionBy("_c").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local, sent = {}, []
    for name, (x, alpha) in averages.items():
        scale = F.pow(F.lit(1 - alpha), F.col("_i"))
        local[f"_l_{name}"] = scale * F.sum(F.when(F.col("_at") == 0, 1.0).otherwise(alpha) * F.col(x) / scale).over(inner)
        reach = max(1, math.ceil(30 / (-math.log(1 - alpha) * CHUNK))) + 1
        sent.append((name, (1 - alpha) ** CHUNK, reach))
    out = out.withColumns(local)
    ends = out.groupBy("_c").agg(*(F.max_by(f"_l_{name}", "_at").alias(f"_l_{name}") for name in averages))
    ends = ends.select("*", F.explode(F.sequence(F.lit(1), F.lit(max(reach for *_, reach in sent)))).alias("_d"))
    later = F.struct(F.col("_c.key").alias("key"), (F.col("_c.k") + F.col("_d")).alias("k")).alias("_c")
    ends = ends.groupBy(later).agg(*(F.sum(F.when(F.col("_d") <= reach, F.col(f"_l_{name}") * F.pow(F.lit(fade), F.col("_d") - 1))).alias(f"_k_{name}") for name, fade, reach in sent))
    out = out.join(ends, "_c", "left")
    out = out.withColumns({name: F.col(f"_l_{name}") + F.pow(F.lit(1 - alpha), F.col("_i") + 1) * F.coalesce(f"_k_{name}", F.lit(0.0)) for name, (_, alpha) in averages.items()})
    return out.drop("_at", "_c", "_i", *(f"_{x}_{name}" for x in "lk" for name in averages))


def ewm(frame: DataFrame, x: str, alpha: float, name: str) -> DataFrame:
    return ewms(frame, {name: (x, alpha)})


def emas(frame: DataFrame, x: str, spans: dict[str, int]) -> DataFrame:
    """Several averages of one column, in one pass."""
    return ewms(frame, {name: (x, 2 / (span + 1)) for name, span in spans.items()})


def ema(frame: DataFrame, x: str, span: int, name: str) -> DataFrame:
    return emas(frame, x, {name: span})


def true_range() -> Column:
    prev = F.lag("close", 1).over(W())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr(frame: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    """Wilder's average true range."""
    return ewm(in_blocks(numbered(frame, POS), lambda f: f.withColumn("_tr", true_range()), before=1), "_tr", 1 / n, name).drop("_tr", POS)


def sma(x: str, n: int) -> Column:
    return full(F.avg, x, n)


def swings(k: int = 3, confirmed: bool = False) -> Column:
    """1 at a swing high, -1 at a swing low (a low wins), 0 elsewhere and in the first and last k rows.

    The mark looks k bars ahead; confirmed: it's given k bars later, when it could be known.
    """
    w = W().rowsBetween(-k, k)
    whole = F.count(F.lit(1)).over(w) == 2 * k + 1
    mark = F.when(whole & (F.col("low") == F.min("low").over(w)), -1).when(whole & (F.col("high") == F.max("high").over(w)), 1).otherwise(0)
    return F.coalesce(F.lag(mark, k).over(W()), F.lit(0)) if confirmed else mark


def trend(fast: str, slow: str) -> Column:
    return F.when((F.col("close") > F.col(fast)) & (F.col(fast) > F.col(slow)), 1).when((F.col("close") < F.col(fast)) & (F.col(fast) < F.col(slow)), -1).otherwise(0)


def with_swings(frame: DataFrame, k: int = 3, name: str = "swing", confirmed: bool = False) -> DataFrame:
    """The frame with the mark of `swings`, chunk by chunk."""
    return in_blocks(frame, lambda f: f.withColumn(name, swings(k, confirmed)), before=2 * k if confirmed else k, after=0 if confirmed else k)


def break_of_structure(frame: DataFrame, k: int = 3, confirmed: bool = False) -> DataFrame:
    """Changes, clipped to one, of whether the close is beyond the last swing before this bar."""
    return breaks(with_swings(numbered(frame, POS), k, "_s", confirmed)).drop(POS)


def breaks(marked: DataFrame) -> DataFrame:
    """break_of_structure of bars with their swing mark `_s`."""
    level = {"_h": ("last", F.when(F.col("_s") == 1, F.col("high"))), "_l": ("last", F.when(F.col("_s") == -1, F.col("low")))}
    out = running(marked, level)

    def steps(f: DataFrame) -> DataFrame:
        f = f.withColumn("_b", F.when(F.col("close") > F.lag("_h", 1).over(W()), 1).when(F.col("close") < F.lag("_l", 1).over(W()), -1).otherwise(0))
        step = F.greatest(F.least(F.col("_b") - F.lag("_b", 1).over(W()), F.lit(1)), F.lit(-1))
        return f.withColumn("bos", F.coalesce(step, F.lit(0)))

    return in_blocks(out, steps, before=2).drop("_s", "_h", "_l", "_b")


def patterns(frame: DataFrame, k: int = 3) -> DataFrame:
    """Averages, trend and every candle pattern of each bar, and the next bar's open."""
    near = {"_tr": true_range(), "_s": swings(k), "engulfing": engulfing(), "inside": inside_bar(), "next_open": F.lead("open", 1).over(W())}
    out = breaks(in_blocks(numbered(frame, POS), lambda f: f.withColumns(near), before=max(k, 1), after=max(k, 1)))
    out = ewms(out, {"ema_fast": ("close", 2 / 21), "ema_slow": ("close", 2 / 51), "ema_trend": ("close", 2 / 201), "atr": ("_tr", 1 / 14)})
    return out.withColumns({"trend": trend("ema_fast", "ema_slow"), "pin": pin_bar("atr")}).drop("_tr", POS)


def confluence(frame: DataFrame, *, stop_atr: float = 1.5, reward: float = 3.0, atr_band: tuple[float, float] = (0.005, 0.05)) -> DataFrame:
    """Every bar with a signal (1, -1, 0), and entry at the next open, stop and target from the ATR where there's one.

    A signal needs the close on the same side of the slowest average, the trend, an ATR within the band (as a share of the
    close) and any pattern or break, all in one direction.
    """
    out = patterns(frame).withColumnRenamed("next_open", "entry")
    calm = F.try_divide(F.col("atr"), F.col("close")).between(*atr_band)
    agree = lambda s: (F.signum(F.col("close") - F.col("ema_trend")) == s) & (F.col("trend") == s) & calm & ((F.col("pin") == s) | (F.col("engulfing") == s) | (F.col("bos") == s))
    out = out.withColumn("signal", F.when(agree(1), 1).when(agree(-1), -1).otherwise(0))
    risk = F.when(F.col("signal") != 0, stop_atr * F.col("atr") * F.col("signal"))
    return out.withColumn("stop", F.col("entry") - risk).withColumn("target", F.col("entry") + reward * risk)


def last_momentum_signal(frame: DataFrame, n: int = 20, *, stop_share: float = 0.05, target_share: float = 0.10) -> DataFrame:
    """Direction of the n-bar move at each asset's last bar, stop and target that far from the close; null without a move."""
    out = in_blocks(frame, lambda f: f.withColumns({"_m": change("close", n), "_was": F.lag("close", n).over(W())}), before=n)
    out = out.groupBy("asset").agg(F.max_by(F.struct("event_time", "close", "_m", "_was"), "event_time").alias("r")).select("asset", "r.*")
    side = F.nullif(F.signum(F.col("close") - F.col("_was")).cast("int"), F.lit(0))
    out = out.select("asset", "event_time", "close", F.col("_m").alias("momentum"), side.alias("direction"))
    return out.withColumn("stop", F.col("close") * (1 - F.col("direction") * stop_share)).withColumn("target", F.col("close") * (1 + F.col("direction") * target_share))


def level_groups(levels: Column, tolerance: float) -> Column:
    """Sorted levels gathered while each lies nearer than a tolerance to its group's mean: array of (total, n)."""
    empty = F.expr("cast(array() as array<struct<total:double,n:int>>)")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        mean = last["total"] / last["n"]
        joins = (F.size(acc) > 0) & (F.try_divide(F.abs(x - mean), mean) < tolerance)
        grown = F.struct((last["total"] + x).alias("total"), (last["n"] + 1).alias("n"))
        new = F.struct(x.alias("total"), F.lit(1).alias("n"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(F.array_sort(levels), empty, step)


def support_resistance(frame: DataFrame, *, k: int = 3, recent: int = 50, tolerance: float = 0.008) -> DataFrame:
    """Clusters of each asset's last `recent` swing highs (resistance) and, apart from them, swing lows (support)."""
    kind = F.when(F.col("_s") == 1, "resistance").otherwise("support")
    s = with_swings(frame, k, "_s").filter("_s <> 0").select("asset", "event_time", kind.alias("kind"), F.when(F.col("_s") == 1, F.col("high")).otherwise(F.col("low")).alias("level"))
    s = s.withColumn("_rn", F.row_number().over(Window.partitionBy("asset", "kind").orderBy(F.desc("event_time")))).filter(F.col("_rn") <= recent)
    g = s.groupBy("asset", "kind").agg(F.collect_list("level").alias("levels")).select("asset", "kind", F.explode(level_groups(F.col("levels"), tolerance)).alias("g"))
    return g.select("asset", "kind", (F.col("g.total") / F.col("g.n")).alias("mean"), "g.n")


__all__ = ["atr", "break_of_structure", "breaks", "confluence", "ema", "emas", "ewm", "ewms", "last_momentum_signal", "patterns", "sma", "support_resistance", "swings", "trend", "true_range", "with_swings"]
