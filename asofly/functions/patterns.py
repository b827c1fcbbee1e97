"""Candle patterns: 1 bullish, -1 bearish, 0 none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofly.functions.factors import W


def before(c: str) -> Column:
    return F.lag(c, 1).over(W())


def engulfing() -> Column:
    """A body that strictly covers the one before, of the other colour."""
    o, c = F.col("open"), F.col("close")
    bull = (c > o) & (before("close") < before("open")) & (c > before("open")) & (o < before("close"))
    bear = (c < o) & (before("close") > before("open")) & (c < before("open")) & (o > before("close"))
    return F.when(bull, 1).when(bear, -1).otherwise(0)


def inside_bar() -> Column:
    """A range within the one before; equal highs and lows count."""
    return F.when((F.col("high") <= before("high")) & (F.col("low") >= before("low")), 1).otherwise(0)


def pin_bar(atr: str, *, wick: float = 0.6, body: float = 0.35) -> Column:
    """The longer wick at least `wick` average ranges, over a body of at most `body` of the bar's range (bars without range: none)."""
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    upper, lower = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    small = F.abs(F.col("close") - F.col("open")) <= span * body
    least = F.col(atr) * wick
    return F.when(small & (lower >= least) & (lower > upper), 1).when(small & (upper >= least) & (upper > lower), -1).otherwise(0)
