"""Factor, label and indicator columns over an (asset, time) window. A frame of n rows gives null until it holds n values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def W() -> WindowSpec:  # noqa: N802
    """Each asset's rows in order of time."""
    return Window.partitionBy("asset").orderBy("event_time")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rows(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or W()).rowsBetween(-(n - 1), 0)


def full(agg: Callable[[Column], Column], x: Column | str, n: int, w: WindowSpec | None = None, least: int | None = None) -> Column:
    """An aggregate over the last n rows, null unless `least` (n) of them have a value."""
    x = col(x)
    return F.when(F.count(x).over(rows(n, w)) >= (least or n), agg(x).over(rows(n, w)))


def change(x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    """x over x n rows ago, less one; a zero base gives null."""
    return F.try_divide(col(x), F.nullif(F.lag(col(x), n).over(w or W()), F.lit(0.0))) - 1


def momentum(close: str, n: int) -> Column:
    return change(close, n)


def reversal(close: str, n: int) -> Column:
    return -momentum(close, n)


def log_return(close: str, w: WindowSpec | None = None) -> Column:
    return F.ln(F.col(close) / F.nullif(F.lag(close, 1).over(w or W()), F.lit(0.0)))


def realized_volatility(log_ret: str, n: int) -> Column:
    """Sample deviation of n one-bar log returns (computed beforehand as a column)."""
    return full(F.stddev_samp, log_ret, n)


def zscore(x: str, n: int, least: int | None = None) -> Column:
    return (F.col(x) - full(F.avg, x, n, least=least)) / F.nullif(full(F.stddev_samp, x, n, least=least), F.lit(0.0))


def amihud(illiquidity: str, n: int) -> Column:
    return full(F.avg, illiquidity, n)


def crowding(z: str, d: str, clipped: bool = True) -> Column:
    return F.col(z) * (F.when(F.col(d).isNotNull(), F.greatest(F.col(d), F.lit(0.0))) if clipped else F.col(d))


def forward_log_return(close: str, n: int) -> Column:
    return F.ln(F.lead(close, n).over(W()) / F.nullif(F.col(close), F.lit(0.0)))


def average_rank(x: str, by: list[str]) -> Column:
    """Rank with ties averaged."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


def corr(x: str, y: str) -> Column:
    """Pearson correlation of a group's rows; null where either doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
