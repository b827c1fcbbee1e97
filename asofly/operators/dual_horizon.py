"""The fixed factor frame at either horizon, with lookbacks of equal clock length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.functions import factors as fx
from asofly.operators.cross_section import relative_pressure
from asofly.operators.timeblocks import in_blocks

#: Rows looked back for momentum, reversal, volatility, volume and the derivatives.
LOOKBACK = {"4h": (24, 12, 24, 24), "1h": (96, 48, 96, 96)}


def factor_frame(snapshot: DataFrame, interval: str) -> DataFrame:
    """Nine factors: momentum, reversal, volatility, volume surprise, illiquidity, funding z-score (from one value on), relative
    funding pressure (with the reason where there's none), open-interest change and crowding (not clipped).

    All windows within an asset share one exchange and sort by chunk, the pressure needs one by time.
    """
    m, r, v, o = LOOKBACK[interval]

    def windows(f: DataFrame) -> DataFrame:
        f = f.withColumn("_lr", fx.log_return("close")).withColumn("_il", F.abs("_lr") / F.nullif(F.col("close") * F.col("volume"), F.lit(0.0)))
        return f.withColumns({
            "funding_zscore": fx.zscore("funding_rate", m, least=1), "oi_change": fx.change("open_interest", m), "momentum": fx.momentum("close", m), "reversal": fx.reversal("close", r), "volatility": fx.realized_volatility("_lr", v),
            "volume_surprise": fx.zscore("volume", o), "illiquidity": fx.amihud("_il", o),
        })

    out = in_blocks(relative_pressure(snapshot), windows, before=max(m, r, v, o))
    return out.withColumn("crowding", fx.crowding("funding_zscore", "oi_change", clipped=False)).drop("_lr", "_il")
