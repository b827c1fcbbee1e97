"""Forward labels that only use bars one could have traded on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.functions.factors import W
from asofly.operators.timeblocks import in_blocks


def open_to_open(bars: DataFrame, *, holding_bars: int, bar_hours: int = 1, least_volume: float = 0.0) -> DataFrame:
    """Log return from the next bar's open to the open holding_bars later; label and reason.

    Every step on the path must be one bar long, and every bar on it must have positive prices and volumes. Running counts
    of gaps and of bad bars make a path clean where the counts don't rise, so there's no loop over the path; only differences within a path count, so a chunk's own counts do.
    """
    end = 1 + holding_bars
    good = (F.col("open") > 0) & (F.col("volume") > least_volume) & (F.col("quote_volume") > 0)
    gap = F.expr("timestampdiff(SECOND, lag(event_time) over (partition by asset order by event_time), event_time)") != bar_hours * 3600

    def windows(f: DataFrame) -> DataFrame:
        f = f.withColumn("_bad", F.when(good, 0).otherwise(1)).withColumn("_gap", F.when(gap, 1).otherwise(0))
        f = f.withColumn("_nb", F.sum("_bad").over(W())).withColumn("_ng", F.sum("_gap").over(W()))
        gaps, bads = F.lead("_ng", end).over(W()) - F.col("_ng"), F.lead("_nb", end).over(W()) - F.col("_nb")
        label = F.when((gaps == 0) & (bads == 0), F.ln(F.lead("open", end).over(W()) / F.lead("open", 1).over(W())))
        reason = F.when(gaps.isNull() | (gaps > 0), "MISSING_NEXT_BAR").when(bads > 0, "EXECUTION_BAR_INVALID").otherwise("")
        return f.withColumn("label", label).withColumn("reason", reason)

    return in_blocks(bars, windows, before=1, after=end).drop("_bad", "_gap", "_nb", "_ng")
