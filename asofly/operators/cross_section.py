"""Robust z-scores among the assets of one moment, with the reason where there's none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.operators.asof import asof_funding

SCALE, CLIP = 1.4826, 5.0


def robust_z(frame: DataFrame, x: Column, ok: Column, reasons: Column, zero_mad: str, empty: str | None, least: int = 2) -> DataFrame:
    """value: (x - median) / (1.4826 MAD) clipped at 5 among the valid rows of one available_time; reason where it's null.

    `reasons` explains rows that aren't valid. Fewer than `least` valid peers or a MAD of zero give null, never 0.
    """
    w = Window.partitionBy("available_time")
    out = frame.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_x", F.when(F.col("_ok"), x))
    out = out.withColumn("_med", F.median("_x").over(w)).withColumn("_n", F.count("_x").over(w))
    out = out.withColumn("_mad", F.median(F.abs(F.col("_x") - F.col("_med"))).over(w))
    z = F.least(F.greatest((F.col("_x") - F.col("_med")) / (SCALE * F.col("_mad")), F.lit(-CLIP)), F.lit(CLIP))
    reason = F.coalesce(reasons, F.when(F.col("_n") < least, "INSUFFICIENT_PEER_COVERAGE").when(F.col("_mad") == 0, zero_mad), F.lit(empty))
    value = F.when(F.col("_ok") & (F.col("_n") >= least) & (F.col("_mad") > 0), z)
    return out.withColumn("value", value).withColumn("reason", reason).drop("_ok", "_x", "_med", "_n", "_mad")


def relative_pressure(frame: DataFrame, *, default_hours: int = 8) -> DataFrame:
    """relative_funding_pressure of a frame that has funding_rate and funding_available_time (and funding_interval_hours)
    already, and its exclusion reason: rates older than their interval don't count."""
    hours = F.coalesce("funding_interval_hours", F.lit(default_hours)) if "funding_interval_hours" in frame.columns else F.lit(default_hours)
    fresh = F.expr("timestampdiff(SECOND, funding_available_time, available_time)") <= hours * 3600
    ok = F.col("funding_rate").isNotNull() & F.coalesce(fresh, F.lit(False))
    out = robust_z(frame, F.col("funding_rate"), ok, F.when(~ok, "FUNDING_UNAVAILABLE_OR_GAPPED"), "ZERO_CROSS_SECTIONAL_MAD", None)
    return out.withColumnRenamed("value", "relative_funding_pressure").withColumnRenamed("reason", "relative_funding_pressure_exclusion_reason")


def funding_pressure(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """Relative funding pressure: fresh funding rates against those of the other assets."""
    j = asof_funding(bars, funding)
    ok = F.col("funding_rate").isNotNull()
    return robust_z(j, F.col("funding_rate"), ok, F.when(~ok, "FUNDING_UNAVAILABLE_OR_GAPPED"), "ZERO_CROSS_SECTIONAL_MAD", None)


def taker_imbalance(bars: DataFrame) -> DataFrame:
    """Share of taker buying against that of the other assets."""
    ratio = F.try_divide(F.col("taker_buy_base"), F.col("volume"))
    ok = F.coalesce((F.col("volume") != 0) & ratio.between(0, 1), F.lit(False))
    reasons = F.when(F.col("volume") == 0, "TAKER_VOLUME_ZERO").when(F.col("taker_buy_base").isNull() | F.col("volume").isNull(), "TAKER_FIELD_MISSING").when(~ok, "TAKER_RATIO_INVALID")
    return robust_z(bars, ratio, ok, reasons, "ZERO_CROSS_SECTIONAL_MAD_TAKER", "")
