"""Factor evaluation: information coefficients and what is inferred from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofly.functions.factors import average_rank, corr
from asofly.operators.prefix import prefix_quantiles
from asofly.operators.timeblocks import in_blocks


def ranked(frame: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rows with both values, and the tie-averaged ranks of each within its group."""
    ok = frame.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    return ok.withColumn("_rx", average_rank(x, by)).withColumn("_ry", average_rank(y, by))


def information_coefficients(frame: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """n, Pearson (ic) and Spearman (rank_ic) correlation of a factor with a label per group."""
    return ranked(frame, x, y, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), corr(x, y).alias("ic"), corr("_rx", "_ry").alias("rank_ic"))


def fold_limits(rows: DataFrame, x: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """asset, fold, lo, hi: the quantiles of a factor over each fold's own training rows, which bound its test rows.

    rows: from inference.walk_forward. Training rows of a fold are a prefix of its asset's, so their counts are merged over
    the folds and no row is sent to more than one; a fold without a training value has no bounds.
    """
    train = rows.filter("train_from is not null").select("asset", F.col("train_from").alias("block"), F.col(x).alias("lo"), F.col(x).alias("hi"))
    last = rows.groupBy("asset").agg(F.max("last_fold").alias("last"))
    out = prefix_quantiles(train, last, {"lo": low, "hi": high}, key="asset", prefix="_")
    return out.select("asset", F.col("block").alias("fold"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))


def evaluate_factor(rows: DataFrame, x: str, y: str, *, by: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per group (asset, fold and more, as the regime) of test rows: n, coverage, turnover, Pearson and Spearman correlation
    of the factor, bounded by the quantiles of its fold's training rows.

    rows: from inference.walk_forward, written once, with event_time. Coverage is the share of a group's rows with factor and
    label, turnover the mean step between its consecutive values. Groups with fewer than two such rows are left out; a
    constant factor or label has no correlation.
    """
    tests = rows.filter("test_fold is not null").withColumn("fold", F.col("test_fold"))
    f = tests.join(fold_limits(rows, x, low, high), ["asset", "fold"]).withColumn("_f", F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("lo")), F.col("hi")))).drop("lo", "hi")
    total = f.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    r = ranked(f, "_f", y, by).withColumn("_slice", F.struct(*by))
    step = F.abs(F.col("_f") - F.lag("_f", 1).over(Window.partitionBy("_slice").orderBy("event_time")))
    r = in_blocks(r, lambda g: g.withColumn("_step", step), before=1, by="_slice")
    varies = lambda c: F.when((F.max("_f") > F.min("_f")) & (F.max(y) > F.min(y)), c)
    out = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("_step"), F.lit(0.0)).alias("turnover"), varies(corr("_f", y)).alias("ic"), varies(corr("_rx", "_ry")).alias("rank_ic")).filter("n >= 2")
    return out.join(total, by).withColumn("coverage", F.col("n") / F.col("_total")).drop("_total")
