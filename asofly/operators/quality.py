"""Quality findings, coverage and audit counts: every check of a table in one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day() -> Column:
    return F.date_format("event_time", "yyyy-MM-dd").alias("period")


def seconds_since(column: str = "event_time") -> Column:
    return F.expr(f"timestampdiff(SECOND, lag({column}) over (partition by asset order by {column}), {column})")


def inspect_ohlcv(frame: DataFrame, *, step_hours: int) -> DataFrame:
    """A row per finding: asset, event_time, code."""
    marked = frame.withColumn("_gap", seconds_since())
    rules = [
        ("OHLC_RELATION", (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))),
        ("NEGATIVE_VOLUME", F.col("volume") < 0),
        ("TIME_GAP", F.col("_gap") > step_hours * 3600),
    ]
    codes = F.array_compact(F.array(*(F.when(rule, code) for code, rule in rules)))
    found = marked.select("asset", "event_time", F.explode(codes).alias("code"))
    double = frame.groupBy("asset", "event_time").count().filter("count > 1").select("asset", "event_time", F.lit("DUPLICATE_BAR").alias("code"))
    return found.unionByName(double)


#: Codes in the order in which they're given.
REASONS = ("TIME_INVALID", "CAUSALITY_INVALID", "CUTOFF_VIOLATION", "ASSET_INVALID", "SOURCE_PERIOD_MISMATCH", "DUPLICATE", "VALUE_INVALID", "INTERVAL_INVALID", "NEGATIVE_OI")


def source_reasons(frame: DataFrame, *, as_of: str, kind: str) -> DataFrame:
    """Reasons against each source object: identity, reasons. kind: ohlcv, funding or metrics.

    frame: identity, source_asset, period_start, period_end and the rows' own columns; expected_sha and content_sha, if
    there, must be equal. A source of the wrong columns has CANONICAL_SCHEMA_INVALID only.
    """
    need = {"ohlcv": ("open", "high", "low", "close", "volume"), "funding": ("funding_rate", "funding_interval_hours"), "metrics": ("sum_open_interest", "sum_open_interest_value")}[kind]
    if set(need) - set(frame.columns):
        return frame.groupBy("identity").agg(F.array(F.lit("CANONICAL_SCHEMA_INVALID")).alias("reasons"))
    e, a, cut = F.col("event_time"), F.col("available_time"), F.lit(as_of).cast("timestamp_ntz")
    last = e <= F.col("period_end") + F.expr("interval 1 second") if kind == "metrics" else e < F.col("period_end")
    if kind == "ohlcv":
        value = (F.least("open", "high", "low", "close") <= 0) | (F.col("volume") < 0) | (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    else:
        value = F.lit(False)
    interval = ~F.coalesce(F.col("funding_interval_hours").isin(1, 4, 8), F.lit(False)) if kind == "funding" else F.lit(False)
    negative = F.least("sum_open_interest", "sum_open_interest_value") < 0 if kind == "metrics" else F.lit(False)
    rules = dict(zip(REASONS, (e.isNull() | a.isNull(), a < e, (e > cut) | (a > cut), F.col("asset") != F.col("source_asset"), ~((e >= F.col("period_start")) & last), F.lit(None), value, interval, negative), strict=True))
    one = frame.groupBy("identity", "asset", "event_time").agg(
        F.count(F.lit(1)).alias("_n"), *(F.max(F.coalesce(rule.cast("boolean"), F.lit(False))).alias(code) for code, rule in rules.items()),
        *((F.max(F.col("expected_sha") != F.col("content_sha")).alias("CONTENT_HASH_MISMATCH"),) if {"expected_sha", "content_sha"} <= set(frame.columns) else (F.lit(False).alias("CONTENT_HASH_MISMATCH"),)),
    )
    one = one.withColumn("DUPLICATE", F.col("_n") > 1)
    out = one.groupBy("identity").agg(*(F.max(code).alias(code) for code in ("CONTENT_HASH_MISMATCH", *REASONS)))
    out = out.withColumn("CAUSALITY_INVALID", F.col("CAUSALITY_INVALID") & ~F.col("TIME_INVALID"))
    return out.select("identity", F.array_compact(F.array(*(F.when(F.col(code), f"CANONICAL_{code}") for code in ("CONTENT_HASH_MISMATCH", *REASONS)))).alias("reasons"))


def coverage(frame: DataFrame, *, expected: int, threshold: float, warn: Column) -> DataFrame:
    """Observed rows of each asset and day against the expected number; short days block, or warn where `warn` holds."""
    out = frame.groupBy("asset", day()).agg(F.count(F.lit(1)).alias("observed")).withColumn("coverage", F.col("observed") / expected)
    return out.withColumn("status", F.when(F.col("coverage") >= threshold, "PASSED").when(warn, "EXCLUDED").otherwise("BLOCKING"))


def inspect_funding(frame: DataFrame) -> DataFrame:
    """Per asset and day: duplicates, rows known before their event, odd intervals and coverage by the first interval."""
    first = F.min_by("funding_interval_hours", "event_time")
    out = frame.groupBy("asset", day()).agg(
        F.count(F.lit(1)).alias("observed"), (F.count(F.lit(1)) - F.countDistinct("event_time")).alias("duplicates"), F.count_if(F.col("available_time") < F.col("event_time")).alias("not_causal"),
        F.count_if(~F.col("funding_interval_hours").isin(1, 4, 8)).alias("bad_interval"), F.ceil(24.0 / first).cast("long").alias("expected"), F.countDistinct("event_time").alias("_n"),
    )
    return out.withColumn("coverage", F.least(F.col("_n") / F.col("expected"), F.lit(1.0))).drop("_n")


def inspect_metrics(frame: DataFrame, *, least: float = 0.0, per_day: int = 288) -> DataFrame:
    """Per asset and day: values under `least`, duplicates, rows known before their event, coverage of the cadence."""
    return frame.groupBy("asset", day()).agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(F.col("open_interest") < least).alias("low_values"), (F.count(F.lit(1)) - F.countDistinct("event_time")).alias("duplicates"),
        F.count_if(F.col("available_time") < F.col("event_time")).alias("not_causal"), (F.countDistinct("event_time") / per_day).alias("coverage"),
    )


def source_report(frame: DataFrame, *, step_hours: int, as_of: str) -> DataFrame:
    """Bounds, counts, invalid values, gaps of more than two bars and rows outside the period, per asset and day (`period`).

    As many rows are expected as bars of the day had closed by as_of. `_gap`, if there, holds the seconds since the bar before.
    """
    good = (F.col("open") > 0) & (F.col("close") > 0) & (F.col("volume") >= 0)
    marked = frame if "_gap" in frame.columns else frame.withColumn("_gap", seconds_since())
    closed = F.floor(F.expr(f"timestampdiff(SECOND, period, timestamp_ntz'{as_of}')") / (step_hours * 3600))
    inside = (F.col("event_time") >= F.col("period")) & (F.col("event_time") < F.col("period") + F.expr("interval 1 day"))
    out = marked.groupBy("asset", "period").agg(
        F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"), F.count(F.lit(1)).alias("observed"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("invalid"), F.count_if(F.col("_gap") > 2 * step_hours * 3600).alias("wide_gaps"), F.count_if(~inside).alias("outside_period"),
    )
    return out.withColumn("expected", F.greatest(F.lit(0), F.least(F.lit(24 // step_hours), closed)).cast("long"))


def daily_funding(frame: DataFrame, *, assets: int) -> DataFrame:
    """Per UTC day of availability: last time, assets seen, share of positive rates, median rate, coverage of the assets, and
    a digest of the sources (source_sha256 of the rows, if there)."""
    sources = F.sha2(F.array_join(F.array_sort(F.collect_set("source_sha256")), ","), 256) if "source_sha256" in frame.columns else F.lit(None).cast("string")  # a day's files
    return frame.groupBy(F.date_format("available_time", "yyyy-MM-dd").alias("day")).agg(
        F.max("available_time").alias("last_time"), F.countDistinct("asset").alias("assets"), F.avg(F.when(F.col("funding_rate") > 0, 1.0).otherwise(0.0)).alias("share_positive"),
        F.median("funding_rate").alias("median_rate"), (F.countDistinct("asset") / assets).alias("coverage"), sources.alias("source_sha256"),
    )


def reason_counts(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(F.coalesce(column, F.lit("OK")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def protocol_statistics(runs: DataFrame) -> DataFrame:
    """Runs and passes per protocol; the holdout counts out-of-sample segments only."""
    return runs.groupBy("protocol").agg(F.count(F.lit(1)).alias("runs"), F.count_if("passed").alias("passed"), F.count_if(F.col("passed") & F.col("out_of_sample")).alias("holdout_passed"))


def concentration(frame: DataFrame, category: str, by: list[str]) -> DataFrame:
    """Largest share of a category within each group, and which it is."""
    n = frame.groupBy(*by, category).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg((F.max("_n") / F.sum("_n")).alias("max_share"), F.max_by(category, F.struct("_n", category)).alias("largest"))


def status_matrix(cover: DataFrame, datasets: list[str]) -> DataFrame:
    """Worst status of each asset and dataset: blocked, excluded, passed, or unavailable where there's none."""
    sev = F.when(F.col("status") == "BLOCKING", 3).when(F.col("status") == "EXCLUDED", 2).otherwise(1)
    wide = cover.withColumn("_s", sev).groupBy("asset").pivot("dataset", datasets).agg(F.max("_s"))
    name = lambda c: F.when(F.col(c) == 3, "BLOCKED").when(F.col(c) == 2, "EXCLUDED").when(F.col(c) == 1, "PASSED").otherwise("UNAVAILABLE")
    return wide.select("asset", *(name(c).alias(c) for c in datasets))


def partial_impact(partial: DataFrame, members: DataFrame) -> DataFrame:
    """Per asset: periods that are partly missing, and selections that they touch."""
    m = members.select("asset", F.col("selection_time").alias("period"), "selection_time")
    return partial.join(m, ["asset", "period"], "left").groupBy("asset").agg(F.countDistinct("period").alias("periods"), F.countDistinct("selection_time").alias("affected_days"))


def verdict_counts(frame: DataFrame, by: list[str], identity: Column) -> DataFrame:
    return frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct(identity)).alias("duplicates"))
