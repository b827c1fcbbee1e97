"""Point-in-time predicates and record checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(t: str) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def as_known_at(frame: DataFrame, t: str) -> DataFrame:
    return frame.filter(F.col("available_time") <= moment(t))


def strictly_before(frame: DataFrame, t: str) -> DataFrame:
    """Events before t that were available by t."""
    return frame.filter((F.col("event_time") < moment(t)) & (F.col("available_time") <= moment(t)))


def evidence_cutoff(frame: DataFrame, t: str) -> tuple[DataFrame, DataFrame]:
    """Rows with both times by t; and per source how many are in and out, with the span of those out."""
    ok = (F.col("event_time") <= moment(t)) & (F.col("available_time") <= moment(t))
    out = frame.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    spans = [f(F.when(~F.col("_ok"), F.col(c))).alias(n) for f, c, n in ((F.min, "event_time", "first_event"), (F.max, "event_time", "last_event"), (F.min, "available_time", "first_available"), (F.max, "available_time", "last_available"))]
    counts = out.groupBy("source").agg(F.count_if("_ok").alias("eligible"), F.count_if(~F.col("_ok")).alias("excluded"), *spans)
    return frame.filter(ok), counts


def window(frame: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open development window; apply it before anything that looks across rows."""
    return frame.filter((F.col("event_time") >= moment(start)) & (F.col("event_time") < moment(end)))


def role(at: Column, a: str, b: str, c: str, d: str) -> Column:
    """development [a, b), buffer [b, c), holdout [c, d], else null."""
    return (
        F.when((at >= moment(a)) & (at < moment(b)), "development").when((at >= moment(b)) & (at < moment(c)), "buffer").when((at >= moment(c)) & (at <= moment(d)), "holdout")
    )


SHA256 = "^[0-9a-f]{64}$"


def violated(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The frame with the codes of the rules that each row breaks; a rule that's null isn't broken."""
    return frame.withColumn("violations", F.array_compact(F.array(*(F.when(rule, code) for code, rule in rules.items()))))


def zoneless(text: str) -> Column:
    """Whether a time written as text is missing, or names no zone."""
    return ~F.coalesce(F.col(text).rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))


def record_violations(frame: DataFrame) -> DataFrame:
    """Market records (asset, event_time, available_time, ingested_at as text with a zone, source): codes of what's wrong."""
    times = ("event_time", "available_time", "ingested_at")
    e, a, i = (F.col(c).try_cast("timestamp") for c in times)
    zone = zoneless(times[0]) | zoneless(times[1]) | zoneless(times[2])
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return violated(frame, {"TIME_WITHOUT_ZONE": zone, "AVAILABLE_BEFORE_EVENT": a < e, "INGESTED_BEFORE_AVAILABLE": i < a, "ASSET_BLANK": blank("asset"), "SOURCE_BLANK": blank("source")})


def manifest_violations(frame: DataFrame) -> DataFrame:
    """Manifests (snapshot_id, content_sha256, row_count, min/max of event and available time, parents): codes of what's wrong."""
    return violated(frame, {
        "HASH_FORMAT": ~F.coalesce(F.col("content_sha256").rlike(SHA256), F.lit(False)), "ROW_COUNT_NEGATIVE": F.col("row_count") < 0, "EVENT_RANGE": F.col("min_event_time") > F.col("max_event_time"),
        "AVAILABLE_RANGE": F.col("min_available_time") > F.col("max_available_time"), "OWN_PARENT": F.array_contains("parents", F.col("snapshot_id")),
    })


def signal_violations(frame: DataFrame) -> DataFrame:
    """Signals (value, confidence, available_time, decision_time): codes of what's wrong."""
    outside = lambda c, low, high: ~F.coalesce(F.col(c).between(low, high), F.lit(False))
    return violated(frame, {"VALUE_RANGE": outside("value", -1.0, 1.0), "CONFIDENCE_RANGE": outside("confidence", 0.0, 1.0), "NOT_AVAILABLE_AT_DECISION": F.col("available_time") > F.col("decision_time")})


def frame_violations(frame: DataFrame, *, least_volume: float = 0.0) -> DataFrame:
    """One row: how many rows break each rule of a factor frame."""
    keys = frame.groupBy("asset", "event_time").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_keys"))
    counts = frame.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("event_time").isNull() | F.col("available_time").isNull()).alias("bad_times"),
        F.count_if(F.col("available_time") < F.col("event_time")).alias("not_causal"), F.count_if(~(F.col("close") > 0)).alias("bad_close"), F.count_if(F.col("volume") < least_volume).alias("bad_volume"),
    )
    return counts.crossJoin(keys)  # one row each


def causal_sources(plan: DataFrame, unavailable: DataFrame, t: str) -> DataFrame:
    """Planned objects that aren't known to be missing for good and are closed by t."""
    return plan.join(unavailable.select("identity").distinct(), "identity", "left_anti").filter(F.col("available_time") <= moment(t))


def period_membership(frame: DataFrame) -> DataFrame:
    """Per source (identity, period_start, period_end): rows in its period, left-closed or right-closed, and which holds.

    A source is left-closed [start, end) unless (start, end + 1 s] keeps more of its rows, as with daily metrics that are
    stamped at the end of their interval.
    """
    at = F.col("event_time")
    left = (at >= F.col("period_start")) & (at < F.col("period_end"))
    right = (at > F.col("period_start")) & (at <= F.col("period_end") + F.expr("interval 1 second"))
    g = frame.groupBy("identity", "period_start", "period_end").agg(F.count_if(left).alias("left_closed"), F.count_if(right).alias("right_closed"), F.count(F.lit(1)).alias("n_rows"))
    g = g.withColumn("membership", F.when(F.col("right_closed") > F.col("left_closed"), "right").otherwise("left"))
    return g.withColumn("kept", F.greatest("left_closed", "right_closed")).withColumn("outside", F.col("n_rows") - F.col("kept"))
