"""Scalar rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECIMAL = "decimal(38,18)"


def finite(x: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def one_way_cost(notional: Column, fee_bps: float, slip_bps: float) -> Column:
    return notional * (fee_bps + slip_bps) / 10000


def confidence_step(p: Column) -> Column:
    """Share of capital by confidence: 1 from 0.80 on, 0.70 from 0.65, 0.40 from 0.50, else 0."""
    return F.when(p >= 0.80, 1.0).when(p >= 0.65, 0.70).when(p >= 0.50, 0.40).otherwise(0.0)


def cycle_multiplier(label: Column, p: Column) -> Column:
    """As confidence_step, but full size for a bull label only, and nothing at risk or without evidence."""
    return F.when(label.isin("risk_off", "insufficient_evidence"), 0.0).when((p >= 0.80) & (label != "bull"), 0.70).otherwise(confidence_step(p))


def split_cap(frame: DataFrame, weight: str, by: list[str], order: str, *, capital: float) -> DataFrame:
    """cap, allocation and reason: capital by the group's label and confidence, shared by positive weights.

    The last asset of the order takes what's left. Nothing is allocated at risk, without evidence or below the least
    confidence, or without a positive weight. Needs label and confidence.
    """
    w = Window.partitionBy(*by)
    out = frame.withColumn("_w", F.when(F.col(weight) > 0, F.col(weight))).withColumn("_total", F.sum("_w").over(w))
    closed, cap = F.col("label").isin("risk_off", "insufficient_evidence"), capital * confidence_step(F.col("confidence"))
    reason = F.when(closed, F.concat(F.upper("label"), F.lit("_NO_NEW_EXPOSURE"))).when((cap <= 0) | F.col("_total").isNull(), "CONFIDENCE_OR_SIGNAL_BELOW_THRESHOLD").otherwise("CONFIDENCE_WEIGHTED_SHARED_CAP")
    out = out.withColumn("reason", reason).withColumn("cap", F.when(F.col("reason") == "CONFIDENCE_WEIGHTED_SHARED_CAP", cap).otherwise(0.0))
    share = F.try_divide(F.col("cap") * F.col("_w"), F.col("_total"))
    out = out.withColumn("_s", share).withColumn("_last", F.row_number().over(w.orderBy(F.col("_w").isNull(), F.desc(order))) == 1)
    rest = F.col("cap") - (F.sum("_s").over(w) - F.col("_s"))
    return out.withColumn("allocation", F.coalesce(F.when(F.col("_last"), rest).otherwise(F.col("_s")), F.lit(0.0))).drop("_w", "_total", "_s", "_last")


#: The account's risk for one position, for each of two, and the most it may hold.
SINGLE_RISK, PAIR_RISK, GROSS = 10.0, 5.0, 90.0


def order_size(frame: DataFrame, *, step: float, least_quantity: float, least_notional: float) -> DataFrame:
    """quantity, notional, stop_risk and gross_remaining of an order in exact decimals, or the reason why there's none.

    Needs entry, stop, ref_price, open_risks and open_notionals (arrays). The first position may risk SINGLE_RISK, another
    one PAIR_RISK or what the open ones leave of SINGLE_RISK; the notional follows from the distance to the stop, is capped by
    what's left of GROSS, and the quantity is floored to the step.
    """
    d = lambda x: x.cast("decimal(20,8)")
    lit = lambda x: F.lit(str(x)).cast("decimal(20,8)")
    wide = lambda x: x.cast(DECIMAL)
    total = lambda c: F.aggregate(c, F.lit("0").cast(DECIMAL), lambda a, x: (a + d(x)).cast(DECIMAL))
    entry, ref, distance = d(F.col("entry")), d(F.col("ref_price")), F.abs(d(F.col("entry")) - d(F.col("stop")))
    used, gross = total("open_risks"), total("open_notionals")
    budget = F.when(F.size("open_risks") == 0, wide(lit(SINGLE_RISK))).otherwise(F.greatest(F.least(wide(lit(PAIR_RISK)), wide(lit(SINGLE_RISK) - used)), wide(lit(0))))
    left = wide(lit(GROSS) - gross)
    by_risk = wide(F.try_divide(wide(budget * entry), wide(distance)))
    units = F.floor(F.try_divide(wide(F.try_divide(F.least(by_risk, left), ref)), lit(step)))
    quantity = wide(units.cast("decimal(20,0)") * lit(step))
    notional = wide(quantity * ref)
    small = F.coalesce((quantity < lit(least_quantity)) | (notional < lit(least_notional)), F.lit(True))
    reason = (
        F.when(~F.coalesce(distance > 0, F.lit(False)), "INVALID_STOP_DISTANCE").when(~F.coalesce(ref > 0, F.lit(False)), "INVALID_REF_PRICE").when(budget <= 0, "RISK_BUDGET_EXHAUSTED")
        .when(left <= 0, "GROSS_CAPACITY_EXHAUSTED").when(small, "MIN_NOTIONAL_OR_STEP_CONFLICT")
    )
    out = frame.withColumn("reason", reason)
    given = lambda x: F.when(F.col("reason").isNull(), x).cast("double")
    risk = wide(F.try_divide(wide(notional * distance), entry))
    return out.withColumns({"quantity": given(quantity), "notional": given(notional), "stop_risk": given(risk), "gross_remaining": given(left - notional)})


def identity_key(*parts: str) -> Column:
    return F.concat_ws("|", *parts)


def identity_parts(key: Column, names: list[str]) -> list[Column]:
    return [F.split(key, r"\|")[i].alias(n) for i, n in enumerate(names)]


def granularity(period: Column) -> Column:
    return F.when(period.rlike(r"^\d{4}-\d{2}$"), "month").when(period.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").otherwise("unknown")


def failure_class(status: Column, code: Column, period: Column, cutoff: str) -> Column:
    """What a failed acquisition means; a missing object of the last two months is a tail not published yet."""
    tail = period >= F.add_months(F.date_trunc("month", F.lit(cutoff).cast("date")), -1).cast("date")
    return F.when(status == "ok", "NONE").when((code == 404) & tail, "TAIL_NOT_PUBLISHED").when(code == 404, "MISSING_AT_SOURCE").when(code >= 500, "RETRY").otherwise("FAILED")


def period_end(period: Column, kind: Column) -> Column:
    """First moment after a period, as a date."""
    return F.when(kind == "month", F.add_months(period, 1)).otherwise(F.date_add(period, 1))


def expected_bars(start: Column, end: Column, step_seconds: int) -> Column:
    return F.floor((F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) / step_seconds)


LEVELS = ("exploratory", "research", "candidate", "production")


def risk_ceiling(risks: Column) -> Column:
    """Highest promotion level that the worst revision risk among inputs allows."""
    return F.when(F.array_contains(risks, "high"), "exploratory").when(F.array_contains(risks, "unknown"), "research").when(F.array_contains(risks, "low"), "candidate").otherwise("production")


def canonical_digest(columns: list[str]) -> Column:
    """sha256 of a row's canonical JSON, its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def slot_checks(at: Column, now: Column) -> list[Column]:
    """Whether a time is on the four-hour grid, the next UTC midnight, and its age in seconds."""
    return [((F.hour(at) % 4 == 0) & (F.minute(at) == 0)).alias("aligned"), (F.date_trunc("day", at) + F.expr("interval 1 day")).cast("timestamp_ntz").alias("next_midnight"), (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))).alias("age")]


def rank_weight(rank: Column) -> Column:
    return F.greatest(F.lit(0), 13 - rank)


def scenarios(spark) -> DataFrame:
    """Cost and stress scenarios: fixed values, name, fee and slippage in basis points, delay in bars."""
    return spark.createDataFrame(
        [("base", 4.0, 5.0, 0), ("fee_x2", 8.0, 5.0, 0), ("slip_x2", 4.0, 10.0, 0), ("stress", 8.0, 10.0, 0), ("delay_1", 4.0, 5.0, 1), ("delay_2", 4.0, 5.0, 2), ("free", 0.0, 0.0, 0), ("stress_delay", 8.0, 10.0, 1)],
        "scenario string, fee_bps double, slip_bps double, delay int",
    )


#: Fixed values of the audit: fields that must be there, order of known times, inputs with a publication delay, words of results.
FIELDS = {"signal_time": "MISSING_SIGNAL_TIME", "decision_time": "MISSING_DECISION_TIME", "entry_price": "MISSING_ENTRY_PRICE_RULE", "holding_rule": "MISSING_HOLDING_RULE", "exit_rule": "MISSING_EXIT_RULE", "missing_policy": "MISSING_MISSING_POLICY"}
TIME_ORDER = {
    "event_time": 0, "open_time": 10, "bar_open": 10, "funding_time": 20, "oi_time": 20, "close_time": 30, "bar_close": 30, "available_time": 30, "funding_available_time": 30, "oi_available_time": 30, "decision_time": 30,
    "next_continuous_bar_open": 40,
}
RESULT_WORDS = ("alpha", "auc", "drawdown", "hit_rate", "ic", "pnl", "precision", "recall", "return", "returns", "sharpe", "win_rate")
BLOCKING = ("AVAILABLE_TIME_AFTER_DECISION_TIME", "MISSING_AVAILABLE_TIME_DEFINITION", "UNKNOWN_AVAILABLE_TIME_ORDER", "SIGNAL_NOT_CLOSED_BAR")
DEFERRING = ("FORBIDDEN_FACTOR_OVERLAP",)


def names_result(text: Column) -> Column:
    """Whether a text names an empirical result; the parts of a word may be apart."""
    words = "|".join(w.replace("_", r"[\s_]*") for w in RESULT_WORDS)
    return F.lower(text).rlike(rf"(?<![a-z0-9])(?:{words})(?![a-z0-9])")


def audit(proposals: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Static reasons and verdict (PASS, BLOCKED, DEFERRED, REJECTED) of each proposal.

    proposals: factor_id, research_family, formula, required_columns (an array), available_time_definition and the FIELDS, all
    text. forbidden, a short list: factor_id, research_family, channels and wrappers (arrays): a proposal overlaps if it has
    its name, names a wrapper, or reads one of its channels within its family.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    columns = F.filter(F.transform(F.coalesce("required_columns", F.expr("cast(array() as array<string>)")), F.trim), lambda c: c != "")
    order = F.create_map(*(F.lit(x) for kv in TIME_ORDER.items() for x in kv))
    known, decided = F.lower(text("available_time_definition")), F.lower(text("decision_time"))
    a, b = F.try_element_at(order, known), F.try_element_at(order, decided)
    timing = F.when(known == "", "MISSING_AVAILABLE_TIME_DEFINITION").when(decided == "", "UNKNOWN_AVAILABLE_TIME_ORDER").when(known == decided, None).when(a.isNull() | b.isNull(), "UNKNOWN_AVAILABLE_TIME_ORDER").when(a > b, "AVAILABLE_TIME_AFTER_DECISION_TIME")
    said = F.concat_ws(" \n ", "formula", "research_family", "factor_id", F.array_join(columns, " \n "), *FIELDS)
    f = forbidden.select(F.collect_list(F.struct(flat(F.col("factor_id")).alias("id"), flat(F.col("research_family")).alias("family"), F.transform("channels", flat).alias("channels"), F.transform("wrappers", flat).alias("wrappers"))).alias("_forbidden"))
    out = proposals.crossJoin(F.broadcast(f)).withColumns({"_f": flat(F.col("formula")), "_id": flat(F.col("factor_id")), "_fam": flat(F.col("research_family")), "_cols": F.transform(columns, flat)})
    overlap = F.exists("_forbidden", lambda x: (x["id"] == F.col("_id")) | F.exists(x["wrappers"], lambda p: F.contains(F.col("_f"), p) | F.contains(F.col("_id"), p)) | ((x["family"] == F.col("_fam")) & F.exists(x["channels"], lambda p: F.contains(F.col("_f"), p) | F.array_contains("_cols", p))))
    codes = [
        F.when(F.size(columns) == 0, "MISSING_REQUIRED_COLUMNS"), *(F.when(text(c) == "", code) for c, code in FIELDS.items()), F.when(~F.array_contains(columns, "available_time"), "MISSING_AVAILABLE_TIME_COLUMN"), timing,
        F.when(text("entry_price") != "next_continuous_bar_open", "INVALID_NEXT_CONTINUOUS_BAR_OPEN"), F.when(~F.lower(text("signal_time")).isin("close_time", "bar_close"), "SIGNAL_NOT_CLOSED_BAR"),
        F.when(names_result(said), "EMPIRICAL_METRIC_PRESENT"), F.when(overlap, "FORBIDDEN_FACTOR_OVERLAP"),
    ]
    out = out.withColumn("reasons", F.array_distinct(F.array_compact(F.array(*codes)))).drop("_f", "_id", "_fam", "_cols", "_forbidden")
    some = lambda these: F.exists("reasons", lambda r: r.isin(*these))
    rejecting = F.exists("reasons", lambda r: ~r.isin(*BLOCKING, *DEFERRING, "INVALID_NEXT_CONTINUOUS_BAR_OPEN"))
    verdict = F.when(F.size("reasons") == 0, "PASS").when(some(BLOCKING), "BLOCKED").when(rejecting, "REJECTED").when(some(DEFERRING), "DEFERRED").otherwise("REJECTED")
    return out.withColumn("verdict", verdict)
