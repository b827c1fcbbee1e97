"""Scalars, inference, gates and composed runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from asofly.functions import factors as fx
from asofly.functions import scalars as sc
from asofly.functions.expressions import Node, evaluate, safe_ratio
from asofly.operators import bootstrap, strategy
from asofly.operators import inference as inf
from asofly.operators.evaluation import information_coefficients
from asofly.operators.timeblocks import in_blocks
from asofly.plans.shared import stash
from asofly.queries.base import add, r8, rq, ts, tsq, with_
from asofly.queries.core import PEERS
from asofly.sources import tables as t

FXY = """f AS (SELECT asset, event_time, close / nullif(lag(close, 24) OVER w, 0) - 1 AS x, ln(lead(close, 1) OVER w / nullif(close, 0)) AS y FROM {0} WINDOW w AS (PARTITION BY asset ORDER BY event_time))"""


def rank_sql(c, by):
    p = f"PARTITION BY {by} " if by else ""
    q = f"PARTITION BY {by}, {c}" if by else f"PARTITION BY {c}"
    return f"rank() OVER ({p}ORDER BY {c}) + (count(*) OVER ({q}) - 1) / 2"


def _returns(spark, d, name):
    return in_blocks(t.bars(spark, d), lambda f: f.withColumn(name, fx.change("close", 1)), before=1)


def _xy(frame):
    return in_blocks(frame, lambda f: f.withColumns({"x": fx.momentum("close", 24), "y": fx.forward_log_return("close", 1)}), before=24, after=1)


@add("D16_cross_section_ic", with_("wide", more="f AS (SELECT asset, event_time, close / nullif(lag(close, 6) OVER w, 0) - 1 AS x, ln(lead(close) OVER w / nullif(close, 0)) AS y FROM wide WINDOW w AS (PARTITION BY asset ORDER BY event_time)), k AS (SELECT *, " + rank_sql("x", "event_time") + " AS rx, " + rank_sql("y", "event_time") + " AS ry FROM f WHERE x IS NOT NULL AND y IS NOT NULL), i AS (SELECT event_time, corr(rx, ry) AS ic FROM k GROUP BY event_time HAVING count(*) >= 3)") + "SELECT round(m, 8) AS mean_ic, round(s, 8) AS std_ic, n, round(t, 6) AS t, CASE WHEN x < 2 THEN round(1 - exp(-x * x) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(greatest(x, 1e-12)) - lgamma(k + 1.5)))), 6) ELSE exp(-x * x) / sqrt(pi()) / list_reduce([x] || list_transform(range(80, 0, -1), lambda n: n / 2.0), lambda f, h: x + h / f) END AS p FROM (SELECT *, abs(t) / sqrt(2) AS x FROM (SELECT avg(ic) AS m, stddev_samp(ic) AS s, count(*) AS n, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t FROM i WHERE ic IS NOT NULL AND NOT isnan(ic)))")
def d16(spark, d):
    frame = in_blocks(t.wide_bars(spark, d), lambda f: f.withColumns({"x": fx.momentum("close", 6), "y": fx.forward_log_return("close", 1)}), before=6, after=1)
    return inf.cross_section_ic(frame, "x", "y").select(r8("mean_ic"), r8("std_ic"), "n", F.round("t", 6).alias("t"), F.when(F.abs("t") < 2 * 2**0.5, F.round("p", 6)).otherwise(F.col("p")).alias("p"))


@add("E36_factor_direction", with_("b1", more=FXY.format("b1")) + "SELECT CAST(sign(median(r)) AS INTEGER) AS direction, round(median(r), 8) AS median_corr FROM (SELECT asset, corr(x, y) AS r FROM f WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY asset)")
def e36(spark, d):
    by = information_coefficients(_xy(t.bars(spark, d)), "x", "y", ["asset"])
    return by.agg(F.signum(F.median("ic")).cast("int").alias("direction"), r8(F.median("ic"), "median_corr"))


@add("H1_expression_tree", with_("b1", more="a AS (SELECT *, CASE WHEN count(close) OVER v = 12 THEN avg(close) OVER v END AS m, CASE WHEN count(volume) OVER v = 12 THEN stddev_samp(volume) OVER v END AS s, close - lag(close, 3) OVER w AS dl FROM b1 WINDOW w AS (PARTITION BY asset ORDER BY event_time), v AS (PARTITION BY asset ORDER BY event_time ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))") + f"SELECT asset, {tsq('event_time')}, round(CASE WHEN abs(s) >= 1e-12 THEN m / s END, 8) AS ratio, round(lag(dl, 2) OVER w, 8) AS nested, round(least(greatest(dl, -5), 5), 8) AS clipped FROM a WINDOW w AS (PARTITION BY asset ORDER BY event_time)")
def h1(spark, d):
    close, volume = Node.column("close"), Node.column("volume")
    trees = {"ratio": close.rolling_mean(12).ratio(volume.rolling_std(12)), "nested": close.delta(3).lag(2), "clipped": close.delta(3).clip(-5.0, 5.0)}
    return evaluate(t.bars(spark, d), trees).select("asset", ts("event_time"), r8("ratio"), r8("nested"), r8("clipped"))


@add("H2_safe_ratio", "SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_discount) >= 0.005 THEN l_tax / l_discount END, 8) AS ratio, least(greatest(l_quantity, 5), 40) AS clipped FROM lineitem")
def h2(spark, d):
    return t.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r8(safe_ratio(F.col("l_tax"), F.col("l_discount"), 0.005), "ratio"), sc.clip(F.col("l_quantity"), 5.0, 40.0).alias("clipped"))


@add("H3_winsorise", with_("hist", more="q AS (SELECT asset, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi FROM hist WHERE event_time < TIMESTAMP '1997-01-01' GROUP BY asset)") + f"SELECT h.asset, {tsq('event_time')}, round(least(greatest(close, lo), hi), 8) AS close FROM hist h JOIN q ON h.asset = q.asset")
def h3(spark, d):
    h = t.long_history(spark, d)
    q = h.filter("event_time < timestamp_ntz'1997-01-01'").groupBy("asset").agg(F.percentile("close", F.lit(0.01)).alias("lo"), F.percentile("close", F.lit(0.99)).alias("hi"))
    return h.join(q, "asset").select("asset", ts("event_time"), r8(F.least(F.greatest("close", "lo"), F.col("hi")), "close"))


@add("H4_costs", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 9 / 10000, 8) AS one_way, round(2 * l_extendedprice * 9 / 10000, 8) AS round_trip FROM lineitem")
def h4(spark, d):
    c = sc.one_way_cost(F.col("l_extendedprice"), 4.0, 5.0)
    return t.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r8(c, "one_way"), r8(2 * c, "round_trip"))


@add("H5_confidence_steps", "SELECT event_id, CASE WHEN p >= 0.80 THEN 1.0 WHEN p >= 0.65 THEN 0.70 WHEN p >= 0.50 THEN 0.40 ELSE 0.0 END AS cap, CASE WHEN l IN ('risk_off', 'insufficient_evidence') THEN 0.0 WHEN p >= 0.80 AND l <> 'bull' THEN 0.70 WHEN p >= 0.80 THEN 1.0 WHEN p >= 0.65 THEN 0.70 WHEN p >= 0.50 THEN 0.40 ELSE 0.0 END AS multiplier FROM (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS p, CASE event_id % 4 WHEN 0 THEN 'bull' WHEN 1 THEN 'neutral' WHEN 2 THEN 'risk_off' ELSE 'insufficient_evidence' END AS l FROM events)")
def h5(spark, d):
    p = F.col("event_id") % 100 / 100.0
    label = F.expr("case event_id % 4 when 0 then 'bull' when 1 then 'neutral' when 2 then 'risk_off' else 'insufficient_evidence' end")
    return t.read(spark, d, "events").select("event_id", sc.confidence_step(p).alias("cap"), sc.cycle_multiplier(label, p).alias("multiplier"))


CAP = """s AS (SELECT *, CASE extract('day' FROM event_time) % 4 WHEN 0 THEN 'risk_off' WHEN 1 THEN 'insufficient_evidence' WHEN 2 THEN 'neutral' ELSE 'bull' END AS label, (extract('day' FROM event_time) % 10) / 10.0 AS confidence, CASE WHEN trades % 3 = 0 THEN -volume ELSE volume END AS weight FROM b24),
 c AS (SELECT *, CASE WHEN confidence >= 0.80 THEN 100.0 WHEN confidence >= 0.65 THEN 70.0 WHEN confidence >= 0.50 THEN 40.0 ELSE 0.0 END AS cap0, sum(CASE WHEN weight > 0 THEN weight END) OVER (PARTITION BY event_time) AS total FROM s),
 r AS (SELECT *, CASE WHEN label IN ('risk_off', 'insufficient_evidence') THEN upper(label) || '_NO_NEW_EXPOSURE' WHEN cap0 <= 0 OR total IS NULL THEN 'CONFIDENCE_OR_SIGNAL_BELOW_THRESHOLD' ELSE 'CONFIDENCE_WEIGHTED_SHARED_CAP' END AS reason FROM c)"""


@add("H6_shared_cap", with_("b24", more=CAP) + f"SELECT {tsq('event_time')}, asset, reason, CASE WHEN reason = 'CONFIDENCE_WEIGHTED_SHARED_CAP' THEN cap0 ELSE 0 END AS cap, round(coalesce(CASE WHEN reason = 'CONFIDENCE_WEIGHTED_SHARED_CAP' AND weight > 0 THEN cap0 * weight / total END, 0), 6) AS allocation FROM r")
def h6(spark, d):
    day = F.dayofmonth("event_time")
    b = t.bars(spark, d, 24).withColumns({
        "label": F.when(day % 4 == 0, "risk_off").when(day % 4 == 1, "insufficient_evidence").when(day % 4 == 2, "neutral").otherwise("bull"), "confidence": (day % 10) / 10.0,
        "weight": F.when(F.col("trades") % 3 == 0, -F.col("volume")).otherwise(F.col("volume")),
    })
    out = sc.split_cap(b, "weight", ["event_time"], "asset", capital=100.0)
    return out.select(ts("event_time"), "asset", "reason", "cap", F.round("allocation", 6).alias("allocation"))


SIZE = """o AS (SELECT asset, event_time, round(close, 8) AS entry, round(low, 8) AS stop, CASE WHEN trades % 17 = 0 THEN 0.0 ELSE round(close, 8) END AS ref, CASE trades % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 4.0 WHEN 2 THEN 7.5 ELSE 10.0 END AS used, CASE trades % 4 WHEN 0 THEN 0 ELSE 1 END AS n_open, CASE WHEN trades % 5 = 0 THEN 90.0 WHEN trades % 4 = 0 THEN 0.0 ELSE 30.0 END AS gross FROM b1),
 q AS (SELECT *, abs(entry - stop) AS distance, CASE WHEN n_open = 0 THEN 10.0 ELSE greatest(least(5.0, 10.0 - used), 0) END AS budget, 90.0 - gross AS room FROM o),
 u AS (SELECT *, floor(least(budget * entry / nullif(distance, 0), room) / nullif(ref, 0) / 0.001 + 1e-9) * 0.001 AS qty FROM q),
 z AS (SELECT *, qty * ref AS notional, CASE WHEN NOT distance > 0 THEN 'INVALID_STOP_DISTANCE' WHEN NOT ref > 0 THEN 'INVALID_REF_PRICE' WHEN budget <= 0 THEN 'RISK_BUDGET_EXHAUSTED' WHEN room <= 0 THEN 'GROSS_CAPACITY_EXHAUSTED' WHEN coalesce(qty < 0.002 OR qty * ref < 5, true) THEN 'MIN_NOTIONAL_OR_STEP_CONFLICT' END AS reason FROM u)"""


@add("H7_order_size", with_("b1", more=SIZE) + f"SELECT asset, {tsq('event_time')}, reason, round(CASE WHEN reason IS NULL THEN qty END, 6) AS quantity, round(CASE WHEN reason IS NULL THEN notional END, 6) AS notional, round(CASE WHEN reason IS NULL THEN notional * distance / entry END, 6) AS stop_risk, round(CASE WHEN reason IS NULL THEN room - notional END, 6) AS gross_remaining FROM z")
def h7(spark, d):
    """Orders at every bar's close, with none or one position open, some of it without risk or room left."""
    four = F.col("trades") % 4
    risks = F.when(four == 0, F.expr("cast(array() as array<double>)")).when(four == 1, F.array(F.lit(4.0))).when(four == 2, F.array(F.lit(7.5))).otherwise(F.array(F.lit(10.0)))
    gross = F.when(F.col("trades") % 5 == 0, F.array(F.lit(90.0))).when(four == 0, F.expr("cast(array() as array<double>)")).otherwise(F.array(F.lit(30.0)))
    b = t.bars(spark, d).select("asset", "event_time", F.col("close").alias("entry"), F.col("low").alias("stop"), F.when(F.col("trades") % 17 == 0, 0.0).otherwise(F.col("close")).alias("ref_price"), risks.alias("open_risks"), gross.alias("open_notionals"))
    out = sc.order_size(b, step=0.001, least_quantity=0.002, least_notional=5.0)
    return out.select("asset", ts("event_time"), "reason", *(F.round(c, 6).alias(c) for c in ("quantity", "notional", "stop_risk", "gross_remaining")))


@add("H8_sigmoid", "SELECT event_id, round(1 / (1 + exp(-least(greatest(value / 10 - 4, -20), 20))), 8) AS s, round(least(greatest(value / 50, 0), 1), 8) AS c FROM events")
def h8(spark, d):
    from asofly.operators.regimes import clamp, sigmoid

    return t.read(spark, d, "events").select("event_id", r8(sigmoid(F.col("value") / 10 - 4), "s"), r8(clamp(F.col("value") / 50), "c"))


@add("H9_identity_keys", "SELECT k AS identity, split_part(k, '|', 2) AS asset, split_part(k, '|', 3) AS period, CASE WHEN regexp_matches(split_part(k, '|', 3), '^[0-9]{4}-[0-9]{2}$') THEN 'month' WHEN regexp_matches(split_part(k, '|', 3), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'day' ELSE 'unknown' END AS granularity FROM (SELECT DISTINCT 'bars|' || event_type || '|' || CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END AS k FROM events)")
def h9(spark, d):
    e = t.read(spark, d, "events").withColumn("p", F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM")).otherwise(F.date_format("ts", "yyyy-MM-dd"))).withColumn("n", F.lit("bars"))
    k = e.select(sc.identity_key("n", "event_type", "p").alias("identity")).distinct()
    return k.select("identity", *sc.identity_parts(F.col("identity"), ["dataset", "asset", "period"])).withColumn("granularity", sc.granularity(F.col("period"))).drop("dataset")


@add("H10_failure_class", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'NONE' WHEN o_custkey % 2 = 0 AND CAST(o_orderdate AS DATE) >= DATE '1998-06-01' THEN 'TAIL_NOT_PUBLISHED' WHEN o_custkey % 2 = 0 THEN 'MISSING_AT_SOURCE' WHEN o_custkey % 3 = 0 THEN 'RETRY' ELSE 'FAILED' END AS failure FROM orders")
def h10(spark, d):
    code = F.when(F.col("o_custkey") % 2 == 0, 404).when(F.col("o_custkey") % 3 == 0, 503).otherwise(403)
    status = F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed")
    return t.read(spark, d, "orders").select("o_orderkey", sc.failure_class(status, code, F.to_date("o_orderdate"), "1998-07-15").alias("failure"))


@add("H11_period_end", "SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_period, CAST(date_diff('second', date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) // 14400 AS BIGINT) AS bars_4h FROM orders")
def h11(spark, d):
    m = t.read(spark, d, "orders").select(F.date_trunc("month", F.col("o_orderdate")).cast("date").alias("m")).distinct().withColumn("e", sc.period_end(F.col("m"), F.lit("month")))
    return m.select(F.date_format("m", "yyyy-MM-dd").alias("period"), F.date_format("e", "yyyy-MM-dd").alias("next_period"), sc.expected_bars(F.col("m"), F.col("e"), 14400).alias("bars_4h"))


@add("H12_risk_ceiling", "SELECT o_custkey, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'exploratory' WHEN bool_or(o_orderpriority = '2-HIGH') THEN 'research' WHEN bool_or(o_orderpriority = '3-MEDIUM') THEN 'candidate' ELSE 'production' END AS ceiling FROM orders GROUP BY o_custkey")
def h12(spark, d):
    risk = F.create_map(F.lit("1-URGENT"), F.lit("high"), F.lit("2-HIGH"), F.lit("unknown"), F.lit("3-MEDIUM"), F.lit("low"))
    by = t.read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.try_element_at(risk, F.col("o_orderpriority"))).alias("risks"))
    return by.select("o_custkey", sc.risk_ceiling(F.col("risks")).alias("ceiling"))


@add("H13_canonical_digest", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS digest FROM customer""")
def h13(spark, d):
    return t.read(spark, d, "customer").select("c_custkey", sc.canonical_digest(["c_name", "c_custkey"]).alias("digest"))


@add("H14_non_finite_to_null", "SELECT event_id, CASE WHEN event_id % 10 < 2 THEN NULL ELSE value END AS value FROM events")
def h14(spark, d):
    v = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return t.read(spark, d, "events").select("event_id", sc.finite(v).alias("value"))


AUDIT = """p AS (SELECT *, CASE WHEN factor_id % 11 = 0 THEN '' ELSE 'close' END AS c1, CASE WHEN factor_id % 13 = 0 THEN '' ELSE 'available_time' END AS c2, CASE WHEN factor_id % 7 = 0 THEN 'open_time' ELSE 'bar_close' END AS signal_time, CASE WHEN factor_id % 5 = 0 THEN 'bar_open' ELSE 'bar_close' END AS decision_time,
  CASE WHEN factor_id % 17 = 0 THEN 'close' ELSE 'next_continuous_bar_open' END AS entry_price, CASE WHEN factor_id % 19 = 0 THEN ' ' ELSE 'one bar' END AS holding_rule, CASE WHEN factor_id % 23 = 0 THEN '' WHEN factor_id % 29 = 0 THEN 'next_day' ELSE 'close_time' END AS adef FROM props),
 x AS (SELECT *, lower(concat_ws(' ' || chr(10) || ' ', formula, research_family, factor_id::VARCHAR, concat_ws(' ' || chr(10) || ' ', nullif(c1, ''), nullif(c2, '')), signal_time, decision_time, entry_price, holding_rule, 'stop or time', 'preserve')) AS said, regexp_replace(lower(coalesce(formula, '')), '\\s+', '', 'g') AS ff FROM p),
 r AS (SELECT factor_id, [CASE WHEN c1 = '' AND c2 = '' THEN 'MISSING_REQUIRED_COLUMNS' END, CASE WHEN trim(holding_rule) = '' THEN 'MISSING_HOLDING_RULE' END, CASE WHEN c2 = '' THEN 'MISSING_AVAILABLE_TIME_COLUMN' END,
  CASE WHEN adef = '' THEN 'MISSING_AVAILABLE_TIME_DEFINITION' WHEN adef = 'next_day' THEN 'UNKNOWN_AVAILABLE_TIME_ORDER' WHEN decision_time = 'bar_open' THEN 'AVAILABLE_TIME_AFTER_DECISION_TIME' END, CASE WHEN entry_price <> 'next_continuous_bar_open' THEN 'INVALID_NEXT_CONTINUOUS_BAR_OPEN' END, CASE WHEN signal_time = 'open_time' THEN 'SIGNAL_NOT_CLOSED_BAR' END,
  CASE WHEN regexp_matches(said, '(?:^|[^a-z0-9])(?:alpha|auc|drawdown|hit[\\s_]*rate|ic|pnl|precision|recall|return|returns|sharpe|win[\\s_]*rate)(?:$|[^a-z0-9])') THEN 'EMPIRICAL_METRIC_PRESENT' END, CASE WHEN contains(ff, 'password') OR (research_family = 'src1' AND contains(ff, 'the')) THEN 'FORBIDDEN_FACTOR_OVERLAP' END] AS codes FROM x),
 z AS (SELECT factor_id, list_filter(codes, lambda c: c IS NOT NULL) AS codes FROM r)"""


@add("H15_proposal_audit", with_("props", more=AUDIT) + "SELECT factor_id, array_to_string(codes, ',') AS reasons, CASE WHEN len(codes) = 0 THEN 'PASS' WHEN list_has_any(codes, ['AVAILABLE_TIME_AFTER_DECISION_TIME', 'MISSING_AVAILABLE_TIME_DEFINITION', 'UNKNOWN_AVAILABLE_TIME_ORDER', 'SIGNAL_NOT_CLOSED_BAR']) THEN 'BLOCKED' WHEN list_has_any(codes, ['MISSING_REQUIRED_COLUMNS', 'MISSING_HOLDING_RULE', 'MISSING_AVAILABLE_TIME_COLUMN', 'EMPIRICAL_METRIC_PRESENT']) THEN 'REJECTED' WHEN list_contains(codes, 'FORBIDDEN_FACTOR_OVERLAP') THEN 'DEFERRED' ELSE 'REJECTED' END AS verdict FROM z")
def h15(spark, d):
    """Documents as proposals, with faults of every kind by their numbers."""
    n = F.col("factor_id")
    p = t.proposals(spark, d).withColumns({
        "required_columns": F.array(F.when(n % 11 == 0, "").otherwise("close"), F.when(n % 13 == 0, "").otherwise("available_time")), "signal_time": F.when(n % 7 == 0, "open_time").otherwise("bar_close"), "decision_time": F.when(n % 5 == 0, "bar_open").otherwise("bar_close"),
        "entry_price": F.when(n % 17 == 0, "close").otherwise("next_continuous_bar_open"), "holding_rule": F.when(n % 19 == 0, " ").otherwise("one bar"), "exit_rule": F.lit("stop or time"), "missing_policy": F.lit("preserve"),
        "available_time_definition": F.when(n % 23 == 0, "").when(n % 29 == 0, "next_day").otherwise("close_time"),
    }).withColumn("factor_id", n.cast("string"))
    forbidden = spark.createDataFrame([("old_factor", "src1", ["the"], []), ("other", "none", [], ["password"])], "factor_id string, research_family string, channels array<string>, wrappers array<string>")
    return sc.audit(p, forbidden).select(F.col("factor_id").cast("long").alias("factor_id"), F.array_join("reasons", ",").alias("reasons"), "verdict")


@add("H16_slot_alignment", f"SELECT event_id, extract('hour' FROM ts) % 4 = 0 AND extract('minute' FROM ts) = 0 AS aligned, {tsq(chr(100) + 'ate_trunc(' + chr(39) + 'day' + chr(39) + ', ts) + INTERVAL 1 DAY', 'next_midnight')}, CAST(floor(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) AS BIGINT) AS age FROM events")
def h16(spark, d):
    e = t.read(spark, d, "events").select("event_id", *sc.slot_checks(F.col("ts"), F.lit("2024-02-01").cast("timestamp_ntz")))
    return e.select("event_id", "aligned", ts("next_midnight"), "age")


@add("H17_rank_weights", with_("wide") + f"SELECT {tsq('event_time')}, asset, greatest(0, 13 - rank() OVER (PARTITION BY event_time ORDER BY volume DESC)) AS weight FROM wide")
def h17(spark, d):
    return t.wide_bars(spark, d).select(ts("event_time"), "asset", sc.rank_weight(F.rank().over(Window.partitionBy("event_time").orderBy(F.desc("volume")))).alias("weight"))


SCEN = "scen(scenario, fee_bps, slip_bps, delay) AS (VALUES ('base', 4.0, 5.0, 0), ('fee_x2', 8.0, 5.0, 0), ('slip_x2', 4.0, 10.0, 0), ('stress', 8.0, 10.0, 0), ('delay_1', 4.0, 5.0, 1), ('delay_2', 4.0, 5.0, 2), ('free', 0.0, 0.0, 0), ('stress_delay', 8.0, 10.0, 1))"


@add("H18_cost_scenarios", with_("b1", more=SCEN + ", s AS (SELECT *, CASE WHEN close > open THEN 1.0 ELSE -1.0 END AS signal, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY event_time), 0) - 1 AS ret FROM b1), p AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY asset ORDER BY event_time), 0) AS position FROM s), q AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY asset ORDER BY event_time), 0)) AS turnover FROM p)") + "SELECT scenario, asset, round(avg(position * coalesce(ret, 0) - turnover * (fee_bps + slip_bps) / 10000), 8) AS mean_net, round(sum(turnover), 4) AS turnover FROM q, scen GROUP BY ALL")
def h18(spark, d):
    frame = _returns(spark, d, "ret").withColumn("signal", F.when(F.col("close") > F.col("open"), 1.0).otherwise(-1.0))
    out = strategy.vector_backtest(frame, cost_bps=0.0).crossJoin(F.broadcast(sc.scenarios(spark)))  # eight fixed rows
    net = F.col("gross") - F.col("turnover") * (F.col("fee_bps") + F.col("slip_bps")) / 10000
    return out.groupBy("scenario", "asset").agg(r8(F.avg(net), "mean_net"), F.round(F.sum("turnover"), 4).alias("turnover"))


@add("I1_spearman_inference")
def i1(spark, d):
    by = information_coefficients(_xy(t.bars(spark, d)), "x", "y", ["asset"])
    return by.select("asset", "n", r8("rank_ic"), r8(inf.spearman_p("rank_ic", "n"), "p"))


PV = "pv AS (SELECT l_suppkey AS name, (l_suppkey % 5)::BIGINT AS family, exp(-abs(avg(l_extendedprice * (l_discount - 0.05))) / 20) AS p FROM lineitem GROUP BY 1)"


def _tests(spark, d):
    p = F.exp(-F.abs(F.avg(F.expr("l_extendedprice * (l_discount - 0.05)"))) / 20)
    return t.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(p.alias("p")).withColumn("family", F.col("name") % 5)


BH = """m AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) AS rank, count(*) OVER (PARTITION BY family) AS m FROM pv),
 a AS (SELECT *, least(min(p * m / rank) OVER (PARTITION BY family ORDER BY rank DESC), 1) AS adjusted, max(CASE WHEN p <= rank / m * 0.05 THEN rank END) OVER (PARTITION BY family) AS lim FROM m)"""


@add("I2_benjamini_hochberg", "WITH " + PV + ", " + BH + " SELECT family, name, rank, round(rank / m * 0.05, 8) AS critical, round(adjusted, 8) AS adjusted, coalesce(rank <= lim, false) AS reject FROM a")
def i2(spark, d):
    return inf.benjamini_hochberg(_tests(spark, d), by=["family"]).select("family", "name", "rank", r8("critical"), r8("adjusted"), "reject")


@add("I3_stationary_bootstrap")
def i3(spark, d):
    return bootstrap.stationary_bootstrap(_xy(t.bars(spark, d)), "x", "y", draws=200).select("asset", r8("low"), r8("high"), "draws")


@add("I4_circular_bootstrap")
def i4(spark, d):
    return bootstrap.circular_bootstrap(_returns(spark, d, "r"), "r", np.mean, column=F.avg, block=42, samples=200).select("asset", r8("low"), r8("high"), "samples")


def _columns(spark, d):
    columns = {"m6": fx.momentum("close", 6), "m24": fx.momentum("close", 24), "r6": fx.reversal("close", 6), "v24": fx.zscore("volume", 24), "y": fx.forward_log_return("close", 1)}
    return in_blocks(t.bars(spark, d), lambda f: f.withColumns(columns), before=24, after=1)


@add("I5_redundancy", with_("b1", more="c AS (SELECT close / nullif(lag(close, 6) OVER w, 0) - 1 AS m6, close / nullif(lag(close, 24) OVER w, 0) - 1 AS m24, -(close / nullif(lag(close, 6) OVER w, 0) - 1) AS r6 FROM b1 WINDOW w AS (PARTITION BY asset ORDER BY event_time)), l AS (SELECT 'm24' AS a, 'm6' AS b, m24 AS x, m6 AS y FROM c UNION ALL SELECT 'm24', 'r6', m24, r6 FROM c UNION ALL SELECT 'm6', 'r6', m6, r6 FROM c), k AS (SELECT *, " + rank_sql("x", "a, b") + " AS rx, " + rank_sql("y", "a, b") + " AS ry FROM l WHERE x IS NOT NULL AND y IS NOT NULL)") + "SELECT a, b, round(corr(rx, ry), 8) AS rho, count(*) AS n FROM k GROUP BY ALL")
def i5(spark, d):
    return inf.rank_correlations(_columns(spark, d), ["m24", "m6", "r6"]).select("a", "b", r8("rho"), "n")


@add("I5b_redundancy_clusters")
def i5b(spark, d):
    names = ["m24", "m6", "r6", "v24"]
    rows = inf.rank_correlations(_columns(spark, d), names).collect()  # a row for each pair of factors
    found = inf.redundancy_clusters([(r["a"], r["b"], r["rho"]) for r in rows], names)
    return spark.createDataFrame(sorted(found.items()), "factor string, cluster int")


RIDGE = """c AS (SELECT asset, event_time, close / nullif(lag(close, 6) OVER w, 0) - 1 AS m6, close / nullif(lag(close, 24) OVER w, 0) - 1 AS m24, CASE WHEN count(volume) OVER v = 24 THEN (volume - avg(volume) OVER v) / nullif(stddev_samp(volume) OVER v, 0) END AS v24, ln(lead(close) OVER w / nullif(close, 0)) AS y FROM b1 WINDOW w AS (PARTITION BY asset ORDER BY event_time), v AS (PARTITION BY asset ORDER BY event_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
 k AS (SELECT *, event_time < TIMESTAMP '2024-01-20' AS early FROM c WHERE m6 IS NOT NULL AND m24 IS NOT NULL AND v24 IS NOT NULL AND y IS NOT NULL),
 g AS (SELECT count(*) AS n_train, sum(m24 * m24) + 1 AS aa, sum(m24 * v24) AS ab, sum(v24 * v24) + 1 AS bb, sum(m24 * m6) AS ac, sum(v24 * m6) AS bc, sum(m6 * m6) + 1 AS cc, sum(m24 * y) AS ay, sum(v24 * y) AS by_, sum(m6 * y) AS cy FROM k WHERE early),
 s AS (SELECT n_train, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS p2, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det,
  ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy) AS d1, aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac) AS d2, aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac) AS d3 FROM g),
 f AS (SELECT k.*, n_train, p1 * m24 + p2 * v24 AS base, (d1 * m24 + d2 * v24 + d3 * m6) / det AS ext FROM k, s WHERE NOT early),
 h AS (SELECT *, abs(sign(base) - lag(sign(base)) OVER w) AS tb, abs(sign(ext) - lag(sign(ext)) OVER w) AS te FROM f WINDOW w AS (PARTITION BY asset ORDER BY event_time)),
 o AS (SELECT any_value(n_train) AS n_train, count(*) AS n_valid, corr(m6, y) AS standalone, corr(base, y) AS ib, corr(ext, y) AS ie, avg(sign(base) * y) - coalesce(avg(tb), 0) * 5 / 10000 AS rb, avg(sign(ext) * y) - coalesce(avg(te), 0) * 5 / 10000 AS re FROM h)"""


@add("I6_incremental_value", with_("b1", more=RIDGE) + "SELECT n_train, n_valid, round(standalone, 6) AS standalone, round(ib, 6) AS ic_baseline, round(ie, 6) AS ic_extended, round(rb, 8) AS return_baseline, round(re, 8) AS return_extended, ie - ib > 0.001 AND re > rb AS incremental FROM o")
def i6(spark, d):
    c = _columns(spark, d)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    out = inf.increment(c.filter(F.col("event_time") < cut), c.filter(F.col("event_time") >= cut), ["m24", "v24"], "m6", "y", cost_bps=5.0)
    return out.select("n_train", "n_valid", *(F.round(x, 6).alias(x) for x in ("standalone", "ic_baseline", "ic_extended")), r8("return_baseline"), r8("return_extended"), "incremental")


@add("I7_walk_forward_folds", with_("b1", more="p AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY event_time) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n FROM b1), k AS (SELECT DISTINCT asset, unnest(generate_series(0, CAST(floor((n - 200) / 60) AS BIGINT) - 1)) AS fold FROM p)") + "SELECT k.asset, k.fold, count(*) FILTER (WHERE pos >= 200 + 60 * fold AND pos < 260 + 60 * fold) AS test_rows, count(*) FILTER (WHERE pos + 1 + 4 + 6 <= 200 + 60 * fold) AS train_rows FROM k JOIN p ON p.asset = k.asset GROUP BY ALL")
def i7(spark, d):
    f = inf.walk_forward(t.bars(spark, d), initial=200, test=60, purge=4, embargo=6)
    return inf.fold_counts(f)


@add("I7b_simple_folds", with_("b1", more="p AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY event_time) - 1 AS pos, greatest(count(*) OVER (PARTITION BY asset) // 5, 1) AS block FROM b1), k AS (SELECT DISTINCT asset, unnest([0, 1, 2, 3]) AS fold FROM p)") + "SELECT k.asset, k.fold, count(*) FILTER (WHERE pos >= block * (1 + fold) AND pos < block * (2 + fold)) AS test_rows, count(*) FILTER (WHERE pos + 1 + 2 <= block * (1 + fold)) AS train_rows FROM k JOIN p ON p.asset = k.asset GROUP BY ALL")
def i7b(spark, d):
    f = inf.simple_folds(t.bars(spark, d), folds=4, purge=2)
    return inf.fold_counts(f)


HW = """wt AS (SELECT event_time, asset, CASE WHEN close > open THEN 0.2 ELSE -0.2 END AS weight, lead(open) OVER (PARTITION BY asset ORDER BY event_time) / nullif(open, 0) - 1 AS ret FROM b4),
 bk AS (SELECT event_time, sum(weight * coalesce(ret, 0)) AS gross, count(*) FILTER (WHERE weight <> 0 AND ret IS NULL) AS bad_bars, count(*) FILTER (WHERE weight <> 0) AS active FROM wt GROUP BY event_time),
 bs AS (SELECT *, CASE WHEN bad_bars > 0 THEN 'EXECUTION_BAR_INVALID' WHEN 1 + gross <= 0 THEN 'NONPOSITIVE_DENOMINATOR' ELSE 'OK' END AS status FROM bk),
 bn AS (SELECT *, lead(event_time) OVER (ORDER BY event_time) AS nx, lag(status) OVER (ORDER BY event_time) AS was, lag(active) OVER (ORDER BY event_time) AS had FROM bs),
 mv AS (SELECT event_time, asset, weight AS w FROM wt UNION ALL SELECT bn.nx, wt.asset, -wt.weight * (1 + coalesce(wt.ret, 0)) / (1 + bn.gross) FROM wt JOIN bn ON bn.event_time = wt.event_time WHERE bn.status = 'OK' AND bn.nx IS NOT NULL),
 tu AS (SELECT event_time, sum(t) AS turnover FROM (SELECT event_time, asset, abs(sum(w)) AS t FROM mv GROUP BY ALL) GROUP BY event_time),
 hw AS (SELECT bn.event_time, status, active, bad_bars, coalesce(was = 'OK' AND had > 0, false) AS drifted, CASE WHEN status = 'OK' THEN gross END AS gross, CASE WHEN coalesce(was, 'OK') = 'OK' THEN turnover END AS turnover FROM bn JOIN tu ON tu.event_time = bn.event_time)"""


def _book(spark, d):
    b = t.bars(spark, d, 4)
    w = b.select("event_time", "asset", F.when(F.col("close") > F.col("open"), 0.2).otherwise(-0.2).alias("weight"))
    r = in_blocks(b, lambda f: f.withColumn("ret", F.try_divide(F.lead("open", 1).over(fx.W()), F.col("open")) - 1), after=1).select("event_time", "asset", "ret")
    return inf.held_weights(w, r, fee_bps=5.0)


@add("I9_held_weights", with_("b4", more=HW) + f"SELECT {tsq('event_time')}, status, round(gross, 8) AS gross, round(turnover, 8) AS turnover, bad_bars, round(gross - turnover * 5 / 10000, 8) AS net FROM hw")
def i9(spark, d):
    return _book(spark, d).select(ts("event_time"), "status", r8("gross"), r8("turnover"), "bad_bars", r8("net"))


@add("D33_orderflow_summary", with_("b4", more=HW) + "SELECT count(*) AS total_bars, count(*) FILTER (WHERE active = 0) AS flat_bars, count(*) FILTER (WHERE active > 0 AND status = 'OK') AS active_bars, count(*) FILTER (WHERE drifted) AS drifted_bars, count(*) FILTER (WHERE status <> 'OK') AS refused_bars, round(sum(turnover), 6) AS turnover, round(sum(turnover) * 5 / 10000, 8) AS fee FROM hw")
def d33(spark, d):
    out = inf.book_summary(_book(spark, d))
    return out.select("total_bars", "flat_bars", "active_bars", "drifted_bars", "refused_bars", F.round("turnover", 6).alias("turnover"), r8("fee"))


@add("I10_cycle_comparison", with_("b24", more="""r AS (SELECT event_time, asset, close / nullif(open, 0) - 1 AS ret, volume FROM b24), e AS (SELECT event_time, avg(ret) AS eq, sum(ret * volume) / sum(volume) AS wt FROM r GROUP BY event_time)""") + f"SELECT {tsq('event_time')}, round(100 * exp(sum(CASE WHEN eq > -1 THEN ln(1 + eq) END) OVER (ORDER BY event_time)), 6) AS equal_weight, round(100 * exp(sum(CASE WHEN 0.4 * wt > -1 THEN ln(1 + 0.4 * wt) END) OVER (ORDER BY event_time)), 6) AS weighted FROM e")
def i10(spark, d):
    r = t.bars(spark, d, 24).withColumn("ret", F.try_divide(F.col("close"), F.col("open")) - 1)
    return strategy.compare_allocations(r, cap=0.4).select(ts("event_time"), F.round("equal_weight", 6).alias("equal_weight"), F.round("weighted", 6).alias("weighted"))


SLICES = FXY.format("b1") + """, s AS (SELECT asset, CASE WHEN event_time < TIMESTAMP '2024-01-10' THEN 'a' WHEN event_time < TIMESTAMP '2024-01-20' THEN 'b' ELSE 'c' END AS fold, regime, x, y FROM f JOIN (SELECT asset AS a2, event_time AS t2, CASE WHEN close > open THEN 'up' ELSE 'down' END AS regime FROM b1) r ON a2 = asset AND t2 = event_time WHERE x IS NOT NULL AND y IS NOT NULL),
 sx AS (SELECT 'momentum' AS factor_id, asset, fold, regime, x AS v, y FROM s UNION ALL SELECT 'reversal', asset, fold, regime, -x, y FROM s),
 k AS (SELECT *, """ + rank_sql("v", "factor_id, asset, fold, regime") + " AS rx, " + rank_sql("y", "factor_id, asset, fold, regime") + " AS ry FROM sx), sl AS (SELECT factor_id, asset, fold, regime, count(*) AS n, corr(rx, ry) AS rank_ic FROM k GROUP BY ALL)"


def _slices(spark, d):
    """Momentum and reversal by asset, fold and regime."""
    f = _xy(t.bars(spark, d)).withColumns({
        "fold": F.when(F.col("event_time") < F.lit("2024-01-10").cast("timestamp_ntz"), "a").when(F.col("event_time") < F.lit("2024-01-20").cast("timestamp_ntz"), "b").otherwise("c"), "regime": F.when(F.col("close") > F.col("open"), "up").otherwise("down"),
    })
    both = F.array(F.struct(F.lit("momentum").alias("factor_id"), F.col("x").alias("v")), F.struct(F.lit("reversal").alias("factor_id"), (-F.col("x")).alias("v")))
    long = f.select("asset", "fold", "regime", "y", F.explode(both).alias("_e")).select("asset", "fold", "regime", "y", "_e.*")
    return information_coefficients(long, "v", "y", ["factor_id", "asset", "fold", "regime"])


@add("I11_development_gate", with_("b1", more=SLICES + """, rj AS (SELECT *, abs(rank_ic) > 0.3 AS reject FROM sl), fa AS (SELECT factor_id, CASE factor_id WHEN 'momentum' THEN 0 ELSE 1 END AS direction, factor_id = 'reversal' AS representative, avg(rank_ic) AS delta5, avg(rank_ic) - 0.001 AS delta10, CASE factor_id WHEN 'reversal' THEN CAST(sign(avg(rank_ic)) AS INTEGER) END AS hour, factor_id = 'reversal' AS has_delays, CAST(sign(min(rank_ic)) AS INTEGER) AS w1, CAST(sign(max(rank_ic)) AS INTEGER) AS w2 FROM rj GROUP BY factor_id),
 el AS (SELECT * FROM rj WHERE n >= 30 AND rank_ic IS NOT NULL AND NOT isnan(rank_ic)), mo AS (SELECT factor_id, count(*) FILTER (WHERE rank_ic > 0) AS up, count(*) FILTER (WHERE rank_ic <> 0) AS moved FROM el GROUP BY factor_id),
 tg AS (SELECT fa.*, CASE WHEN direction <> 0 THEN direction WHEN coalesce(moved, 0) = 0 THEN 0 WHEN up >= moved / 2 THEN 1 ELSE -1 END AS target FROM fa LEFT JOIN mo USING (factor_id)),
 ef AS (SELECT el.*, target, sign(rank_ic) = target AS fits FROM el JOIN tg USING (factor_id)),
 ga AS (SELECT factor_id, count(*) AS eligible, count(*) FILTER (WHERE reject) AS survivors, count(*) FILTER (WHERE fits) AS nf, count(DISTINCT CASE WHEN reject THEN asset END) AS assets FROM ef GROUP BY factor_id),
 sa AS (SELECT factor_id, coalesce(max(n) / nullif(sum(n), 0), 0) AS asset_share FROM (SELECT factor_id, asset, count(*) FILTER (WHERE reject AND fits) AS n FROM ef GROUP BY ALL) GROUP BY factor_id), sr AS (SELECT factor_id, coalesce(max(n) / nullif(sum(n), 0), 0) AS regime_share FROM (SELECT factor_id, regime, count(*) FILTER (WHERE reject AND fits) AS n FROM ef GROUP BY ALL) GROUP BY factor_id),
 al AS (SELECT tg.*, coalesce(eligible, 0) AS eligible, coalesce(survivors, 0) AS survivors, coalesce(nf / eligible, 0) AS agreement, coalesce(assets, 0) AS assets, coalesce(asset_share, 0) AS asset_share, coalesce(regime_share, 0) AS regime_share FROM tg LEFT JOIN ga USING (factor_id) LEFT JOIN sa USING (factor_id) LEFT JOIN sr USING (factor_id))""")
     + """SELECT factor_id, target, eligible, survivors, round(agreement, 8) AS agreement, assets, round(asset_share, 8) AS asset_share, round(regime_share, 8) AS regime_share, concat_ws(',', CASE WHEN survivors < 2 THEN 'BH_SURVIVING_SLICES_LT_2,INDEPENDENT_SLICES_LT_2' END, CASE WHEN agreement < 0.6 THEN 'DIRECTION_AGREEMENT_LT_60PCT' END, CASE WHEN assets < 2 THEN 'ASSETS_LT_2' END, CASE WHEN NOT representative THEN 'REDUNDANT_NON_REPRESENTATIVE' END, CASE WHEN NOT coalesce(delta5 > 0, false) THEN 'FINAL_FOLD_5BPS_NON_POSITIVE' END, CASE WHEN NOT coalesce(delta10 >= 0, false) THEN 'TEN_BPS_NEGATIVE' END,
 CASE WHEN asset_share > 0.5 THEN 'ASSET_SUPPORT_CONCENTRATION_GT_50PCT' END, CASE WHEN regime_share > 0.5 THEN 'REGIME_SUPPORT_CONCENTRATION_GT_50PCT' END, CASE WHEN coalesce(hour, 0) = 0 THEN 'ONE_HOUR_SENSITIVITY_UNAVAILABLE' WHEN hour <> target THEN 'ONE_HOUR_DIRECTION_UNSTABLE' END, CASE WHEN has_delays AND (w1 = 0 OR w1 <> target OR w2 = 0 OR w2 <> target) THEN 'OI_DELAY_DIRECTION_UNSTABLE' END) AS reasons FROM al""")
def i11(spark, d):
    s = _slices(spark, d).withColumn("reject", F.abs("rank_ic") > 0.3)
    rev, sign = F.col("factor_id") == "reversal", lambda c: F.signum(c).cast("int")
    mean = F.avg("rank_ic")
    facts = s.groupBy("factor_id").agg(mean.alias("delta_5bps"), (mean - 0.001).alias("delta_10bps"), sign(mean).alias("_m"), sign(F.min("rank_ic")).alias("_a"), sign(F.max("rank_ic")).alias("_b"))
    facts = facts.select("factor_id", F.when(rev, 1).otherwise(0).alias("direction"), rev.alias("representative"), "delta_5bps", "delta_10bps", F.when(rev, F.col("_m")).alias("hour_direction"), F.when(rev, F.array("_a", "_b", "_a")).alias("delay_directions"))
    out = inf.development_gate(s, facts)
    return out.select("factor_id", "target", "eligible", "survivors", r8("agreement"), "assets", r8("asset_share"), r8("regime_share"), F.concat_ws(",", "reasons").alias("reasons"))


FAMILY = """w AS (SELECT l_suppkey % {m} AS g, year(l_shipdate)::VARCHAR AS fold, l_returnflag AS asset, l_linestatus AS regime, l_extendedprice * (l_discount - 0.05) AS v, extract('day' FROM l_shipdate) AS day FROM lineitem),
 sl AS (SELECT 'flow' AS factor_id, CASE g WHEN 0 THEN '1h' ELSE '2h' END AS horizon, 0.2::DOUBLE AS q, fold, asset, regime, exp(-abs(avg(v)) / 4) AS p, avg(v) AS direction_estimate, count(*) AS n_effective, list(DISTINCT day) AS bars FROM w GROUP BY ALL),
 un AS (SELECT fold, asset, regime, count(*) AS effective, count(*) FILTER (WHERE day = 1) AS missing, count(*) FILTER (WHERE day = 2) AS infeasible FROM w GROUP BY ALL)"""


@add("I12_family_gate", "WITH " + FAMILY.format(m=2) + """, k AS (SELECT *, concat_ws('|', factor_id, horizon, '0.2', fold, asset, regime) AS key, row_number() OVER (ORDER BY p, concat_ws('|', factor_id, horizon, '0.2', fold, asset, regime)) AS rank, count(*) OVER () AS m FROM sl), a AS (SELECT *, least(min(p * m / rank) OVER (ORDER BY rank DESC), 1) AS adjusted FROM k),
 pr AS (SELECT * FROM a WHERE horizon = '1h'), st AS (SELECT * FROM pr WHERE n_effective >= 30 AND adjusted < 0.05), lf AS (SELECT * FROM st x WHERE NOT EXISTS (SELECT 1 FROM st y WHERE y.asset = x.asset AND y.key <> x.key AND list_has_any(x.bars, y.bars))),
 g AS (SELECT (SELECT count(*) FROM un) AS units, (SELECT count(*) FROM a WHERE p IS NOT NULL) AS denominator, (SELECT count(*) FROM lf) AS survivors, (SELECT count(DISTINCT asset) FROM lf) AS assets, (SELECT count(*) FILTER (WHERE direction_estimate > 0) / nullif(count(*), 0) FROM pr WHERE n_effective >= 30) AS consistency, coalesce((SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM lf GROUP BY asset)), 0) AS asset_share, coalesce((SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM lf GROUP BY regime)), 0) AS regime_share,
  (SELECT count(*) FROM pr WHERE n_effective < 30) AS small_cells, (SELECT sum(missing + infeasible) / sum(effective + missing + infeasible) FROM un) AS excluded, (SELECT count(*) FROM (SELECT fold, asset, regime, h FROM un, (VALUES ('1h'), ('2h')) v(h)) e WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.fold = e.fold AND sl.asset = e.asset AND sl.regime = e.regime AND sl.horizon = e.h)) AS holes),
 r AS (SELECT *, concat_ws(',', CASE WHEN excluded > 0.5 THEN 'EXCLUSION_RATIO_EXCEEDS_TOLERANCE' END, CASE WHEN small_cells > 0 THEN 'INSUFFICIENT_CELL' END, CASE WHEN holes > 0 THEN 'PREREGISTERED_SLICE_MISSING' END) AS thin, concat_ws(',', CASE WHEN assets < 2 THEN 'ASSET_DIVERSITY_BELOW_MINIMUM' END, CASE WHEN asset_share > 0.5 THEN 'ASSET_CONCENTRATION_EXCEEDS_MAX' END, CASE WHEN regime_share > 0.5 THEN 'REGIME_CONCENTRATION_EXCEEDS_MAX' END, CASE WHEN coalesce(consistency, 0) < 0.6 THEN 'DIRECTION_CONSISTENCY_BELOW_MINIMUM' END) AS bad FROM g)
SELECT CASE WHEN thin <> '' OR survivors < 2 THEN 'INSUFFICIENT' WHEN bad <> '' THEN 'FAIL' ELSE 'PASS' END AS verdict, CASE WHEN thin <> '' THEN thin WHEN survivors < 2 THEN 'SURVIVING_SLICES_BELOW_MINIMUM' ELSE bad END AS reasons, units, denominator, survivors, assets, round(coalesce(consistency, 0), 8) AS consistency, round(asset_share, 8) AS asset_share, round(regime_share, 8) AS regime_share FROM r""")
def i12(spark, d):
    w = t.read(spark, d, "lineitem").select((F.col("l_suppkey") % 2).alias("g"), F.year("l_shipdate").cast("string").alias("fold"), F.col("l_returnflag").alias("asset"), F.col("l_linestatus").alias("regime"), F.expr("l_extendedprice * (l_discount - 0.05)").alias("v"), F.dayofmonth("l_shipdate").alias("day"))
    keyed = w.withColumns({"factor_id": F.lit("flow"), "horizon": F.when(F.col("g") == 0, "1h").otherwise("2h"), "q": F.lit(0.2)})
    s = inf.with_bitmaps(keyed, list(inf.SLICE), "day", F.exp(-F.abs(F.avg("v")) / 4).alias("p"), F.avg("v").alias("direction_estimate"), F.count(F.lit(1)).alias("n_effective"))
    u = w.groupBy("fold", "asset", "regime").agg(F.count(F.lit(1)).alias("effective"), F.count_if(F.col("day") == 1).alias("missing"), F.count_if(F.col("day") == 2).alias("infeasible"))
    out = inf.family_gate(s, u, horizons=["1h", "2h"], qs=[0.2], primary=("1h", 0.2))
    return out.select("verdict", F.concat_ws(",", "reasons").alias("reasons"), "units", "denominator", "survivors", "assets", r8("consistency"), r8("asset_share"), r8("regime_share"))


@add("I14_horizon_diagnostics", with_("b1", more="c AS (SELECT close / nullif(lag(close, 6) OVER w, 0) - 1 AS m6, close / nullif(lag(close, 24) OVER w, 0) - 1 AS m24, -(close / nullif(lag(close, 6) OVER w, 0) - 1) AS r6, CASE WHEN count(volume) OVER v = 24 THEN (volume - avg(volume) OVER v) / nullif(stddev_samp(volume) OVER v, 0) END AS v24 FROM b1 WINDOW w AS (PARTITION BY asset ORDER BY event_time), v AS (PARTITION BY asset ORDER BY event_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)), l AS (SELECT 'm24' AS b, m6 AS x, m24 AS y FROM c UNION ALL SELECT 'r6', m6, r6 FROM c UNION ALL SELECT 'v24', m6, v24 FROM c), k AS (SELECT *, " + rank_sql("x", "b") + " AS rx, " + rank_sql("y", "b") + " AS ry FROM l WHERE x IS NOT NULL AND y IS NOT NULL)") + "SELECT b AS other_factor_id, round(corr(rx, ry), 6) AS rank_ic, CASE WHEN abs(corr(rx, ry)) > 0.7 THEN 'statistically_near_equivalent' ELSE '' END AS label FROM k GROUP BY b")
def i14(spark, d):
    """Which existing factors the short momentum nearly repeats."""
    return inf.near_equivalents(inf.rank_correlations(_columns(spark, d), ["m24", "m6", "r6", "v24"]), "m6").select("other_factor_id", F.round("rank_ic", 6).alias("rank_ic"), "label")


@add("I14b_horizon_family", "WITH " + FAMILY.format(m=2) + """, k AS (SELECT *, row_number() OVER (ORDER BY p, concat_ws('|', factor_id, horizon, '0.2', fold, asset, regime)) AS rank, count(*) OVER () AS m FROM sl) SELECT horizon, fold, asset, regime, round(least(min(p * m / rank) OVER (ORDER BY rank DESC), 1), 8) AS adjusted, true AS diagnostic_only FROM k""")
def i14b(spark, d):
    w = t.read(spark, d, "lineitem").select((F.col("l_suppkey") % 2).alias("g"), F.year("l_shipdate").cast("string").alias("fold"), F.col("l_returnflag").alias("asset"), F.col("l_linestatus").alias("regime"), F.expr("l_extendedprice * (l_discount - 0.05)").alias("v"))
    s = w.groupBy(F.lit("flow").alias("factor_id"), F.when(F.col("g") == 0, "1h").otherwise("2h").alias("horizon"), F.lit(0.2).alias("q"), "fold", "asset", "regime").agg(F.exp(-F.abs(F.avg("v")) / 4).alias("p"))
    return inf.horizon_diagnostics(s).select("horizon", "fold", "asset", "regime", r8("adjusted"), "diagnostic_only")


HOLD = """jo AS (SELECT b.asset, b.delay, b.event_time, b.close, v.open_interest FROM (SELECT b1.*, delay FROM b1 CROSS JOIN (VALUES (5), (10), (15)) x(delay)) b ASOF LEFT JOIN (SELECT asset, event_time + delay * INTERVAL 1 MINUTE AS available_time, open_interest, delay FROM oi CROSS JOIN (VALUES (5), (10), (15)) v(delay)) v ON b.delay = v.delay AND b.asset = v.asset AND b.available_time >= v.available_time),
 fx AS (SELECT asset, delay, event_time, open_interest / nullif(lag(open_interest, 24) OVER w, 0) - 1 AS x, ln(lead(close) OVER w / nullif(close, 0)) AS y FROM jo WINDOW w AS (PARTITION BY delay, asset ORDER BY event_time)),
 h AS (SELECT * FROM fx WHERE event_time >= TIMESTAMP '2024-01-20'),
 k AS (SELECT *, """ + rank_sql("x", "delay, asset") + " AS rx, " + rank_sql("y", "delay, asset") + """ AS ry FROM h WHERE x IS NOT NULL AND y IS NOT NULL), ic AS (SELECT delay, asset, corr(rx, ry) AS ic FROM k GROUP BY ALL),
 mn AS (SELECT asset, avg(y) AS m FROM h WHERE delay = 5 AND y IS NOT NULL GROUP BY asset), ow AS (SELECT ic.asset, ic, sign(ic) * m AS r FROM ic JOIN mn ON mn.asset = ic.asset WHERE delay = 5 AND ic IS NOT NULL AND NOT isnan(ic)),
 a AS (SELECT count(*) AS assets, count(*) FILTER (WHERE sign(ic) <> -1) AS against, count(*) FILTER (WHERE r > 0) AS support, avg(r) AS mean_return FROM ow), dl AS (SELECT count(*) AS delays, count(*) FILTER (WHERE s <> -1) AS off FROM (SELECT delay, sign(median(ic)) AS s FROM ic WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY delay))"""


@add("I15_holdout_evaluation", with_("b1", "oi", more=HOLD) + "SELECT assets, round(mean_return, 8) AS mean_return, round(mean_return - 0.0005, 8) AS after_5bps, round(mean_return - 0.0010, 8) AS after_10bps, concat_ws(',', CASE WHEN assets < 2 THEN 'HOLDOUT_ASSET_COVERAGE_LT_2' END, CASE WHEN against > 0 THEN 'HOLDOUT_DIRECTION_UNSTABLE' END, CASE WHEN support = 1 THEN 'HOLDOUT_ASSET_CONCENTRATION_GT_50PCT' END, CASE WHEN NOT coalesce(mean_return - 0.0005 > 0, false) THEN 'HOLDOUT_5BPS_NON_POSITIVE' END, CASE WHEN NOT coalesce(mean_return - 0.0010 >= 0, false) THEN 'HOLDOUT_10BPS_NEGATIVE' END, CASE WHEN delays < 3 THEN 'HOLDOUT_OI_DELAY_STRESS_UNAVAILABLE' WHEN off > 0 THEN 'HOLDOUT_OI_DELAY_DIRECTION_UNSTABLE' END) AS reasons FROM a, dl")
def i15(spark, d):
    """The change of open interest, under three publication delays."""
    from asofly.operators import asof, joins

    views = asof.delay_views(t.open_interest(spark, d), (5, 10, 15))
    wide = joins.delay_columns(asof.asof_by_delay(t.bars(spark, d), views, (5, 10, 15)), [5, 10, 15]).join(t.bars(spark, d).select("asset", "event_time", "close"), ["asset", "event_time"])
    columns = {**{f"x{k}": fx.change(f"oi_{k}m", 24) for k in (5, 10, 15)}, "y": fx.forward_log_return("close", 1)}
    wide = in_blocks(wide, lambda f: f.withColumns(columns), before=24, after=1).filter("event_time >= timestamp_ntz'2024-01-20'")
    out = inf.holdout_evaluation(wide, "x5", "y", direction=-1, delayed={5: "x5", 10: "x10", 15: "x15"})
    return out.select("assets", r8("mean_return"), r8("after_5bps"), r8("after_10bps"), F.concat_ws(",", "reasons").alias("reasons"))


INPUTS = """src AS (SELECT *, taker_buy_base / nullif(volume, 0) AS x, coalesce(volume <> 0 AND taker_buy_base IS NOT NULL AND taker_buy_base / nullif(volume, 0) BETWEEN 0 AND 1, false) AS ok FROM wide), """ + PEERS + """, sg AS (SELECT *, CASE WHEN ok AND n >= 2 AND mad > 0 THEN least(greatest((x - med) / (1.4826 * mad), -5), 5) END AS signal FROM dev),
 gp AS (SELECT *, CASE WHEN open > 0 AND volume > 0 AND quote_volume > 0 THEN 0 ELSE 1 END AS bad, CASE WHEN lag(event_time) OVER w IS NOT NULL AND event_time - lag(event_time) OVER w <> INTERVAL 4 HOUR THEN 1 ELSE 0 END AS gap, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY asset) AS total, ln(close / nullif(lag(close) OVER w, 0)) AS lr FROM sg WINDOW w AS (PARTITION BY asset ORDER BY event_time)),
 pp AS (SELECT *, sum(bad) OVER w AS nb, sum(gap) OVER w AS ng, CASE WHEN count(lr) OVER v = 12 THEN stddev_samp(lr) OVER v END AS vol FROM gp WINDOW w AS (PARTITION BY asset ORDER BY event_time), v AS (PARTITION BY asset ORDER BY event_time ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 lb AS (SELECT asset, event_time, pos, total, signal, vol, k AS horizon, CASE WHEN lead(ng, k + 1) OVER w IS NULL OR lead(ng, k + 1) OVER w - ng > 0 THEN 'MISSING_NEXT_BAR' WHEN lead(nb, k + 1) OVER w - nb > 0 THEN 'EXECUTION_BAR_INVALID' ELSE '' END AS reason, ln(lead(open, k + 1) OVER w / nullif(lead(open, 1) OVER w, 0)) AS raw FROM (SELECT * FROM pp, (VALUES (1)) v(k)) WINDOW w AS (PARTITION BY asset ORDER BY event_time)
  UNION ALL SELECT asset, event_time, pos, total, signal, vol, k, CASE WHEN lead(ng, k + 1) OVER w IS NULL OR lead(ng, k + 1) OVER w - ng > 0 THEN 'MISSING_NEXT_BAR' WHEN lead(nb, k + 1) OVER w - nb > 0 THEN 'EXECUTION_BAR_INVALID' ELSE '' END, ln(lead(open, 3) OVER w / nullif(lead(open, 1) OVER w, 0)) FROM (SELECT * FROM pp, (VALUES (2)) v(k)) WINDOW w AS (PARTITION BY asset ORDER BY event_time)),
 fo AS (SELECT DISTINCT asset, greatest(60, total // 4) AS initial, greatest(30, (total - greatest(60, total // 4)) // 3) AS test, total FROM gp WHERE total >= 100), fk AS (SELECT asset, initial, test, unnest(generate_series(0, CAST(floor((total - initial) / test) AS BIGINT) - 1)) AS fold FROM fo),
 th AS (SELECT fk.asset, fk.fold, quantile_cont(vol, 0.75) AS qv FROM fk JOIN pp ON pp.asset = fk.asset AND pp.pos + 1 + 1 + 6 <= fk.initial + fk.test * fk.fold GROUP BY ALL),
 te AS (SELECT lb.*, fk.fold, CASE WHEN coalesce(lb.vol > th.qv, false) THEN 'high_vol' ELSE 'low_vol' END AS regime, CASE WHEN lb.reason = '' THEN lb.raw END AS y FROM fk JOIN lb ON lb.asset = fk.asset AND lb.pos >= fk.initial + fk.test * fk.fold AND lb.pos < fk.initial + fk.test * (fk.fold + 1) JOIN th ON th.asset = fk.asset AND th.fold = fk.fold),
 k AS (SELECT *, """ + rank_sql("signal", "asset, fold, regime, horizon") + " AS rx, " + rank_sql("y", "asset, fold, regime, horizon") + """ AS ry FROM te WHERE signal IS NOT NULL AND y IS NOT NULL), st AS (SELECT asset, fold, regime, horizon, count(*) AS n_effective, corr(rx, ry) AS direction_estimate FROM k GROUP BY ALL),
 un AS (SELECT asset, fold, regime, horizon, count(*) FILTER (WHERE signal IS NOT NULL AND y IS NOT NULL) AS effective, count(*) FILTER (WHERE reason = 'MISSING_NEXT_BAR') AS missing, count(*) FILTER (WHERE reason = 'EXECUTION_BAR_INVALID') AS infeasible FROM te GROUP BY ALL)"""


@add("I13_gate_inputs", with_("wide", more=INPUTS + ", ps AS (SELECT asset, fold, regime, count(DISTINCT pos) AS bars, min(pos) AS first_bar, max(pos) AS last_bar FROM te GROUP BY ALL)") + "SELECT un.asset, un.fold, un.regime, un.horizon, q, un.effective, un.missing, un.infeasible, coalesce(st.n_effective, 0) AS n_effective, round(CASE WHEN isnan(st.direction_estimate) THEN NULL ELSE st.direction_estimate END, 8) AS direction_estimate, coalesce(st.n_effective, 0) >= 30 AND NOT isnan(st.direction_estimate) AS tested, ps.bars FROM un LEFT JOIN st ON st.asset = un.asset AND st.fold = un.fold AND st.regime = un.regime AND st.horizon = un.horizon JOIN ps ON ps.asset = un.asset AND ps.fold = un.fold AND ps.regime = un.regime, (VALUES (0.1), (0.2), (0.3)) v(q)")
def i13(spark, d):
    out = _inputs(spark, d)
    held = F.aggregate("bars", F.lit(0).cast("long"), lambda n, b: n + F.bitmap_count(b["bits"]))
    return out.select("asset", "fold", "regime", "horizon", F.col("q").cast("decimal(2,1)").alias("q"), "effective", "missing", "infeasible", "n_effective", r8("direction_estimate"), F.col("p").isNotNull().alias("tested"), held.alias("bars"))


def _inputs(spark, d):
    return inf.gate_inputs(t.wide_bars(spark, d), horizons=(1, 2), qs=(0.1, 0.2, 0.3), bar_hours=4, window=12)


@add("I13b_gate_of_inputs")
def i13b(spark, d):
    """The family gate over what gate_inputs makes: the orderflow factor, three qs, one of them primary."""
    from asofly.plans.shared import stash

    found = stash(_inputs(spark, d), "gate-inputs")
    out = inf.family_gate(inf.gate_slices(found, "taker_orderflow_imbalance"), inf.gate_units(found, 1), horizons=["1h", "2h"], qs=[0.1, 0.2, 0.3], primary=("1h", 0.2))
    return out.withColumn("reasons", F.concat_ws(",", "reasons"))


@add("I16_factor_run")
def i16(spark, d):
    """Evaluations with their adjusted p-values, the cluster of each factor, its representative and its increment."""
    names = ["m24", "m6", "v24"]
    c = _columns(spark, d).withColumn("fold", F.when(F.col("event_time") < F.lit("2024-01-15").cast("timestamp_ntz"), "train").when(F.col("event_time") < F.lit("2024-01-23").cast("timestamp_ntz"), "first").otherwise("second"))
    return inf.factor_run(c, names, "y", train="train", last="second", cost_bps=5.0).select("factor_id", "asset", "fold", "n", r8("rank_ic"), r8("p"), r8("adjusted"), "reject", "cluster", "representative", r8("delta_return"), "incremental")


PATHS = """sc2(scenario, fee_bps, slip_bps, delay) AS (VALUES ('base', 4.0, 5.0, 0), ('fee_x2', 8.0, 5.0, 0), ('slip_x2', 4.0, 10.0, 0), ('stress', 8.0, 10.0, 0), ('delay_1', 4.0, 5.0, 1), ('delay_2', 4.0, 5.0, 2), ('free', 0.0, 0.0, 0), ('stress_delay', 8.0, 10.0, 1)),
 pa(variant, stop, target) AS (VALUES ('down', 0.045, 0.09), ('normal', 0.05, 0.1), ('up', 0.055, 0.11)),
 p AS (SELECT asset, event_time, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY asset) AS total, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 END AS side, [lead(open, 1) OVER w, lead(open, 2) OVER w, lead(open, 3) OVER w] AS entries, [event_time, lead(event_time, 1) OVER w, lead(event_time, 2) OVER w] AS starts FROM b1 WINDOW w AS (PARTITION BY asset ORDER BY event_time)),
 e AS (SELECT asset, event_time, pos, side, delay, entries[delay + 1] AS entry, starts[delay + 1] AS start FROM p, (VALUES (0), (1), (2)) k(delay) WHERE side IS NOT NULL AND entries[delay + 1] > 0),
 s AS (SELECT e.*, variant, entry * (1 - side * stop) AS stop, entry * (1 + side * target) AS target FROM e, pa),
 j AS (SELECT s.*, b.event_time AS t, b.close, CASE WHEN (side = 1 AND b.low <= stop) OR (side = -1 AND b.high >= stop) THEN 'STOP' WHEN (side = 1 AND b.high >= target) OR (side = -1 AND b.low <= target) THEN 'TARGET' END AS o FROM s JOIN b1 b ON b.asset = s.asset AND b.event_time > s.start AND b.event_time <= s.start + INTERVAL 24 HOUR),
 r AS (SELECT variant, delay, asset, pos, any_value(side) AS side, any_value(entry) AS entry, coalesce(arg_min(CASE WHEN o = 'STOP' THEN stop ELSE target END, t) FILTER (WHERE o IS NOT NULL), arg_max(close, t)) AS px FROM j GROUP BY ALL),
 net AS (SELECT variant, scenario, asset, pos, side, side * (px / entry - 1) - 2 * (fee_bps + slip_bps) / 10000 AS net FROM r JOIN sc2 USING (delay)),
 fo AS (SELECT asset, unnest([0, 1, 2, 3]) AS fold, greatest(max(total) // 5, 1) AS block FROM p GROUP BY asset), ks AS (SELECT DISTINCT variant, scenario, asset FROM net),
 g AS (SELECT ks.*, fold, count(*) FILTER (WHERE pos + 1 + 24 + 6 <= block * (1 + fold)) AS train_n, avg(net) FILTER (WHERE pos + 1 + 24 + 6 <= block * (1 + fold)) AS train_mean, count(*) FILTER (WHERE pos >= block * (1 + fold) AND pos < block * (2 + fold)) AS n, count(*) FILTER (WHERE pos >= block * (1 + fold) AND pos < block * (2 + fold) AND side = 1) AS longs, avg(net) FILTER (WHERE pos >= block * (1 + fold) AND pos < block * (2 + fold)) AS mean_net, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE pos >= block * (1 + fold) AND pos < block * (2 + fold)) AS win_rate FROM ks JOIN fo USING (asset) JOIN net USING (variant, scenario, asset) GROUP BY ALL)"""


@add("I17_strategy_walk_forward", with_("b1", more=PATHS) + "SELECT variant, scenario, asset, fold, train_n, round(train_mean, 8) AS train_mean, n, longs, round(mean_net, 8) AS mean_net, round(win_rate, 8) AS win_rate, train_mean IS NOT NULL AND row_number() OVER (PARTITION BY scenario, asset, fold ORDER BY round(train_mean, 10) DESC NULLS LAST, variant) = 1 AS chosen FROM g")
def i17(spark, d):
    """Each bar signals its own direction; three scales of the exits, all cost and delay scenarios, four anchored folds."""
    b = t.bars(spark, d)
    side = F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1)
    signals = b.select("asset", "event_time", side.alias("side")).filter("side is not null")
    variants = spark.createDataFrame([("down", 0.045, 0.09), ("normal", 0.05, 0.1), ("up", 0.055, 0.11)], "variant string, stop double, target double")
    folds = inf.simple_folds(b, folds=4, purge=24, embargo=6)
    out = strategy.walk_forward_outcomes(stash(folds, "folds"), signals, variants, sc.scenarios(spark), delays=(0, 1, 2), horizon_hours=24)
    return out.select("variant", "scenario", "asset", "fold", "train_n", r8("train_mean"), "n", "longs", r8("mean_net"), r8("win_rate"), "chosen")


REVIEW = """d AS (SELECT run_id, CAST(slot AS TIMESTAMP) AS slot, seq, equity_after FROM decisions), l AS (SELECT run_id, min(slot) AS f, max(slot) AS e, max(equity_after) AS high_water_mark, arg_max(equity_after, (slot, seq)) AS current_equity, count(*) FILTER (WHERE equity_after < 1000) AS breaches FROM d GROUP BY run_id),
 dl AS (SELECT l.run_id, coalesce(arg_max(equity_after, (slot, seq)) FILTER (WHERE slot < date_trunc('day', e)), arg_min(equity_after, (slot, seq)) FILTER (WHERE slot >= date_trunc('day', e))) AS s FROM l JOIN d ON d.run_id = l.run_id GROUP BY l.run_id),
 sl AS (SELECT DISTINCT run_id, CAST(slot AS DATE) AS day FROM d), gp AS (SELECT run_id, day, date_diff('day', lag(day) OVER (PARTITION BY run_id ORDER BY day), day) - 1 AS gap, lag(day) OVER (PARTITION BY run_id ORDER BY day) AS p FROM sl),
 ms AS (SELECT run_id, coalesce(sum(gap), 0) AS missing_slots, min(CASE WHEN gap > 0 THEN p + INTERVAL 1 DAY END) AS first_missing FROM gp GROUP BY run_id)"""


@add("I18_paper_readiness", with_("decisions", more=REVIEW) + f"SELECT l.run_id, round(date_diff('second', f, e) / 86400, 1) AS completed_days, missing_slots, {tsq('first_missing')}, round(current_equity, 8) AS current_equity, round(high_water_mark, 8) AS high_water_mark, round(greatest(s - current_equity, 0), 8) AS daily_loss, breaches, date_diff('second', f, e) >= 30 * 86400 AND breaches = 0 AND missing_slots = 0 AS review_ready FROM l JOIN dl ON dl.run_id = l.run_id JOIN ms ON ms.run_id = l.run_id")
def i18(spark, d):
    out = strategy.review_summary(t.decisions(spark, d), floor=1000.0)
    return out.select("run_id", "completed_days", "missing_slots", ts("first_missing"), r8("current_equity"), r8("high_water_mark"), r8("daily_loss"), "breaches", "review_ready")


@add("K1_factor_registry", with_("b4") + f"SELECT asset, {tsq('event_time')}, round(close / nullif(lag(close, 6) OVER w, 0) - 1, 8) AS momentum, round(-(close / nullif(lag(close, 3) OVER w, 0) - 1), 8) AS reversal FROM b4 WINDOW w AS (PARTITION BY asset ORDER BY event_time)")
def k1(spark, d):
    from asofly.functions.registry import Registry

    reg = Registry()
    reg.add("momentum", ["close"], lambda: fx.momentum("close", 6), before=6)
    reg.add("reversal", ["close"], lambda: fx.reversal("close", 3), before=3)
    return reg.compute(t.bars(spark, d, 4), ["momentum", "reversal"]).select("asset", ts("event_time"), r8("momentum"), r8("reversal"))


def _candidate_sql():
    """SQL of the twenty candidates: five templates for each of the first four windows."""
    out = []
    for n in (6, 12, 24, 48):
        w = f"OVER (PARTITION BY asset ORDER BY event_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        whole = lambda c, x: f"CASE WHEN count({c}) {w} = {n} THEN {x} END"  # noqa: B023, E731
        out.append(f"close / nullif(lag(close, {n}) OVER (PARTITION BY asset ORDER BY event_time), 0) - 1")
        out.append(whole("close", f"stddev_samp(close) {w}"))
        out.append(whole("volume", f"avg(volume) {w}"))
        out.append(whole("close", f"(close - avg(close) {w}) / nullif(stddev_samp(close) {w}, 0)"))
        out.append(whole("close", f"(len(list_filter(list(close) {w}, lambda v: v < close)) + (len(list_filter(list(close) {w}, lambda v: v = close)) + 1) / 2) / {n}"))
    return ", ".join(f"round({x}, 8) AS f{i}" for i, x in enumerate(out))


@add("K2_generated_factors", with_("b4") + f"SELECT asset, {tsq('event_time')}, {_candidate_sql()} FROM b4")
def k2(spark, d):
    """The candidates of the whole search space (five windows, trees up to depth 3), of which twenty are kept."""
    from asofly.functions.registry import SearchSpace, candidates

    found = candidates(SearchSpace())
    out = evaluate(t.bars(spark, d, 4), {f"f{i}": c.tree for i, c in enumerate(found)})
    return out.select("asset", ts("event_time"), *(r8(f"f{i}") for i in range(len(found))))


@add("K3_user_statistic")
def k3(spark, d):
    return bootstrap.circular_bootstrap(_returns(spark, d, "r"), "r", np.median, column=F.median, block=24, samples=100, seed=7).select("asset", r8("low"), r8("high"), "samples")
