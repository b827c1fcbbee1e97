"""Grids, interval joins, indicators and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofly.functions import factors as fx
from asofly.functions import patterns
from asofly.operators import asof, indicators, joins
from asofly.operators.timeblocks import in_blocks
from asofly.queries.base import add, r8, rq, ts, tsq, with_
from asofly.queries.core import VIEWS
from asofly.sources import tables as t

WIN = "WINDOW w AS (PARTITION BY asset ORDER BY event_time)"


@add("C9_source_plan", """WITH a AS (SELECT DISTINCT event_type AS asset FROM events), p AS (SELECT asset, 'bars' AS dataset, 'day' AS granularity, CAST(x AS DATE) AS period FROM a, (SELECT unnest(generate_series(TIMESTAMP '2023-11-15', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS x)
 UNION ALL SELECT asset, 'funding', 'month', CAST(x AS DATE) FROM a, (SELECT unnest(generate_series(TIMESTAMP '2023-11-01', TIMESTAMP '2024-02-10', INTERVAL 1 MONTH)) AS x))
SELECT dataset || '|' || asset || '|' || granularity || '|' || CASE WHEN granularity = 'month' THEN strftime(period, '%Y-%m') ELSE strftime(period, '%Y-%m-%d') END AS identity FROM p""")
def c9(spark, d):
    assets = t.read(spark, d, "events").select(F.col("event_type").alias("asset")).distinct()
    return joins.source_plan(assets, [("bars", "day"), ("funding", "month")], "2023-11-15", "2024-02-10").select("identity")


@add("C10_pre_listing_split", """WITH b AS (SELECT event_type AS asset, CAST(min(ts) AS DATE) AS first_period FROM events WHERE event_type <> 'click' GROUP BY 1), a AS (SELECT DISTINCT event_type AS asset FROM events), p AS (SELECT asset, CAST(x AS DATE) AS period FROM a, (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-01-10', INTERVAL 1 DAY)) AS x))
SELECT p.asset, CASE WHEN first_period IS NULL THEN 'BOUNDARY_MISSING' WHEN period < first_period THEN 'PRE_LISTING_EXCLUDED' ELSE 'KEEP' END AS status, count(*) AS n FROM p LEFT JOIN b USING (asset) GROUP BY ALL""")
def c10(spark, d):
    e = t.read(spark, d, "events")
    assets = e.select(F.col("event_type").alias("asset")).distinct()
    bounds = e.filter("event_type <> 'click'").groupBy(F.col("event_type").alias("asset")).agg(F.to_date(F.min("ts")).alias("first_period"))
    return joins.pre_listing(joins.source_plan(assets, [("bars", "day")], "2023-12-20", "2024-01-10"), bounds).groupBy("asset", "status").agg(F.count(F.lit(1)).alias("n"))


@add("C11_grid_faults", with_("b1", more="""o AS (SELECT asset, event_time FROM b1 UNION ALL SELECT asset, event_time FROM b1 WHERE trades > 5 UNION ALL SELECT 'ghost', event_time FROM b1 WHERE asset = 'click' AND trades > 5),
 x AS (SELECT a.asset, h.event_time FROM (SELECT DISTINCT asset FROM b1) a, (SELECT DISTINCT event_time FROM b1) h), n AS (SELECT asset, event_time, count(*) AS n FROM o GROUP BY ALL)""") + f"SELECT asset, {tsq('event_time')}, 'MISSING' AS fault FROM x WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.asset = x.asset AND n.event_time = x.event_time) UNION ALL SELECT asset, {tsq('event_time')}, 'UNEXPECTED' FROM n WHERE asset = 'ghost' UNION ALL SELECT asset, {tsq('event_time')}, 'DUPLICATE' FROM n WHERE n > 1")
def c11(spark, d):
    b = t.bars(spark, d).select("asset", "event_time", "trades")
    seen = b.drop("trades").unionByName(b.filter("trades > 5").drop("trades")).unionByName(b.filter("trades > 5 and asset = 'click'").select(F.lit("ghost").alias("asset"), "event_time"))
    return joins.calendar_faults(b.select("asset"), b.select("event_time"), seen).select("asset", ts("event_time"), "fault")


@add("C12_delay_columns", with_("b1", "oi", more=VIEWS + ", j AS (SELECT b.asset, b.delay, b.event_time, v.open_interest FROM (SELECT b1.*, delay FROM b1 CROSS JOIN (VALUES (5), (10), (15)) x(delay)) b ASOF LEFT JOIN views v ON b.delay = v.delay AND b.asset = v.asset AND b.available_time >= v.available_time)") + f"SELECT asset, {tsq('event_time')}, {', '.join(f'round(max(CASE WHEN delay = {k} THEN open_interest END), 8) AS oi_{k}m' for k in (5, 10, 15))} FROM j GROUP BY asset, event_time")
def c12(spark, d):
    views = asof.delay_views(t.open_interest(spark, d), (5, 10, 15), "2024-01-20 00:00:00")
    return joins.delay_columns(asof.asof_by_delay(t.bars(spark, d), views, (5, 10, 15)), [5, 10, 15]).select("asset", ts("event_time"), *(r8(f"oi_{k}m") for k in (5, 10, 15)))


SIG = "s AS (SELECT asset, event_time, 1 AS side, close * 0.9 AS stop, close * 1.1 AS target FROM b1)"


def _signals(b):
    return b.select("asset", "event_time", F.lit(1).alias("side"), (F.col("close") * 0.9).alias("stop"), (F.col("close") * 1.1).alias("target"))


@add("C13_first_touch", with_("b1", more=SIG + """, j AS (SELECT s.asset, s.event_time, b.event_time AS t, b.close, s.stop, s.target, CASE WHEN b.low <= s.stop THEN 'STOP' WHEN b.high >= s.target THEN 'TARGET' END AS o FROM s JOIN b1 b ON b.asset = s.asset AND b.event_time > s.event_time AND b.event_time <= s.event_time + INTERVAL 24 HOUR)""") + f"""SELECT asset, {tsq('event_time')}, coalesce(arg_min(o, t) FILTER (WHERE o IS NOT NULL), 'OPEN') AS outcome,
 round(coalesce(arg_min(CASE WHEN o = 'STOP' THEN stop ELSE target END, t) FILTER (WHERE o IS NOT NULL), arg_max(close, t)), 8) AS exit_price, {tsq('coalesce(min(t) FILTER (WHERE o IS NOT NULL), max(t))', 'exit_time')} FROM j GROUP BY asset, event_time""")
def c13(spark, d):
    b = t.bars(spark, d)
    return joins.first_touch(_signals(b), b, horizon_hours=24).select("asset", ts("event_time"), "outcome", r8("exit_price"), ts("exit_time"))


@add("C14_funding_cashflow", with_("funding") + "SELECT p.event_id AS position_id, round(sum(-p.value * CASE WHEN p.event_id % 2 = 0 THEN 1 ELSE -1 END * f.funding_rate), 10) AS cashflow, count(*) AS events FROM events p JOIN funding f ON f.asset = p.event_type AND f.event_time >= p.ts AND f.event_time <= p.ts + INTERVAL 36 HOUR GROUP BY 1")
def c14(spark, d):
    p = t.read(spark, d, "events").select(F.col("event_id").alias("position_id"), F.col("event_type").alias("asset"), F.col("ts").alias("entry"), F.expr("ts + interval 36 hours").alias("exit"), F.col("value").alias("notional"), F.expr("if(event_id % 2 = 0, 1, -1)").alias("sign"))
    return joins.funding_cashflow(p, t.funding(spark, d)).select("position_id", F.round("cashflow", 10).alias("cashflow"), "events")


@add("C15_dependent_slices", """WITH s AS (SELECT event_type AS asset, user_id % 400 AS slice_id, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS bar FROM events) SELECT DISTINCT x.asset, x.slice_id, y.slice_id AS other FROM s x JOIN s y ON x.asset = y.asset AND x.bar = y.bar AND x.slice_id < y.slice_id""")
def c15(spark, d):
    s = t.read(spark, d, "events").groupBy(F.col("event_type").alias("asset"), (F.col("user_id") % 400).alias("slice_id")).agg(F.collect_set(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800)).alias("bars"))
    return joins.dependent_slices(s)


@add("C16_missing_slots", f"""WITH s AS (SELECT event_type AS run_id, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS s, epoch(ts) - 1800 * floor(epoch(ts) / 1800) AS late FROM events), b AS (SELECT run_id, min(s) AS a, max(s) AS z FROM s GROUP BY 1), g AS (SELECT run_id, unnest(generate_series(a + 1, z - 1)) AS s FROM b)
SELECT run_id, {tsq("TIMESTAMP '1970-01-01' + g.s * INTERVAL 30 MINUTE", 'slot')} FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.run_id = g.run_id AND s.s = g.s AND late <= 300)""")
def c16(spark, d):
    e = t.read(spark, d, "events").select(F.col("event_type").alias("run_id"), F.col("ts").alias("slot"))
    return joins.missing_slots(e, hours=0.5, grace_minutes=5).select("run_id", ts("slot"))


@add("C17_lineage_preflight", "SELECT l.l_orderkey AS identity, CASE WHEN count(o.o_orderkey) = 0 THEN 'MISSING' WHEN count(o.o_orderkey) > 1 THEN 'AMBIGUOUS' ELSE 'OK' END AS status FROM (SELECT DISTINCT l_orderkey FROM lineitem) l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0) o ON o.o_orderkey = l.l_orderkey GROUP BY 1")
def c17(spark, d):
    cat = t.read(spark, d, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("identity"))
    return joins.lineage_status(t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("identity")).distinct(), cat.unionByName(cat.filter("identity % 5 = 0")), ["identity"])


@add("C18_next_bar_fill", with_("b1", more="f AS (SELECT asset, event_time, lead(open) OVER w AS fill_price, lead(event_time) OVER w AS fill_time FROM b1 WINDOW w AS (PARTITION BY asset ORDER BY event_time)), s AS (SELECT event_id AS signal_id, event_type AS asset, CASE WHEN event_id % 9 = 0 THEN date_trunc('hour', ts) + INTERVAL 1 MINUTE ELSE date_trunc('hour', ts) END AS event_time FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY asset, event_time ORDER BY signal_id) AS rn FROM s)") + "SELECT signal_id, CASE WHEN rn > 1 THEN 'DUPLICATE_SIGNAL' WHEN f.asset IS NULL THEN 'TIMESTAMP_NOT_IN_BARS' WHEN f.fill_time IS NULL THEN 'NO_NEXT_BAR' END AS reason, CASE WHEN rn = 1 AND f.asset IS NOT NULL AND f.fill_time IS NOT NULL THEN round(f.fill_price, 8) END AS fill_price FROM r LEFT JOIN f ON f.asset = r.asset AND f.event_time = r.event_time")
def c18(spark, d):
    s = t.read(spark, d, "events").select(F.col("event_id").alias("signal_id"), F.col("event_type").alias("asset"), F.expr("if(event_id % 9 = 0, date_trunc('hour', ts) + interval 1 minute, date_trunc('hour', ts))").cast("timestamp_ntz").alias("event_time"))
    return joins.next_bar_fill(s, t.bars(spark, d)).select("signal_id", "reason", r8("fill_price"))


@add("C19_blockers", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def c19(spark, d):
    excluded = t.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.read(spark, d, "lineitem").filter("l_returnflag = 'R'").join(excluded, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@add("C20_common_index", with_("b1") + f"SELECT {tsq('event_time')}, count(DISTINCT asset) AS present FROM b1 GROUP BY event_time HAVING count(DISTINCT asset) <> 5")
def c20(spark, d):
    return joins.uncommon_times(t.bars(spark, d), 5).select(ts("event_time"), "present")


def _ewm_sql(x, alpha):
    return f"list_reduce(list({x}) OVER (PARTITION BY asset ORDER BY event_time), lambda y, v: y + {alpha} * (v - y))"


TR = "tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM b1 WINDOW w AS (PARTITION BY asset ORDER BY event_time))"


@add("E17_ema", with_("b1") + f"SELECT asset, {tsq('event_time')}, round({_ewm_sql('close', 2 / 21)}, 8) AS ema20, round({_ewm_sql('close', 2 / 201)}, 8) AS ema200 FROM b1")
def e17(spark, d):
    return indicators.emas(t.bars(spark, d), "close", {"ema20": 20, "ema200": 200}).select("asset", ts("event_time"), r8("ema20"), r8("ema200"))


@add("E18_sma_atr", with_("b1", more=TR) + f"SELECT asset, {tsq('event_time')}, CASE WHEN count(close) OVER v = 20 THEN round(avg(close) OVER v, 8) END AS sma20, round({_ewm_sql('tr', 1 / 14)}, 8) AS atr14 FROM tr WINDOW v AS (PARTITION BY asset ORDER BY event_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def e18(spark, d):
    out = in_blocks(t.bars(spark, d), lambda f: f.withColumns({"sma20": indicators.sma("close", 20), "_tr": indicators.true_range()}), before=20)
    return indicators.ewm(out, "_tr", 1 / 14, "atr14").select("asset", ts("event_time"), r8("sma20"), r8("atr14"))


SW = "sw AS (SELECT *, CASE WHEN count(*) OVER v = 7 AND low = min(low) OVER v THEN -1 WHEN count(*) OVER v = 7 AND high = max(high) OVER v THEN 1 ELSE 0 END AS swing FROM b1 WINDOW v AS (PARTITION BY asset ORDER BY event_time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"


@add("E25_swing_points", with_("b1", more=SW) + f"SELECT asset, {tsq('event_time')}, swing, coalesce(lag(swing, 3) OVER (PARTITION BY asset ORDER BY event_time), 0) AS confirmed FROM sw")
def e25(spark, d):
    both = {"swing": indicators.swings(3), "confirmed": indicators.swings(3, confirmed=True)}
    return in_blocks(t.bars(spark, d), lambda f: f.withColumns(both), before=6, after=3).select("asset", ts("event_time"), "swing", "confirmed")


@add("E26_trend_state", with_("b1", more=f"e AS (SELECT *, {_ewm_sql('close', 2 / 21)} AS f, {_ewm_sql('close', 2 / 51)} AS s FROM b1)") + f"SELECT asset, {tsq('event_time')}, CASE WHEN close > f AND f > s THEN 1 WHEN close < f AND f < s THEN -1 ELSE 0 END AS trend FROM e")
def e26(spark, d):
    out = indicators.emas(t.bars(spark, d), "close", {"f": 20, "s": 50})
    return out.select("asset", ts("event_time"), indicators.trend("f", "s").alias("trend"))


ATR = TR + f", a AS (SELECT *, {_ewm_sql('tr', 1 / 14)} AS atr FROM tr)"
PIN = "CASE WHEN high > low AND abs(close - open) <= (high - low) * 0.35 AND least(open, close) - low >= atr * 0.6 AND least(open, close) - low > high - greatest(open, close) THEN 1 WHEN high > low AND abs(close - open) <= (high - low) * 0.35 AND high - greatest(open, close) >= atr * 0.6 AND high - greatest(open, close) > least(open, close) - low THEN -1 ELSE 0 END"
ENGULF = "CASE WHEN close > open AND pc < po AND close > po AND open < pc THEN 1 WHEN close < open AND pc > po AND close < po AND open > pc THEN -1 ELSE 0 END"


@add("E27_pin_bar", with_("b1", more=ATR) + f"SELECT asset, {tsq('event_time')}, {PIN} AS pin FROM a")
def e27(spark, d):
    return indicators.atr(t.bars(spark, d)).select("asset", ts("event_time"), patterns.pin_bar("atr").alias("pin"))


@add("E28_engulfing", with_("b1", more="x AS (SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc FROM b1 WINDOW w AS (PARTITION BY asset ORDER BY event_time))") + f"SELECT asset, {tsq('event_time')}, {ENGULF} AS engulfing FROM x")
def e28(spark, d):
    return in_blocks(t.bars(spark, d), lambda f: f.withColumn("engulfing", patterns.engulfing()), before=1).select("asset", ts("event_time"), "engulfing")


@add("E29_inside_bar", with_("b1") + f"SELECT asset, {tsq('event_time')}, CASE WHEN high <= lag(high) OVER w AND low >= lag(low) OVER w THEN 1 ELSE 0 END AS inside FROM b1 {WIN}")
def e29(spark, d):
    return in_blocks(t.bars(spark, d), lambda f: f.withColumn("inside", patterns.inside_bar()), before=1).select("asset", ts("event_time"), "inside")


BOS = SW + """, lv AS (SELECT *, last_value(CASE WHEN swing = 1 THEN high END IGNORE NULLS) OVER w AS h, last_value(CASE WHEN swing = -1 THEN low END IGNORE NULLS) OVER w AS l FROM sw WINDOW w AS (PARTITION BY asset ORDER BY event_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 st AS (SELECT *, CASE WHEN close > lag(h) OVER w THEN 1 WHEN close < lag(l) OVER w THEN -1 ELSE 0 END AS b FROM lv WINDOW w AS (PARTITION BY asset ORDER BY event_time))"""


@add("E30_break_of_structure", with_("b1", more=BOS) + f"SELECT asset, {tsq('event_time')}, coalesce(greatest(least(b - lag(b) OVER w, 1), -1), 0) AS bos FROM st {WIN}")
def e30(spark, d):
    return indicators.break_of_structure(t.bars(spark, d), 3).select("asset", ts("event_time"), "bos")


CONF = BOS + f""", bo AS (SELECT *, coalesce(greatest(least(b - lag(b) OVER w, 1), -1), 0) AS bos, lag(open) OVER w AS po, lag(close) OVER w AS pc, lead(open) OVER w AS entry, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM st {WIN}),
 em AS (SELECT *, {_ewm_sql('close', 2 / 21)} AS f, {_ewm_sql('close', 2 / 51)} AS s, {_ewm_sql('close', 2 / 201)} AS m, {_ewm_sql('tr', 1 / 14)} AS atr FROM bo),
 pt AS (SELECT *, {PIN} AS pin, {ENGULF} AS eng, CASE WHEN close > f AND f > s THEN 1 WHEN close < f AND f < s THEN -1 ELSE 0 END AS trend FROM em),
 sg AS (SELECT *, CASE WHEN close > m AND trend = 1 AND atr / nullif(close, 0) BETWEEN 0.05 AND 5.0 AND (pin = 1 OR eng = 1 OR bos = 1) THEN 1 WHEN close < m AND trend = -1 AND atr / nullif(close, 0) BETWEEN 0.05 AND 5.0 AND (pin = -1 OR eng = -1 OR bos = -1) THEN -1 ELSE 0 END AS signal FROM pt)"""


@add("E31_confluence_signals", with_("b1", more=CONF) + f"SELECT asset, {tsq('event_time')}, signal, round(entry, 8) AS entry, CASE WHEN signal <> 0 THEN round(entry - 1.5 * atr * signal, 6) END AS stop, CASE WHEN signal <> 0 THEN round(entry + 4.5 * atr * signal, 6) END AS target FROM sg")
def e31(spark, d):
    """The band is a parameter; these bars range far more widely than a market's, so it's wider than the default."""
    out = indicators.confluence(t.bars(spark, d), atr_band=(0.05, 5.0))
    return out.select("asset", ts("event_time"), "signal", r8("entry"), F.round("stop", 6).alias("stop"), F.round("target", 6).alias("target"))


@add("E33_last_momentum_signal", with_("b1", more="m AS (SELECT *, close / nullif(lag(close, 20) OVER (PARTITION BY asset ORDER BY event_time), 0) - 1 AS m, nullif(CAST(sign(close - lag(close, 20) OVER (PARTITION BY asset ORDER BY event_time)) AS INTEGER), 0) AS side, row_number() OVER (PARTITION BY asset ORDER BY event_time DESC) AS rn FROM b1)") + f"SELECT asset, {tsq('event_time')}, round(m, 8) AS momentum, side AS direction, round(close * (1 - side * 0.05), 8) AS stop, round(close * (1 + side * 0.10), 8) AS target FROM m WHERE rn = 1")
def e33(spark, d):
    return indicators.last_momentum_signal(t.bars(spark, d), 20).select("asset", ts("event_time"), r8("momentum"), "direction", r8("stop"), r8("target"))


LEVELS = SW + """, lv AS (SELECT asset, kind, level, row_number() OVER (PARTITION BY asset, kind ORDER BY level) AS rn FROM (SELECT asset, CASE swing WHEN 1 THEN 'resistance' ELSE 'support' END AS kind, CASE swing WHEN 1 THEN high ELSE low END AS level, row_number() OVER (PARTITION BY asset, swing ORDER BY event_time DESC) AS back FROM sw WHERE swing <> 0) WHERE back <= 50),
 gr AS (SELECT asset, kind, rn, 1 AS g, level AS total, 1 AS n FROM lv WHERE rn = 1 UNION ALL SELECT l.asset, l.kind, l.rn, CASE WHEN near THEN g ELSE g + 1 END, CASE WHEN near THEN total + l.level ELSE l.level END, CASE WHEN near THEN n + 1 ELSE 1 END
  FROM (SELECT l.*, gr.g, gr.total, gr.n, coalesce(abs(l.level - gr.total / gr.n) / nullif(gr.total / gr.n, 0) < 0.008, false) AS near FROM gr JOIN lv l ON l.asset = gr.asset AND l.kind = gr.kind AND l.rn = gr.rn + 1) l)"""


@add("I19_support_resistance", with_("b1", more=LEVELS).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT asset, kind, round(arg_max(total / n, rn), 6) AS mean, max(n) AS n FROM gr GROUP BY asset, kind, g")
def i19(spark, d):
    return indicators.support_resistance(t.bars(spark, d)).select("asset", "kind", F.round("mean", 6).alias("mean"), "n")


@add("G1_concat", with_("b1", "b4") + f"SELECT asset, {tsq('event_time')}, round(close, 8) AS close, 1 AS hours FROM b1 UNION ALL SELECT asset, {tsq('event_time')}, round(close, 8), 4 FROM b4")
def g1(spark, d):
    return t.bars(spark, d).withColumn("hours", F.lit(1)).unionByName(t.bars(spark, d, 4).withColumn("hours", F.lit(4)), allowMissingColumns=True).select("asset", ts("event_time"), r8("close"), "hours")


@add("G2_dedup_keep_first", "SELECT md5(text) AS identity, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def g2(spark, d):
    return t.read(spark, d, "documents").groupBy(F.md5("text").alias("identity")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@add("G3_expected_minus_observed", "SELECT o_custkey AS k, 'unobserved' AS side FROM (SELECT c_custkey AS o_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT o_orderkey, 'unexpected' FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)")
def g3(spark, d):
    a = t.read(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(t.read(spark, d, "orders").select("o_custkey")).withColumn("side", F.lit("unobserved"))
    b = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("k")).subtract(t.read(spark, d, "lineitem").select("l_orderkey")).withColumn("side", F.lit("unexpected"))
    return a.unionByName(b)


@add("G4_disjoint_split", with_("b1", more="p AS (SELECT asset, event_time, row_number() OVER (PARTITION BY asset ORDER BY event_time) AS rn, count(*) OVER (PARTITION BY asset) AS n FROM b1)") + "SELECT asset, count(*) FILTER (WHERE rn <= floor(0.8 * n)) AS research, count(*) FILTER (WHERE rn > floor(0.8 * n)) AS holdout, CAST(0 AS BIGINT) AS overlap FROM p GROUP BY asset")
def g4(spark, d):
    from asofly.operators.inference import research_holdout

    return research_holdout(t.bars(spark, d), 0.8)


@add("G5_lineage_sets_equal", "SELECT a.k, a.s = coalesce(b.s, []) AS equal FROM (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1) a LEFT JOIN (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem WHERE l_quantity > 3 GROUP BY 1) b ON a.k = b.k")
def g5(spark, d):
    li = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey", "l_quantity")
    return joins.same_sets(li, li.filter("l_quantity > 3"), ["k"], "l_suppkey")


@add("G6_index_union", with_("b4", more="a AS (SELECT asset, close AS w FROM b4 WHERE event_time = TIMESTAMP '2024-01-10' AND asset <> 'click'), b AS (SELECT asset, close AS w FROM b4 WHERE event_time = TIMESTAMP '2024-01-11' AND asset <> 'view')") + "SELECT coalesce(a.asset, b.asset) AS asset, round(coalesce(a.w, 0), 8) AS before, round(coalesce(b.w, 0), 8) AS after, round(abs(coalesce(b.w, 0) - coalesce(a.w, 0)), 8) AS turnover FROM a FULL JOIN b ON a.asset = b.asset")
def g6(spark, d):
    from asofly.operators.inference import weight_turnover

    at = lambda day, no: t.bars(spark, d, 4).filter(F.col("event_time") == F.lit(day).cast("timestamp_ntz")).filter(F.col("asset") != no).select("asset", F.col("close").alias("weight"))
    return weight_turnover(at("2024-01-10", "click"), at("2024-01-11", "view")).select("asset", r8("before"), r8("after"), r8("turnover"))
