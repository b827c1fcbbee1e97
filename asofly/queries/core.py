"""Point-in-time filters, as-of joins, resampling, factors and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asofly.functions import factors as fx
from asofly.operators import asof, filters, resample
from asofly.operators.rolling import rolling_rank
from asofly.operators.timeblocks import in_blocks, with_compounded, with_drawdown, with_episodes
from asofly.queries.base import add, r8, rq, ts, tsq, with_
from asofly.sources import tables as t

CUT = "2024-01-20 00:00:00"

def bar_columns():
    return ["asset", ts("event_time"), *(r8(c) for c in ("open", "high", "low", "close", "volume"))]


BARQ = f"asset, {tsq('event_time')}, {', '.join(rq(c) for c in ('open', 'high', 'low', 'close', 'volume'))}"


@add("B1_as_known_at", with_("b1") + f"SELECT {BARQ} FROM b1 WHERE available_time <= TIMESTAMP '{CUT}'")
def b1(spark, d):
    return filters.as_known_at(t.bars(spark, d), CUT).select(*bar_columns())


@add("B2_evidence_cutoff", with_("b1") + f"""SELECT asset AS source, count(*) FILTER (WHERE event_time <= TIMESTAMP '{CUT}' AND available_time <= TIMESTAMP '{CUT}') AS eligible,
 count(*) FILTER (WHERE NOT (event_time <= TIMESTAMP '{CUT}' AND available_time <= TIMESTAMP '{CUT}')) AS excluded,
 {tsq(f"min(event_time) FILTER (WHERE NOT (event_time <= TIMESTAMP '{CUT}' AND available_time <= TIMESTAMP '{CUT}'))", 'first_event')},
 {tsq(f"max(event_time) FILTER (WHERE NOT (event_time <= TIMESTAMP '{CUT}' AND available_time <= TIMESTAMP '{CUT}'))", 'last_event')},
 {tsq(f"min(available_time) FILTER (WHERE NOT (event_time <= TIMESTAMP '{CUT}' AND available_time <= TIMESTAMP '{CUT}'))", 'first_available')},
 {tsq(f"max(available_time) FILTER (WHERE NOT (event_time <= TIMESTAMP '{CUT}' AND available_time <= TIMESTAMP '{CUT}'))", 'last_available')}
 FROM b1 GROUP BY asset""")
def b2(spark, d):
    _, excluded = filters.evidence_cutoff(t.bars(spark, d).withColumn("source", F.col("asset")), CUT)
    return excluded.select("source", "eligible", "excluded", *(ts(c) for c in ("first_event", "last_event", "first_available", "last_available")))


@add("B3_strict_point_in_time", with_("b1") + f"SELECT {BARQ} FROM b1 WHERE event_time < TIMESTAMP '{CUT}' AND available_time <= TIMESTAMP '{CUT}'")
def b3(spark, d):
    return filters.strictly_before(t.bars(spark, d), CUT).select(*bar_columns())


@add("B4_development_window", with_("b1") + f"SELECT {BARQ} FROM b1 WHERE event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '{CUT}'")
def b4(spark, d):
    return filters.window(t.bars(spark, d), "2024-01-05", CUT).select(*bar_columns())


@add("B5_three_way_split", with_("b1") + "SELECT asset, " + tsq("event_time") + """, CASE WHEN event_time >= TIMESTAMP '2024-01-02' AND event_time < TIMESTAMP '2024-01-15' THEN 'development'
 WHEN event_time >= TIMESTAMP '2024-01-15' AND event_time < TIMESTAMP '2024-01-20' THEN 'buffer' WHEN event_time >= TIMESTAMP '2024-01-20' AND event_time <= TIMESTAMP '2024-01-28' THEN 'holdout' END AS role FROM b1""")
def b5(spark, d):
    return t.bars(spark, d).select("asset", ts("event_time"), filters.role(F.col("event_time"), "2024-01-02", "2024-01-15", "2024-01-20", "2024-01-28").alias("role"))


@add("B6_record_violations", """WITH rec AS (SELECT event_id, ts AS e, CASE WHEN event_id % 11 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts + INTERVAL 1 MINUTE END AS a, CASE WHEN event_id % 7 = 0 THEN ts ELSE ts + INTERVAL 2 MINUTE END AS i FROM events)
SELECT 'record' AS kind, event_id, concat_ws(',', CASE WHEN event_id % 17 = 0 THEN 'TIME_WITHOUT_ZONE' END, CASE WHEN date_trunc('second', a) < date_trunc('second', e) THEN 'AVAILABLE_BEFORE_EVENT' END, CASE WHEN date_trunc('second', i) < date_trunc('second', a) THEN 'INGESTED_BEFORE_AVAILABLE' END, CASE WHEN event_id % 13 = 0 THEN 'SOURCE_BLANK' END) AS violations FROM rec WHERE event_id % 17 = 0 OR date_trunc('second', a) < date_trunc('second', e) OR date_trunc('second', i) < date_trunc('second', a) OR event_id % 13 = 0
 UNION ALL SELECT 'manifest', event_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'HASH_FORMAT' END, CASE WHEN event_id % 19 = 0 THEN 'ROW_COUNT_NEGATIVE' END, CASE WHEN event_id % 23 = 0 THEN 'EVENT_RANGE' END, CASE WHEN event_id % 29 = 0 THEN 'AVAILABLE_RANGE' END, CASE WHEN event_id % 31 = 0 THEN 'OWN_PARENT' END) FROM events WHERE event_id % 5 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 OR event_id % 29 = 0 OR event_id % 31 = 0
 UNION ALL SELECT 'signal', event_id, concat_ws(',', CASE WHEN value / 100 > 1 THEN 'VALUE_RANGE' END, CASE WHEN value / 50 > 1 THEN 'CONFIDENCE_RANGE' END, CASE WHEN event_id % 37 = 0 THEN 'NOT_AVAILABLE_AT_DECISION' END) FROM events WHERE value / 50 > 1 OR event_id % 37 = 0""")
def b6(spark, d):
    e = t.read(spark, d, "events")
    zoned = lambda c, name: F.concat(F.date_format(F.expr(c), "yyyy-MM-dd HH:mm:ss"), F.when((F.col("event_id") % 17 == 0) & F.lit(name == "event_time"), "").otherwise("+00:00")).alias(name)
    records = e.select("event_id", F.col("event_type").alias("asset"), zoned("ts", "event_time"), zoned("if(event_id % 11 = 0, ts - interval 1 minute, ts + interval 1 minute)", "available_time"), zoned("if(event_id % 7 = 0, ts, ts + interval 2 minutes)", "ingested_at"), F.expr("if(event_id % 13 = 0, '  ', event_type)").alias("source"))
    sha = F.sha2(F.col("event_id").cast("string"), 256)
    back = lambda k, c: F.expr(f"if(event_id % {k} = 0, ts + interval 1 second, ts)").alias(c)
    manifests = e.select(
        "event_id", sha.alias("snapshot_id"), F.when(F.col("event_id") % 5 == 0, F.upper(F.concat(F.lit("a"), F.substring(sha, 2, 63)))).otherwise(sha).alias("content_sha256"), F.expr("if(event_id % 19 = 0, -1, 1)").alias("row_count"),
        back(23, "min_event_time"), F.col("ts").alias("max_event_time"), back(29, "min_available_time"), F.col("ts").alias("max_available_time"), F.array(F.when(F.col("event_id") % 31 == 0, sha).otherwise("root")).alias("parents"),
    )
    signals = e.select("event_id", (F.col("value") / 100).alias("value"), (F.col("value") / 50).alias("confidence"), back(37, "available_time"), F.col("ts").alias("decision_time"))
    found = [("record", filters.record_violations(records)), ("manifest", filters.manifest_violations(manifests)), ("signal", filters.signal_violations(signals))]
    one = [f.filter(F.size("violations") > 0).select(F.lit(kind).alias("kind"), "event_id", F.concat_ws(",", "violations").alias("violations")) for kind, f in found]
    return one[0].unionByName(one[1]).unionByName(one[2])


@add("B7_frame_validation", with_("b1") + """, dup AS (SELECT count(*) AS n FROM (SELECT 1 FROM b1 GROUP BY asset, event_time HAVING count(*) > 1))
SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_time IS NULL OR available_time IS NULL) AS bad_times, count(*) FILTER (WHERE available_time < event_time) AS not_causal,
 count(*) FILTER (WHERE NOT close > 0) AS bad_close, count(*) FILTER (WHERE volume < 40) AS bad_volume, (SELECT n FROM dup) AS duplicate_keys FROM b1""")
def b7(spark, d):
    return filters.frame_violations(t.bars(spark, d), least_volume=40.0)


@add("B9_causal_sources", with_("b24") + f"""SELECT asset, {tsq('event_time')} FROM b24 WHERE available_time <= TIMESTAMP '{CUT}' AND asset || '|' || strftime(event_time, '%Y-%m-%d') NOT IN
 (SELECT event_type || '|' || strftime(date_trunc('day', ts), '%Y-%m-%d') FROM events WHERE event_id % 97 = 0)""")
def b9(spark, d):
    gone = t.read(spark, d, "events").filter("event_id % 97 = 0").select(F.concat_ws("|", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("identity"))
    plan = t.bars(spark, d, 24).withColumn("identity", F.concat_ws("|", "asset", F.date_format("event_time", "yyyy-MM-dd")))
    return filters.causal_sources(plan, gone, CUT).select("asset", ts("event_time"))


@add("B10_records_through", with_("members") + f"SELECT asset, {tsq('selection_time')}, rank FROM members WHERE selection_time <= TIMESTAMP '{CUT}'")
def b10(spark, d):
    return t.membership(spark, d).filter(F.col("selection_time") <= F.lit(CUT).cast("timestamp_ntz")).select("asset", ts("selection_time"), "rank")


@add("B12_period_membership", """WITH m AS (SELECT event_type || '|' || strftime(ts, '%Y-%m-%d') AS identity, date_trunc('day', ts) AS s, date_trunc('day', ts) + INTERVAL 1 DAY AS e, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') + CASE WHEN event_type < 'm' THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END + CASE WHEN event_id % 101 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS stamp FROM events),
 g AS (SELECT identity, count(*) FILTER (WHERE stamp >= s AND stamp < e) AS left_closed, count(*) FILTER (WHERE stamp > s AND stamp <= e + INTERVAL 1 SECOND) AS right_closed, count(*) AS n_rows FROM m GROUP BY identity)
SELECT identity, left_closed, right_closed, CASE WHEN right_closed > left_closed THEN 'right' ELSE 'left' END AS membership, greatest(left_closed, right_closed) AS kept, n_rows - greatest(left_closed, right_closed) AS outside FROM g""")
def b12(spark, d):
    """Metrics on a grid of five minutes: some sources stamp its end, others its start; a few rows are of other days."""
    at = F.window("ts", "5 minutes")["start"]
    late = F.when(F.col("event_type") < "m", F.expr("interval 5 minutes")).otherwise(F.expr("interval 0 minutes"))
    e = t.read(spark, d, "events").select(
        F.concat_ws("|", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("identity"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("period_start"), F.expr("date_trunc('day', ts) + interval 1 day").cast("timestamp_ntz").alias("period_end"),
        (at.cast("timestamp_ntz") + late + F.expr("make_dt_interval(if(event_id % 101 = 0, 2, 0))")).alias("event_time"),
    )
    return filters.period_membership(e).select("identity", "left_closed", "right_closed", "membership", "kept", "outside")


@add("C1_asof_join", with_("b1", "funding") + f"SELECT b.asset, {tsq('b.event_time', 'event_time')}, {tsq('f.available_time', 'aux_available_time')}, {rq('f.funding_rate', 'funding_rate')} FROM b1 b ASOF LEFT JOIN funding f ON b.asset = f.asset AND b.available_time >= f.available_time")
def c1(spark, d):
    return asof.asof_join(t.bars(spark, d), t.funding(spark, d), by=["asset"], columns=["funding_rate"]).select("asset", ts("event_time"), ts("aux_available_time"), r8("funding_rate"))


@add("C2_snapshot", with_("b1", "funding", "oi") + f"""SELECT x.asset, {tsq('x.event_time', 'event_time')}, {rq('x.close', 'close')}, {rq('x.funding_rate', 'funding_rate')}, {tsq('o.available_time', 'oi_available_time')}, {rq('o.open_interest', 'open_interest')}
 FROM (SELECT b.*, f.funding_rate FROM b1 b ASOF LEFT JOIN funding f ON b.asset = f.asset AND b.available_time >= f.available_time) x ASOF LEFT JOIN oi o ON x.asset = o.asset AND x.available_time >= o.available_time""")
def c2(spark, d):
    return asof.snapshot(t.bars(spark, d), t.funding(spark, d), t.open_interest(spark, d)).select("asset", ts("event_time"), r8("close"), r8("funding_rate"), ts("oi_available_time"), r8("open_interest"))


@add("C3_staleness_bounded", with_("b1", "funding") + f"""SELECT b.asset, {tsq('b.event_time', 'event_time')}, CASE WHEN b.available_time - f.available_time <= INTERVAL 8 HOUR THEN round(f.funding_rate, 8) END AS funding_rate,
 CASE WHEN b.asset NOT IN (SELECT asset FROM funding WHERE asset <> 'click') THEN 'FUNDING_ASSET_MISSING' WHEN f.available_time IS NULL OR b.available_time - f.available_time > INTERVAL 8 HOUR THEN 'FUNDING_UNAVAILABLE_OR_GAPPED' END AS funding_reason
 FROM b1 b ASOF LEFT JOIN (SELECT * FROM funding WHERE asset <> 'click') f ON b.asset = f.asset AND b.available_time >= f.available_time""")
def c3(spark, d):
    return asof.asof_funding(t.bars(spark, d), t.funding(spark, d).filter("asset <> 'click'")).select("asset", ts("event_time"), r8("funding_rate"), "funding_reason")


@add("C4_delayed_open_interest", with_("b1", "oi") + f"""SELECT b.asset, {tsq('b.event_time', 'event_time')}, CASE WHEN b.available_time - o.at <= INTERVAL 1 HOUR THEN round(o.open_interest, 8) END AS open_interest,
 CASE WHEN o.at IS NULL OR b.available_time - o.at > INTERVAL 1 HOUR THEN 'OI_UNAVAILABLE_OR_GAPPED' END AS oi_reason
 FROM b1 b ASOF LEFT JOIN (SELECT *, available_time + INTERVAL 10 MINUTE AS at FROM oi) o ON b.asset = o.asset AND b.available_time >= o.at""")
def c4(spark, d):
    return asof.asof_open_interest(t.bars(spark, d), t.open_interest(spark, d), minutes=15, bar_hours=1).select("asset", ts("event_time"), r8("open_interest"), "oi_reason")


VIEWS = f"views AS (SELECT asset, event_time, event_time + delay * INTERVAL 1 MINUTE AS available_time, open_interest, delay FROM oi CROSS JOIN (VALUES (5), (10), (15)) v(delay) WHERE event_time + delay * INTERVAL 1 MINUTE <= TIMESTAMP '{CUT}')"


@add("C5_delay_views", with_("oi", more=VIEWS) + f"SELECT asset, {tsq('available_time')}, {rq('open_interest')}, delay, 'BINANCE_METRICS_DELAY_' || delay || 'M' AS availability_assumption FROM views")
def c5(spark, d):
    return asof.delay_views(t.open_interest(spark, d), (5, 10, 15), CUT).select("asset", ts("available_time"), r8("open_interest"), "delay", "availability_assumption")


@add("C6_delay_factor_frames", with_("b1", "oi", more=VIEWS) + f"SELECT b.asset, b.delay, {tsq('b.event_time', 'event_time')}, {rq('v.open_interest', 'open_interest')} FROM (SELECT b1.*, delay FROM b1 CROSS JOIN (VALUES (5), (10), (15)) x(delay)) b ASOF LEFT JOIN views v ON b.delay = v.delay AND b.asset = v.asset AND b.available_time >= v.available_time")
def c6(spark, d):
    return asof.asof_by_delay(t.bars(spark, d), asof.delay_views(t.open_interest(spark, d), (5, 10, 15), CUT), (5, 10, 15)).select("asset", "delay", ts("event_time"), r8("open_interest"))


@add("C7_latest_through", with_("funding") + f"SELECT asset, {tsq('max(available_time)', 'available_time')}, round(arg_max(funding_rate, available_time), 8) AS funding_rate FROM funding WHERE available_time <= TIMESTAMP '{CUT}' GROUP BY asset")
def c7(spark, d):
    return asof.latest_through(t.funding(spark, d), CUT, key=["asset"]).select("asset", ts("available_time"), r8("funding_rate"))


@add("C8_membership_filter", with_("b1", "members") + f"SELECT {BARQ} FROM b1 WHERE EXISTS (SELECT 1 FROM members m WHERE m.asset = b1.asset AND date_trunc('day', m.selection_time) = date_trunc('day', b1.available_time) AND m.selection_time <= b1.available_time)")
def c8(spark, d):
    return asof.members_only(t.bars(spark, d), t.membership(spark, d)).select(*bar_columns())


@add("D1_causal_resample", with_("b1") + f"""SELECT asset, {tsq("time_bucket(INTERVAL 4 HOUR, event_time, TIMESTAMP '2000-01-01')", 'event_time')}, round(arg_min(open, event_time), 8) AS open, round(avg(close), 8) AS close, round(sum(volume), 8) AS volume,
 round(arg_max(quote_volume, event_time), 8) AS quote_volume, {tsq('max(available_time)', 'available_time')}, {tsq('max(available_time) + INTERVAL 1 HOUR', 'ingested_at')}, 'n' || arg_min(trades, event_time) AS source FROM b1 GROUP BY asset, time_bucket(INTERVAL 4 HOUR, event_time, TIMESTAMP '2000-01-01')""")
def d1(spark, d):
    b = t.bars(spark, d).withColumn("ingested_at", F.expr("available_time + interval 1 hour")).withColumn("source", F.concat(F.lit("n"), F.col("trades").cast("string")))
    out = resample.resample(b, "4 hours", {"open": "first", "close": "mean", "volume": "sum", "quote_volume": "last"})
    return out.select("asset", ts("event_time"), r8("open"), r8("close"), r8("volume"), r8("quote_volume"), ts("available_time"), ts("ingested_at"), "source")


@add("D2_resample_ohlcv", with_("b4") + f"SELECT {BARQ} FROM b4")
def d2(spark, d):
    return resample.resample_ohlcv(t.bars(spark, d), "4 hours").select(*bar_columns())


WIN = "WINDOW w AS (PARTITION BY asset ORDER BY event_time)"


def _n(n):
    return f"OVER (PARTITION BY asset ORDER BY event_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _factor(name, column, sql, more=None, hours=1, before=0, after=0):
    """A factor over the bars that reaches so many rows back and ahead, and its SQL."""
    src = {1: "b1", 4: "b4"}[hours]

    @add(name, with_(src, *(("funding", "oi") if more == "snap" else ())) + f"SELECT asset, {tsq('event_time')}, round({sql}, 8) AS value FROM {SNAP if more == 'snap' else src} {WIN}")
    def query(spark, d):
        frame = t.bars(spark, d, hours)
        if more == "snap":
            frame = asof.snapshot(frame, t.funding(spark, d), t.open_interest(spark, d))
        elif more is not None:
            frame = more(frame)
        return in_blocks(frame, lambda f: f.withColumn("value", F.round(column(), 8)), before=before, after=after).select("asset", ts("event_time"), "value")


SNAP = """(SELECT x.*, o.open_interest FROM (SELECT b.*, f.funding_rate, f.available_time AS f_at FROM b1 b ASOF LEFT JOIN funding f ON b.asset = f.asset AND b.available_time >= f.available_time) x
 ASOF LEFT JOIN oi o ON x.asset = o.asset AND x.available_time >= o.available_time)"""

_factor("E1_momentum", lambda: fx.momentum("close", 24), "close / nullif(lag(close, 24) OVER w, 0) - 1", before=24)
_factor("E2_reversal", lambda: fx.reversal("close", 12), "-(close / nullif(lag(close, 12) OVER w, 0) - 1)", before=12)
_factor("E4_volume_surprise", lambda: fx.zscore("volume", 24), f"CASE WHEN count(volume) {_n(24)} = 24 THEN (volume - avg(volume) {_n(24)}) / nullif(stddev_samp(volume) {_n(24)}, 0) END", before=24)
_factor("E6_funding_zscore", lambda: fx.zscore("funding_rate", 12), f"CASE WHEN count(funding_rate) {_n(12)} = 12 THEN (funding_rate - avg(funding_rate) {_n(12)}) / nullif(stddev_samp(funding_rate) {_n(12)}, 0) END", "snap", before=12)
_factor("E7_oi_change", lambda: fx.change("open_interest", 6), "open_interest / nullif(lag(open_interest, 6) OVER w, 0) - 1", "snap", before=6)
_factor("E12_forward_log_return", lambda: fx.forward_log_return("close", 4), "ln(lead(close, 4) OVER w / nullif(close, 0))", after=4)


@add("E15_rolling_rank", with_("b1") + f"SELECT asset, {tsq('event_time')}, round(CASE WHEN count(close) {_n(12)} = 12 THEN (len(list_filter(list(close) {_n(12)}, lambda v: v < close)) + (len(list_filter(list(close) {_n(12)}, lambda v: v = close)) + 1) / 2) / 12 END, 8) AS value FROM b1 {WIN}")
def e15(spark, d):
    return rolling_rank(t.bars(spark, d), "close", 12, "value").select("asset", ts("event_time"), r8("value"))


@add("E3_realized_volatility", with_("b1", more="r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY event_time)) AS lr FROM b1)") + f"SELECT asset, {tsq('event_time')}, CASE WHEN count(lr) {_n(24)} = 24 THEN round(stddev_samp(lr) {_n(24)}, 8) END AS value FROM r")
def e3(spark, d):
    out = in_blocks(t.bars(spark, d), lambda f: f.withColumn("lr", fx.log_return("close")).withColumn("value", fx.realized_volatility("lr", 24)), before=24)
    return out.select("asset", ts("event_time"), r8("value"))


@add("E5_amihud_illiquidity", with_("b1", more="r AS (SELECT *, abs(ln(close / lag(close) OVER (PARTITION BY asset ORDER BY event_time))) / nullif(close * volume, 0) AS il FROM b1)") + f"SELECT asset, {tsq('event_time')}, CASE WHEN count(il) {_n(24)} = 24 THEN round(avg(il) {_n(24)}, 12) END AS value FROM r")
def e5(spark, d):
    il = F.abs(fx.log_return("close")) / F.nullif(F.col("close") * F.col("volume"), F.lit(0.0))
    out = in_blocks(t.bars(spark, d), lambda f: f.withColumn("il", il).withColumn("value", fx.amihud("il", 24)), before=24)
    return out.select("asset", ts("event_time"), F.round("value", 12).alias("value"))


@add("E8_leverage_crowding", with_("b1", "funding", "oi", more=f"s AS (SELECT *, CASE WHEN count(funding_rate) {_n(12)} = 12 THEN (funding_rate - avg(funding_rate) {_n(12)}) / nullif(stddev_samp(funding_rate) {_n(12)}, 0) END AS z, open_interest / nullif(lag(open_interest, 6) OVER (PARTITION BY asset ORDER BY event_time), 0) - 1 AS dd FROM {SNAP})") + f"SELECT asset, {tsq('event_time')}, round(z * CASE WHEN dd IS NOT NULL THEN greatest(dd, 0) END, 8) AS value FROM s")
def e8(spark, d):
    frame = asof.snapshot(t.bars(spark, d), t.funding(spark, d), t.open_interest(spark, d))
    return in_blocks(frame, lambda f: f.withColumns({"z": fx.zscore("funding_rate", 12), "dd": fx.change("open_interest", 6)}), before=12).select("asset", ts("event_time"), r8(fx.crowding("z", "dd"), "value"))


PEERS = """peer AS (SELECT *, median(CASE WHEN ok THEN x END) OVER (PARTITION BY available_time) AS med, count(CASE WHEN ok THEN x END) OVER (PARTITION BY available_time) AS n FROM src),
 dev AS (SELECT *, median(CASE WHEN ok THEN abs(x - med) END) OVER (PARTITION BY available_time) AS mad FROM peer)"""


@add("E9_dual_horizon_frame", with_("b1", "funding", "oi", more=f"""src AS (SELECT s.*, funding_rate AS x, funding_rate IS NOT NULL AND coalesce(available_time - f_at <= INTERVAL 8 HOUR, false) AS ok FROM {SNAP} s), """ + PEERS + f""", r AS (SELECT *, ln(close / nullif(lag(close) OVER w, 0)) AS lr FROM dev {WIN}),
 q AS (SELECT *, abs(lr) / nullif(close * volume, 0) AS il, CASE WHEN count(funding_rate) {_n(96)} >= 1 THEN (funding_rate - avg(funding_rate) {_n(96)}) / nullif(stddev_samp(funding_rate) {_n(96)}, 0) END AS fz, open_interest / nullif(lag(open_interest, 96) OVER w, 0) - 1 AS oc FROM r {WIN})""") + f"""SELECT asset, {tsq('event_time')},
 round(close / nullif(lag(close, 96) OVER w, 0) - 1, 8) AS momentum, round(-(close / nullif(lag(close, 48) OVER w, 0) - 1), 8) AS reversal, CASE WHEN count(lr) {_n(96)} = 96 THEN round(stddev_samp(lr) {_n(96)}, 8) END AS volatility,
 CASE WHEN count(volume) {_n(96)} = 96 THEN round((volume - avg(volume) {_n(96)}) / nullif(stddev_samp(volume) {_n(96)}, 0), 8) END AS volume_surprise,
 CASE WHEN count(il) {_n(96)} = 96 THEN round(avg(il) {_n(96)}, 12) END AS illiquidity, round(fz, 8) AS funding_zscore, round(oc, 8) AS oi_change, round(fz * oc, 8) AS crowding,
 CASE WHEN ok AND n >= 2 AND mad > 0 THEN round(least(greatest((x - med) / (1.4826 * mad), -5), 5), 8) END AS relative_funding_pressure,
 CASE WHEN NOT ok THEN 'FUNDING_UNAVAILABLE_OR_GAPPED' WHEN n < 2 THEN 'INSUFFICIENT_PEER_COVERAGE' WHEN mad = 0 THEN 'ZERO_CROSS_SECTIONAL_MAD' END AS relative_funding_pressure_exclusion_reason FROM q {WIN}""")
def e9(spark, d):
    from asofly.operators.dual_horizon import factor_frame

    out = factor_frame(asof.snapshot(t.bars(spark, d), t.funding(spark, d), t.open_interest(spark, d)), "1h")
    names = ("momentum", "reversal", "volatility", "volume_surprise", "funding_zscore", "oi_change", "crowding", "relative_funding_pressure")
    return out.select("asset", ts("event_time"), *(r8(c) for c in names), F.round("illiquidity", 12).alias("illiquidity"), "relative_funding_pressure_exclusion_reason")


@add("E10_relative_funding_pressure", with_("wide", more="""fw AS (SELECT 'u' || (user_id % 16) AS asset, ts AS available_time, (value - 35) / 1e5 AS funding_rate, event_id FROM events WHERE event_id % 8 = 0),
 fu AS (SELECT asset, available_time, arg_max(funding_rate, event_id) AS funding_rate FROM fw GROUP BY ALL),
 src AS (SELECT b.asset, b.event_time, b.available_time, f.funding_rate AS x, coalesce(b.available_time - f.available_time <= INTERVAL 8 HOUR, false) AS ok FROM wide b ASOF LEFT JOIN fu f ON b.asset = f.asset AND b.available_time >= f.available_time), """ + PEERS) + f"""SELECT asset, {tsq('event_time')},
 CASE WHEN ok AND n >= 2 AND mad > 0 THEN round(least(greatest((x - med) / (1.4826 * mad), -5), 5), 8) END AS value,
 CASE WHEN NOT ok THEN 'FUNDING_UNAVAILABLE_OR_GAPPED' WHEN n < 2 THEN 'INSUFFICIENT_PEER_COVERAGE' WHEN mad = 0 THEN 'ZERO_CROSS_SECTIONAL_MAD' END AS reason FROM dev""")
def e10(spark, d):
    from asofly.operators.cross_section import funding_pressure

    e = t.read(spark, d, "events").filter("event_id % 8 = 0")
    fu = e.groupBy(F.expr("concat('u', cast(user_id % 16 as string))").alias("asset"), F.col("ts").alias("available_time")).agg(F.max_by((F.col("value") - 35) / 1e5, "event_id").alias("funding_rate"))
    fu = fu.withColumn("funding_interval_hours", F.lit(8))
    return funding_pressure(t.wide_bars(spark, d), fu).select("asset", ts("event_time"), r8("value"), "reason")


@add("E11_taker_imbalance", with_("wide", more="src AS (SELECT *, taker_buy_base / nullif(volume, 0) AS x, coalesce(volume <> 0 AND taker_buy_base IS NOT NULL AND taker_buy_base / nullif(volume, 0) BETWEEN 0 AND 1, false) AS ok FROM wide), " + PEERS) + f"""SELECT asset, {tsq('event_time')},
 CASE WHEN ok AND n >= 2 AND mad > 0 THEN round(least(greatest((x - med) / (1.4826 * mad), -5), 5), 8) END AS value,
 CASE WHEN volume = 0 THEN 'TAKER_VOLUME_ZERO' WHEN taker_buy_base IS NULL OR volume IS NULL THEN 'TAKER_FIELD_MISSING' WHEN NOT ok THEN 'TAKER_RATIO_INVALID' WHEN n < 2 THEN 'INSUFFICIENT_PEER_COVERAGE' WHEN mad = 0 THEN 'ZERO_CROSS_SECTIONAL_MAD_TAKER' ELSE '' END AS reason FROM dev""")
def e11(spark, d):
    from asofly.operators.cross_section import taker_imbalance

    return taker_imbalance(t.wide_bars(spark, d)).select("asset", ts("event_time"), r8("value"), "reason")


@add("E13_open_to_open_label", with_("wide", more="g AS (SELECT *, lag(event_time) OVER w AS prev, CASE WHEN open > 0 AND volume > 40 AND quote_volume > 0 THEN 0 ELSE 1 END AS bad FROM wide WINDOW w AS (PARTITION BY asset ORDER BY event_time)), h AS (SELECT *, CASE WHEN prev IS NOT NULL AND event_time - prev <> INTERVAL 4 HOUR THEN 1 ELSE 0 END AS gap FROM g), p AS (SELECT *, sum(bad) OVER (PARTITION BY asset ORDER BY event_time) AS nb, sum(gap) OVER (PARTITION BY asset ORDER BY event_time) AS ng FROM h)") + f"""SELECT asset, {tsq('event_time')},
 CASE WHEN lead(ng, 3) OVER w - ng = 0 AND lead(nb, 3) OVER w - nb = 0 THEN round(ln(lead(open, 3) OVER w / lead(open, 1) OVER w), 8) END AS label,
 CASE WHEN lead(ng, 3) OVER w IS NULL OR lead(ng, 3) OVER w - ng > 0 THEN 'MISSING_NEXT_BAR' WHEN lead(nb, 3) OVER w - nb > 0 THEN 'EXECUTION_BAR_INVALID' ELSE '' END AS reason FROM p WINDOW w AS (PARTITION BY asset ORDER BY event_time)""")
def e13(spark, d):
    from asofly.operators.labels import open_to_open

    return open_to_open(t.wide_bars(spark, d), holding_bars=2, bar_hours=4, least_volume=40.0).select("asset", ts("event_time"), r8("label"), "reason")


@add("E14_expression_windows", with_("b1") + f"SELECT asset, {tsq('event_time')}, round(close - lag(close, 6) OVER w, 8) AS delta, CASE WHEN count(close) {_n(12)} = 12 THEN round(avg(close) {_n(12)}, 8) END AS mean12, CASE WHEN count(close) {_n(12)} = 12 THEN round((close - avg(close) {_n(12)}) / nullif(stddev_samp(close) {_n(12)}, 0), 8) END AS z12 FROM b1 {WIN}")
def e14(spark, d):
    from asofly.functions.expressions import Node, evaluate

    close = Node.column("close")
    out = evaluate(t.bars(spark, d), {"delta": close.delta(6), "mean12": close.rolling_mean(12), "z12": close.zscore(12)})
    return out.select("asset", ts("event_time"), r8("delta"), r8("mean12"), r8("z12"))


@add("E16_average_tie_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS rank FROM lineitem")
def e16(spark, d):
    return t.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fx.average_rank("l_quantity", ["l_suppkey"]).alias("rank"))


@add("E19_drawdown", with_("b1") + f"SELECT asset, {tsq('event_time')}, round(close / max(close) OVER w - 1, 8) AS value FROM b1 {WIN}")
def e19(spark, d):
    return with_drawdown(t.bars(spark, d), "close", "value").select("asset", ts("event_time"), r8("value"))


@add("E20_compounded_equity", with_("hist", more="r AS (SELECT *, close / lag(close) OVER (PARTITION BY asset ORDER BY event_time) - 1 AS r FROM hist)") + f"SELECT asset, {tsq('event_time')}, round(100 * exp(sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER w), 6) AS equity FROM r {WIN}")
def e20(spark, d):
    r = in_blocks(t.long_history(spark, d), lambda f: f.withColumn("r", fx.change("close", 1)), before=1)
    return with_compounded(r, {"equity": "r"}, 100.0).select("asset", ts("event_time"), F.round("equity", 6).alias("equity"))


@add("E21_state_episodes", with_("b1", more="s AS (SELECT *, CASE WHEN close > open THEN 'up' ELSE 'down' END AS state FROM b1), c AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY asset ORDER BY event_time) IS DISTINCT FROM state THEN 1 ELSE 0 END AS ch FROM s)") + f"SELECT asset, {tsq('event_time')}, state, sum(ch) OVER w AS episode FROM c {WIN}")
def e21(spark, d):
    frame = t.bars(spark, d).withColumn("state", F.when(F.col("close") > F.col("open"), "up").otherwise("down"))
    return with_episodes(frame, "state", "episode").select("asset", ts("event_time"), "state", "episode")


@add("E32_vector_backtest", with_("b1", more="s AS (SELECT *, CASE WHEN close > open THEN 1.0 ELSE -1.0 END AS signal, close / lag(close) OVER (PARTITION BY asset ORDER BY event_time) - 1 AS ret FROM b1), p AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY asset ORDER BY event_time), 0) AS position FROM s), q AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY asset ORDER BY event_time), 0)) AS turnover FROM p)") + f"SELECT asset, {tsq('event_time')}, position, turnover, round(position * coalesce(ret, 0), 8) AS gross, round(position * coalesce(ret, 0) - turnover * 10 / 10000, 8) AS net FROM q")
def e32(spark, d):
    from asofly.operators.strategy import vector_backtest

    frame = t.bars(spark, d).withColumn("signal", F.when(F.col("close") > F.col("open"), 1.0).otherwise(-1.0))
    frame = in_blocks(frame, lambda f: f.withColumn("ret", fx.change("close", 1)), before=1)
    return vector_backtest(frame, cost_bps=10.0).select("asset", ts("event_time"), "position", "turnover", r8("gross"), r8("net"))


EVAL = """f AS (SELECT asset, event_time, row_number() OVER w - 1 AS pos, greatest(count(*) OVER (PARTITION BY asset) // 4, 1) AS block, CASE WHEN close > open THEN 'up' ELSE 'down' END AS regime, close / nullif(lag(close, 24) OVER w, 0) - 1 AS raw, ln(lead(close, 1) OVER w / nullif(close, 0)) AS y FROM b1 WINDOW w AS (PARTITION BY asset ORDER BY event_time)),
 fo AS (SELECT DISTINCT asset, block, unnest([0, 1, 2]) AS fold FROM f), lim AS (SELECT fo.asset, fo.fold, quantile_cont(raw, 0.01) AS lo, quantile_cont(raw, 0.99) AS hi FROM fo LEFT JOIN f ON f.asset = fo.asset AND f.pos + 1 + 1 + 4 <= f.block * (1 + fo.fold) GROUP BY ALL),
 ff AS (SELECT f.*, lim.fold, CASE WHEN raw IS NOT NULL THEN least(greatest(raw, lo), hi) END AS x FROM f JOIN lim ON lim.asset = f.asset AND f.pos >= f.block * (1 + lim.fold) AND f.pos < f.block * (2 + lim.fold)),
 tot AS (SELECT asset, fold, regime, count(*) AS total FROM ff GROUP BY ALL),
 k AS (SELECT *, rank() OVER (PARTITION BY asset, fold, regime ORDER BY x) + (count(*) OVER (PARTITION BY asset, fold, regime, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY asset, fold, regime ORDER BY y) + (count(*) OVER (PARTITION BY asset, fold, regime, y) - 1) / 2 AS ry,
  abs(x - lag(x) OVER (PARTITION BY asset, fold, regime ORDER BY event_time)) AS step FROM ff WHERE x IS NOT NULL AND y IS NOT NULL)"""


def _evaluated(spark, d):
    """Three test folds after a first training block, one bar of purge and four of embargo; each fold has limits of its own."""
    from asofly.operators.evaluation import evaluate_factor
    from asofly.operators.inference import simple_folds
    from asofly.plans.shared import stash

    frame = in_blocks(t.bars(spark, d), lambda f: f.withColumns({"x": fx.momentum("close", 24), "y": fx.forward_log_return("close", 1)}), before=24, after=1)
    frame = frame.withColumn("regime", F.when(F.col("close") > F.col("open"), "up").otherwise("down"))
    rows = stash(simple_folds(frame, folds=3, purge=1, embargo=4), "folds")  # limits, totals and ranks read it
    by = ["asset", "fold", "regime"]
    return rows.filter("test_fold is not null").withColumn("fold", F.col("test_fold")), evaluate_factor(rows, "x", "y", by=by), by


@add("D15_factor_evaluation", with_("b1", more=EVAL) + "SELECT k.asset, k.fold, k.regime, count(*) AS n, round(count(*) / any_value(total), 8) AS coverage, round(coalesce(avg(step), 0), 8) AS turnover, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN round(corr(x, y), 8) END AS ic, CASE WHEN max(x) > min(x) AND max(y) > min(y) THEN round(corr(rx, ry), 8) END AS rank_ic FROM k JOIN tot ON tot.asset = k.asset AND tot.fold = k.fold AND tot.regime = k.regime GROUP BY ALL HAVING count(*) >= 2")
def d15(spark, d):
    _, out, by = _evaluated(spark, d)
    return out.select(*by, "n", r8("coverage"), r8("turnover"), r8("ic"), r8("rank_ic"))


@add("D15b_factor_inference")
def d15b(spark, d):
    """p-values and block-bootstrap bounds of the same slices, where they hold enough rows."""
    from asofly.operators import bootstrap, inference

    frame, out, by = _evaluated(spark, d)
    keyed = frame.withColumn("slice", F.concat_ws("|", *by))
    bounds = bootstrap.stationary_bootstrap(keyed, "x", "y", draws=200, by="slice")
    p = out.withColumn("slice", F.concat_ws("|", *by)).withColumn("p", inference.spearman_p("rank_ic", "n"))
    enough = lambda c: F.when(F.col("p").isNotNull(), F.round(c, 8)).alias(c)
    return p.join(bounds, "slice", "left").select(*by, "n", r8("p"), enough("low"), enough("high"))
