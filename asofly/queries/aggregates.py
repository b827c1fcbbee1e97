"""Quality, coverage, universe, regime and strategy aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asofly.functions import factors as fx
from asofly.operators import indicators, quality, regimes, strategy, universe
from asofly.operators.timeblocks import in_blocks
from asofly.queries.base import add, bars_sql, r8, rq, ts, tsq, with_
from asofly.queries.research import CONF
from asofly.sources import tables as t

WIN = "WINDOW w AS (PARTITION BY asset ORDER BY event_time)"


@add("B8_excluded_names", "SELECT n, (n IN ('USDCUSDT','FDUSDUSDT','TUSDUSDT','USDPUSDT','DAIUSDT','BUSDUSDT') OR regexp_matches(n, '(UP|DOWN|BULL|BEAR)USDT$') OR regexp_matches(n, '^W(BTC|ETH|BETH)')) AS excluded, count(*) AS n_rows FROM (SELECT CASE user_id % 6 WHEN 0 THEN 'USDCUSDT' WHEN 1 THEN 'BTCUPUSDT' WHEN 2 THEN 'WBTCUSDT' WHEN 3 THEN 'ETHUSDT' WHEN 4 THEN 'BULLUSDT' ELSE upper(event_type) || 'USDT' END AS n FROM events) GROUP BY ALL")
def b8(spark, d):
    name = F.expr("case user_id % 6 when 0 then 'USDCUSDT' when 1 then 'BTCUPUSDT' when 2 then 'WBTCUSDT' when 3 then 'ETHUSDT' when 4 then 'BULLUSDT' else concat(upper(event_type), 'USDT') end")
    return t.read(spark, d, "events").select(name.alias("n")).groupBy("n", universe.excluded_name(F.col("n")).alias("excluded")).agg(F.count(F.lit(1)).alias("n_rows"))


B11 = """SELECT 'bars' AS kind, asset, event_time, available_time + CASE WHEN trades % 53 = 0 THEN -INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS available_time, low + CASE WHEN trades % 47 = 0 THEN 1000 ELSE 0 END AS low, open, high, close, volume, 8 AS hours, 1.0 AS oi FROM b1 UNION ALL SELECT 'bars', asset, event_time, available_time, low, open, high, close, volume, 8, 1.0 FROM b1 WHERE trades % 43 = 0
 UNION ALL SELECT 'funding', asset, event_time, available_time, 1, 1, 1, 1, 1, CASE WHEN funding_rate > 6e-4 THEN 3 ELSE 8 END, 1.0 FROM funding UNION ALL SELECT 'metrics', asset, event_time, available_time, 1, 1, 1, 1, 1, 8, open_interest - 1001 FROM oi"""


@add("B11_canonical_validation", with_("b1", "funding", "oi", more="x AS (" + B11 + """), k AS (SELECT *, kind || '|' || asset || '|' || strftime(event_time, '%Y-%m-%d') AS identity, count(*) OVER (PARTITION BY kind, asset, event_time) AS n FROM x)""") + """SELECT identity, concat_ws(',', CASE WHEN bool_or(available_time < event_time) THEN 'CANONICAL_CAUSALITY_INVALID' END, CASE WHEN bool_or(event_time > TIMESTAMP '2024-01-25' OR available_time > TIMESTAMP '2024-01-25') THEN 'CANONICAL_CUTOFF_VIOLATION' END, CASE WHEN bool_or(asset = 'click' AND kind = 'bars') THEN 'CANONICAL_ASSET_INVALID' END,
 CASE WHEN bool_or(kind = 'funding' AND extract('hour' FROM event_time) = 23) THEN 'CANONICAL_SOURCE_PERIOD_MISMATCH' END, CASE WHEN bool_or(n > 1) THEN 'CANONICAL_DUPLICATE' END, CASE WHEN bool_or(kind = 'bars' AND (least(open, high, low, close) <= 0 OR volume < 0 OR high < greatest(open, close, low) OR low > least(open, close, high))) THEN 'CANONICAL_VALUE_INVALID' END,
 CASE WHEN bool_or(kind = 'funding' AND hours NOT IN (1, 4, 8)) THEN 'CANONICAL_INTERVAL_INVALID' END, CASE WHEN bool_or(kind = 'metrics' AND oi < 0) THEN 'CANONICAL_NEGATIVE_OI' END) AS reasons FROM k GROUP BY identity""")
def b11(spark, d):
    """Sources of a day with faults of every kind: late cut-off, doubled and impossible bars, foreign assets, short periods."""
    day = F.date_trunc("day", F.col("event_time")).cast("timestamp_ntz")

    def source(frame, kind, hours):
        return frame.withColumns({"identity": F.concat_ws("|", F.lit(kind), "asset", F.date_format("event_time", "yyyy-MM-dd")), "source_asset": F.when((F.col("asset") == "click") & F.lit(kind == "bars"), "other").otherwise(F.col("asset")), "period_start": day, "period_end": (day + F.expr(f"interval {hours} hours"))})

    b = t.bars(spark, d)
    odd = b.withColumn("available_time", F.expr("if(trades % 53 = 0, available_time - interval 3 hours, available_time)")).withColumn("low", F.col("low") + F.when(F.col("trades") % 47 == 0, 1000).otherwise(0))
    funding = t.funding(spark, d).withColumn("funding_interval_hours", F.when(F.col("funding_rate") > 6e-4, 3).otherwise(8))
    oi = t.open_interest(spark, d).select("asset", "event_time", "available_time", (F.col("open_interest") - 1001).alias("sum_open_interest"), "sum_open_interest_value")
    parts = [(odd.unionByName(b.filter("trades % 43 = 0")), "bars", "ohlcv", 24), (funding, "funding", "funding", 23), (oi, "metrics", "metrics", 24)]
    found = [quality.source_reasons(source(f, name, hours), as_of="2024-01-25", kind=kind) for f, name, kind, hours in parts]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("identity", F.concat_ws(",", "reasons").alias("reasons"))


@add("D3_ohlcv_quality", with_("b1", more="""g AS (SELECT *, lag(event_time) OVER (PARTITION BY asset ORDER BY event_time) AS prev FROM b1)""") + """SELECT asset, 'TIME_GAP' AS code, count(*) AS n FROM g WHERE event_time - prev > INTERVAL 1 HOUR GROUP BY asset
 UNION ALL SELECT asset, 'OHLC_RELATION', count(*) FROM b1 WHERE high < greatest(open, close, low) OR low > least(open, close, high) GROUP BY asset HAVING count(*) > 0
 UNION ALL SELECT asset, 'NEGATIVE_VOLUME', count(*) FROM b1 WHERE volume < 0 GROUP BY asset HAVING count(*) > 0
 UNION ALL SELECT asset, 'DUPLICATE_BAR', count(*) FROM (SELECT asset, event_time FROM b1 GROUP BY ALL HAVING count(*) > 1) GROUP BY asset""")
def d3(spark, d):
    return quality.inspect_ohlcv(t.bars(spark, d), step_hours=1).groupBy("asset", "code").agg(F.count(F.lit(1)).alias("n"))


@add("D4_coverage", with_("b1") + """SELECT asset, strftime(event_time, '%Y-%m-%d') AS period, count(*) AS observed, round(count(*) / 24.0, 8) AS coverage, CASE WHEN count(*) / 24.0 >= 0.999 THEN 'PASSED' WHEN asset = 'click' THEN 'EXCLUDED' ELSE 'BLOCKING' END AS status FROM b1 GROUP BY asset, strftime(event_time, '%Y-%m-%d')""")
def d4(spark, d):
    return quality.coverage(t.bars(spark, d), expected=24, threshold=0.999, warn=F.col("asset") == "click").select("asset", "period", "observed", r8("coverage"), "status")


@add("D5_funding_quality", with_("funding") + """SELECT asset, strftime(event_time, '%Y-%m-%d') AS period, count(*) AS observed, count(*) - count(DISTINCT event_time) AS duplicates, count(*) FILTER (WHERE available_time < event_time) AS not_causal,
 count(*) FILTER (WHERE funding_interval_hours NOT IN (1, 4, 8)) AS bad_interval, CAST(ceil(24.0 / arg_min(funding_interval_hours, event_time)) AS BIGINT) AS expected, round(least(count(DISTINCT event_time) / ceil(24.0 / arg_min(funding_interval_hours, event_time)), 1.0), 8) AS coverage FROM funding GROUP BY ALL""")
def d5(spark, d):
    out = quality.inspect_funding(t.funding(spark, d))
    return out.select("asset", "period", "observed", "duplicates", "not_causal", "bad_interval", "expected", r8("coverage"))


@add("D6_metrics_quality", with_("oi") + """SELECT asset, strftime(event_time, '%Y-%m-%d') AS period, count(*) AS observed, count(*) FILTER (WHERE open_interest < 1001) AS low_values, count(*) - count(DISTINCT event_time) AS duplicates, count(*) FILTER (WHERE available_time < event_time) AS not_causal, round(count(DISTINCT event_time) / 288.0, 8) AS coverage FROM oi GROUP BY ALL""")
def d6(spark, d):
    return quality.inspect_metrics(t.open_interest(spark, d), least=1001).select("asset", "period", "observed", "low_values", "duplicates", "not_causal", r8("coverage"))


@add("D7_source_report", with_("b1", more="g AS (SELECT *, date_trunc('day', event_time) AS period, CASE WHEN trades % 61 = 0 THEN event_time + INTERVAL 1 DAY ELSE event_time END AS stamp, lag(event_time) OVER (PARTITION BY asset ORDER BY event_time) AS prev FROM b1 WHERE event_time < TIMESTAMP '2024-01-24 06:30:00')") + f"""SELECT asset, {tsq('period')}, {tsq('min(stamp)', 'first_event')}, {tsq('max(stamp)', 'last_event')}, count(*) AS observed, CAST(greatest(0, least(24, floor(epoch(TIMESTAMP '2024-01-24 06:30:00' - period) / 3600))) AS BIGINT) AS expected, count(*) FILTER (WHERE NOT (open > 0 AND close > 0 AND volume >= 0)) AS invalid,
 count(*) FILTER (WHERE event_time - prev > INTERVAL 2 HOUR) AS wide_gaps, count(*) FILTER (WHERE stamp < period OR stamp >= period + INTERVAL 1 DAY) AS outside_period FROM g GROUP BY asset, period""")
def d7(spark, d):
    """As of a moment within a day, with some rows stamped a day late."""
    b = t.bars(spark, d).filter("event_time < timestamp_ntz'2024-01-24 06:30:00'").withColumn("period", F.date_trunc("day", F.col("event_time")).cast("timestamp_ntz"))
    b = b.withColumn("_gap", quality.seconds_since()).withColumn("event_time", F.expr("if(trades % 61 = 0, event_time + interval 1 day, event_time)"))
    return quality.source_report(b, step_hours=1, as_of="2024-01-24 06:30:00").select("asset", ts("period"), ts("first_event"), ts("last_event"), "observed", "expected", "invalid", "wide_gaps", "outside_period")


@add("D8_daily_funding_alignment", with_("funding") + f"""SELECT strftime(available_time, '%Y-%m-%d') AS day, {tsq('max(available_time)', 'last_time')}, count(DISTINCT asset) AS assets, round(avg(CASE WHEN funding_rate > 0 THEN 1.0 ELSE 0.0 END), 8) AS share_positive, round(median(funding_rate), 8) AS median_rate, round(count(DISTINCT asset) / 5.0, 8) AS coverage, sha256(string_agg(DISTINCT sha256(asset), ',' ORDER BY sha256(asset))) AS source_sha256 FROM funding GROUP BY 1""")
def d8(spark, d):
    out = quality.daily_funding(t.funding(spark, d).withColumn("source_sha256", F.sha2("asset", 256)), assets=5)
    return out.select("day", ts("last_time"), "assets", r8("share_positive"), r8("median_rate"), r8("coverage"), "source_sha256")


@add("D9_trailing_medians", with_("b24", "members") + f"""SELECT s.selection_time_ AS selection_time, b.asset, count(DISTINCT CAST(b.event_time AS DATE)) AS days, round(median(b.quote_volume), 6) AS median FROM (SELECT DISTINCT selection_time, strftime(selection_time, '%Y-%m-%d %H:%M:%S') AS selection_time_ FROM members) s
 JOIN b24 b ON b.event_time < s.selection_time AND b.event_time >= s.selection_time - INTERVAL 10 DAY AND b.available_time <= s.selection_time GROUP BY 1, 2""")
def d9(spark, d):
    return universe.trailing_stats(t.membership(spark, d), t.bars(spark, d, 24), "quote_volume", 10).select(ts("selection_time"), "asset", "days", F.round("median", 6).alias("median"))


@add("D10_migration_universe", with_("b24", "b1") + """SELECT d.asset, d.n AS daily_bars, round(1 - h.n / 720.0, 8) AS missing_share, round(d.mv, 6) AS median_volume, d.n >= 20 AND 1 - h.n / 720.0 <= 0.10 AS eligible FROM
 (SELECT asset, count(*) AS n, median(volume) AS mv FROM b24 WHERE available_time <= TIMESTAMP '2024-01-31' GROUP BY asset) d JOIN (SELECT asset, count(*) AS n FROM b1 WHERE event_time >= TIMESTAMP '2024-01-01' AND available_time <= TIMESTAMP '2024-01-31' GROUP BY asset) h ON d.asset = h.asset""")
def d10(spark, d):
    return universe.migration_universe(t.bars(spark, d, 24), t.bars(spark, d), "2024-01-31", least_days=20, most_missing=0.10).select("asset", "daily_bars", r8("missing_share"), F.round("median_volume", 6).alias("median_volume"), "eligible")


@add("D11_listing_metadata", with_("b1") + f"SELECT asset, {tsq('min(event_time)', 'listing_time')}, {tsq('arg_min(available_time, event_time)', 'listing_available_time')} FROM b1 GROUP BY asset")
def d11(spark, d):
    return universe.listings(t.bars(spark, d)).select("asset", ts("listing_time"), ts("listing_available_time"))


@add("D12_market_composite", with_("b1") + f"SELECT {tsq('event_time')}, round(avg(open), 8) AS open, max(high) AS high, min(low) AS low, round(avg(close), 8) AS close, round(sum(volume), 8) AS volume FROM b1 GROUP BY event_time")
def d12(spark, d):
    return regimes.composite(t.bars(spark, d)).select(ts("event_time"), r8("open"), "high", "low", r8("close"), r8("volume"))


@add("D13_reason_counts", with_("b1", "funding") + "SELECT coalesce(CASE WHEN f.available_time IS NULL OR b.available_time - f.available_time > INTERVAL 8 HOUR THEN 'FUNDING_UNAVAILABLE_OR_GAPPED' END, 'OK') AS reason, count(*) AS n FROM b1 b ASOF LEFT JOIN funding f ON b.asset = f.asset AND b.available_time >= f.available_time GROUP BY 1")
def d13(spark, d):
    from asofly.operators import asof

    return quality.reason_counts(asof.asof_funding(t.bars(spark, d), t.funding(spark, d)), "funding_reason")


@add("D14_window_counts", with_("b1") + "SELECT CASE WHEN event_time < TIMESTAMP '2024-01-15' THEN 'development' WHEN event_time < TIMESTAMP '2024-01-20' THEN 'buffer' WHEN event_time <= TIMESTAMP '2024-02-01' THEN 'holdout' END AS role, count(*) AS n FROM b1 WHERE event_time >= TIMESTAMP '2024-01-01' GROUP BY 1")
def d14(spark, d):
    from asofly.operators.filters import role

    return t.bars(spark, d).groupBy(role(F.col("event_time"), "2024-01-01", "2024-01-15", "2024-01-20", "2024-02-01").alias("role")).agg(F.count(F.lit(1)).alias("n"))


@add("D17_episode_summary", with_("b1", more="s AS (SELECT *, CASE WHEN close > open THEN 'up' ELSE 'down' END AS state FROM b1), c AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY asset ORDER BY event_time) IS DISTINCT FROM state THEN 1 ELSE 0 END AS ch FROM s), e AS (SELECT *, sum(ch) OVER (PARTITION BY asset ORDER BY event_time) AS ep FROM c), r AS (SELECT asset, state, ep, count(*) AS n, sum(high - low) AS v FROM e GROUP BY ALL)") + "SELECT asset, state, sum(n) AS n_rows, CASE WHEN sum(n) >= 30 THEN count(*) END AS episodes, CASE WHEN sum(n) >= 30 THEN round(avg(n), 8) END AS mean_duration, CASE WHEN sum(n) >= 30 THEN round(sum(v) / sum(n), 6) END AS mean_volatility, CASE WHEN sum(n) >= 30 THEN 'sufficient_evidence' ELSE 'insufficient_evidence' END AS status FROM r GROUP BY ALL")
def d17(spark, d):
    frame = t.bars(spark, d).withColumn("state", F.when(F.col("close") > F.col("open"), "up").otherwise("down"))
    out = regimes.episode_summary(frame.withColumn("range", F.col("high") - F.col("low")), "state", volatility="range")
    return out.select("asset", "state", "n_rows", "episodes", r8("mean_duration"), F.round("mean_volatility", 6).alias("mean_volatility"), "status")


@add("D18_universe_features", with_("b24") + f"""SELECT {tsq('event_time')}, count(*) AS member_count, round(median(quote_volume), 6) AS median_quote_volume, round(coalesce(sum(CASE WHEN rn <= 3 AND quote_volume > 0 THEN quote_volume END) / nullif(sum(CASE WHEN quote_volume > 0 THEN quote_volume END), 0), 0), 8) AS top3_share FROM (SELECT *, row_number() OVER (PARTITION BY event_time ORDER BY quote_volume DESC, asset) AS rn FROM b24) GROUP BY event_time""")
def d18(spark, d):
    return regimes.universe_features(t.bars(spark, d, 24), "quote_volume").select(ts("event_time"), "member_count", F.round("median_quote_volume", 6).alias("median_quote_volume"), r8("top3_share"))


@add("D19_trade_metrics", with_("trades") + """SELECT outcome, count(*) AS n_trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 8) AS win_rate, round(avg(CASE WHEN pnl > 0 THEN pnl END), 6) AS avg_win, round(avg(CASE WHEN pnl <= 0 THEN pnl END), 6) AS avg_loss,
 round(sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl <= 0 THEN pnl END), 0), 8) AS profit_factor, round(sum(pnl), 4) AS total, round(max(pnl), 6) AS best, round(min(pnl), 6) AS worst FROM trades GROUP BY outcome""")
def d19(spark, d):
    return strategy.trade_metrics(t.trades(spark, d), ["outcome"]).select("outcome", "n_trades", r8("win_rate"), F.round("avg_win", 6).alias("avg_win"), F.round("avg_loss", 6).alias("avg_loss"), r8("profit_factor"), F.round("total", 4).alias("total"), F.round("best", 6).alias("best"), F.round("worst", 6).alias("worst"))


EQ = "e AS (SELECT run_id, slot, seq, equity_after, max(equity_after) OVER (PARTITION BY run_id ORDER BY slot, seq) AS peak FROM decisions)"


@add("D20_variant_metrics", with_("decisions", more=EQ + ", tr AS (SELECT o_custkey AS run_id, l_extendedprice * (l_discount - 0.05) AS pnl, l_extendedprice * 0.0004 AS fee FROM lineitem JOIN orders ON o_orderkey = l_orderkey), ta AS (SELECT run_id, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, count(*) AS trade_count, sum(fee) AS fees_paid, sum(pnl) AS net_profit FROM tr GROUP BY run_id), m AS (SELECT run_id, arg_max(equity_after, (slot, seq)) AS final_equity, arg_min(equity_after, (slot, seq)) AS first_equity, least(min(CASE WHEN peak > 0 THEN equity_after / peak - 1 ELSE 0 END), 0) AS dd, count(*) AS n FROM e GROUP BY run_id)") + "SELECT m.run_id, round(final_equity, 6) AS final_equity, round(final_equity / nullif(first_equity, 0) - 1, 8) AS total_return, round(dd, 8) AS max_drawdown, n, round(win_rate, 8) AS win_rate, coalesce(trade_count, 0) AS trade_count, round(coalesce(fees_paid, 0), 4) AS fees_paid, round(coalesce(net_profit, 0), 4) AS net_profit FROM m LEFT JOIN ta ON ta.run_id = m.run_id")
def d20(spark, d):
    runs = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("trade_id"), F.col("o_custkey").alias("run_id"))
    trades = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("trade_id"), F.expr("l_extendedprice * (l_discount - 0.05)").alias("pnl"), (F.col("l_extendedprice") * 0.0004).alias("fee")).join(runs, "trade_id")
    out = strategy.variant_metrics(t.decisions(spark, d), trades)
    return out.select("run_id", F.round("final_equity", 6).alias("final_equity"), r8("total_return"), r8("max_drawdown"), "n", r8("win_rate"), "trade_count", F.round("fees_paid", 4).alias("fees_paid"), F.round("net_profit", 4).alias("net_profit"))


RET = "r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY event_time), 0) - 1 AS ret, close / max(close) OVER (PARTITION BY asset ORDER BY event_time) - 1 AS dd FROM hist)"


@add("D21_equity_metrics", with_("hist", more=RET) + "SELECT asset, round(arg_max(close, event_time), 6) AS final_equity, round(arg_max(close, event_time) / nullif(arg_min(close, event_time), 0) - 1, 8) AS total_return, round(stddev_pop(coalesce(ret, 0)) * sqrt(365), 8) AS volatility, round(coalesce(avg(coalesce(ret, 0)) * 365 / nullif(stddev_pop(coalesce(ret, 0)) * sqrt(365), 0), 0), 8) AS sharpe, round(min(dd), 8) AS max_drawdown, count(*) FILTER (WHERE abs(coalesce(ret, 0)) > 0) AS active_days FROM r GROUP BY asset")
def d21(spark, d):
    return strategy.equity_metrics(t.long_history(spark, d)).select("asset", F.round("final_equity", 6).alias("final_equity"), r8("total_return"), r8("volatility"), r8("sharpe"), r8("max_drawdown"), "active_days")


@add("D22_sharpe_drawdown", with_("hist", more=RET) + "SELECT asset, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(365) ELSE 0 END, 8) AS sharpe, round(min(dd), 8) AS max_drawdown FROM r GROUP BY asset")
def d22(spark, d):
    return strategy.sharpe_and_drawdown(t.long_history(spark, d), 365).select("asset", r8("sharpe"), r8("max_drawdown"))


@add("D23_portfolio_kpis", with_("trades") + "SELECT count(DISTINCT asset) AS assets, count(*) AS n_trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 8) AS win_rate, round(sum(pnl), 2) AS total FROM trades")
def d23(spark, d):
    return strategy.portfolio_kpis(t.trades(spark, d)).select("assets", "n_trades", r8("win_rate"), F.round("total", 2).alias("total"))


@add("D24_protocol_statistics", "SELECT o_orderpriority AS protocol, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01') AS holdout_passed FROM orders GROUP BY 1")
def d24(spark, d):
    runs = t.read(spark, d, "orders").select(F.col("o_orderpriority").alias("protocol"), (F.col("o_orderstatus") == "F").alias("passed"), F.expr("o_orderdate >= timestamp_ntz'1997-01-01'").alias("out_of_sample"))
    return quality.protocol_statistics(runs)


@add("D25_concentration", with_("trades") + "SELECT asset, round(max(n) / sum(n), 8) AS max_share, arg_max(outcome, (n, outcome)) AS largest FROM (SELECT asset, outcome, count(*) AS n FROM trades GROUP BY ALL) GROUP BY asset")
def d25(spark, d):
    return quality.concentration(t.trades(spark, d), "outcome", ["asset"]).select("asset", r8("max_share"), "largest")


@add("D26_promotion_decision", with_("hist", more="f AS (SELECT asset, year(event_time) AS fold, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY event_time), 0) - 1 AS ret FROM hist), s AS (SELECT asset, fold, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(365) ELSE 0 END AS sharpe, sum(ret) AS total, min(ret) AS worst FROM f GROUP BY ALL), a AS (SELECT asset, avg(CASE WHEN total > 0 THEN 1.0 ELSE 0.0 END) AS pr, median(sharpe) AS ms, min(worst) AS wd FROM s GROUP BY asset)") + "SELECT asset, round(pr, 8) AS positive_ratio, round(ms, 8) AS median_sharpe, concat_ws(',', CASE WHEN pr < 0.70 THEN 'POSITIVE_FOLDS' END, CASE WHEN ms < 0.80 THEN 'MEDIAN_SHARPE' END, CASE WHEN wd < -0.25 THEN 'WORST_DRAWDOWN' END) AS reasons FROM a")
def d26(spark, d):
    frame = in_blocks(t.long_history(spark, d), lambda f: f.withColumn("ret", fx.change("close", 1)), before=1).withColumn("fold", F.year("event_time"))
    return strategy.promotion(strategy.fold_metrics(frame)).select("asset", r8("positive_ratio"), r8("median_sharpe"), F.concat_ws(",", "reasons").alias("reasons"))


@add("D27_plan_counts", with_("b24") + f"SELECT asset, CASE WHEN trades > 70 THEN 'busy' ELSE 'quiet' END AS busy, count(*) AS n, {tsq('min(event_time)', 'first_period')}, {tsq('max(event_time)', 'last_period')} FROM b24 GROUP BY CUBE (asset, CASE WHEN trades > 70 THEN 'busy' ELSE 'quiet' END)")
def d27(spark, d):
    out = t.bars(spark, d, 24).withColumn("busy", F.when(F.col("trades") > 70, "busy").otherwise("quiet"))
    return out.cube("asset", "busy").agg(F.count(F.lit(1)).alias("n"), ts(F.min("event_time"), "first_period"), ts(F.max("event_time"), "last_period"))


@add("D28_coverage_matrix", with_("b1", more="s AS (SELECT asset, CASE WHEN event_time < TIMESTAMP '2024-01-16' THEN 'first_half' ELSE 'second_half' END AS dataset, CASE WHEN count(*) >= 24 THEN 1 WHEN asset = 'click' THEN 2 ELSE 3 END AS sev FROM b1 GROUP BY asset, date_trunc('day', event_time), dataset)") + "SELECT asset, CASE max(CASE WHEN dataset = 'first_half' THEN sev END) WHEN 3 THEN 'BLOCKED' WHEN 2 THEN 'EXCLUDED' WHEN 1 THEN 'PASSED' ELSE 'UNAVAILABLE' END AS first_half, CASE max(CASE WHEN dataset = 'second_half' THEN sev END) WHEN 3 THEN 'BLOCKED' WHEN 2 THEN 'EXCLUDED' WHEN 1 THEN 'PASSED' ELSE 'UNAVAILABLE' END AS second_half FROM s GROUP BY asset")
def d28(spark, d):
    c = quality.coverage(t.bars(spark, d), expected=24, threshold=0.999, warn=F.col("asset") == "click")
    c = c.withColumn("dataset", F.when(F.col("period") < "2024-01-16", "first_half").otherwise("second_half"))
    return quality.status_matrix(c, ["first_half", "second_half"])


@add("D29_partial_availability", with_("b1", "members", more="p AS (SELECT asset, date_trunc('day', event_time) AS period FROM b1 GROUP BY ALL HAVING count(*) < 20)") + "SELECT p.asset, count(DISTINCT period) AS periods, count(DISTINCT m.selection_time) AS affected_days FROM p LEFT JOIN members m ON m.asset = p.asset AND m.selection_time = p.period GROUP BY p.asset")
def d29(spark, d):
    part = t.bars(spark, d).groupBy("asset", F.date_trunc("day", F.col("event_time")).cast("timestamp_ntz").alias("period")).agg(F.count(F.lit(1)).alias("n")).filter("n < 20")
    return quality.partial_impact(part, t.membership(spark, d))


@add("D30_equal_weight_portfolio", with_("hist", more=RET) + ", " + f"p AS (SELECT event_time, avg(ret) AS ret FROM r WHERE ret IS NOT NULL GROUP BY event_time) SELECT {tsq('event_time')}, round(ret, 8) AS ret, round(exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) END) OVER (ORDER BY event_time)), 8) AS equity FROM p")
def d30(spark, d):
    return strategy.equal_weight(t.long_history(spark, d)).select(ts("event_time"), r8("ret"), r8("equity"))


@add("D31_verdict_counts", with_("props") + "SELECT research_family, CASE WHEN length(formula) < 200 THEN 'REJECT' WHEN length(formula) < 2000 THEN 'PASS' ELSE 'REVIEW' END AS verdict, count(*) AS n, count(*) - count(DISTINCT md5(formula)) AS duplicates FROM props GROUP BY ALL")
def d31(spark, d):
    p = t.proposals(spark, d).withColumn("verdict", F.when(F.length("formula") < 200, "REJECT").when(F.length("formula") < 2000, "PASS").otherwise("REVIEW"))
    return quality.verdict_counts(p, ["research_family", "verdict"], F.md5("formula"))


@add("D32_daily_pnl", with_("trades") + "SELECT asset, strftime(exit_time, '%Y-%m-%d') AS day, round(sum(pnl), 6) AS pnl FROM trades GROUP BY ALL")
def d32(spark, d):
    return strategy.daily_pnl(t.trades(spark, d)).select("asset", "day", F.round("pnl", 6).alias("pnl"))


@add("D34_pattern_statistics", with_("b1", more=CONF) + "SELECT asset, count(*) FILTER (WHERE pin <> 0) AS pin_bar, count(*) FILTER (WHERE eng <> 0) AS engulfing, count(*) FILTER (WHERE bos <> 0) AS bos, count(*) FILTER (WHERE high <= ph AND low >= pl) AS inside, count(*) FILTER (WHERE signal = 1) AS long_signals, count(*) FILTER (WHERE signal = -1) AS short_signals FROM (SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM sg WINDOW w AS (PARTITION BY asset ORDER BY event_time)) GROUP BY asset")
def d34(spark, d):
    frame = indicators.confluence(t.bars(spark, d), atr_band=(0.05, 5.0))
    counts = {"pin_bar": F.col("pin") != 0, "engulfing": F.col("engulfing") != 0, "bos": F.col("bos") != 0, "inside": F.col("inside") == 1, "long_signals": F.col("signal") == 1, "short_signals": F.col("signal") == -1}
    return frame.groupBy("asset").agg(*(F.count_if(rule).alias(name) for name, rule in counts.items()))


REG = """r AS (SELECT *, ln(close / lag(close) OVER w) AS lr FROM hist WINDOW w AS (PARTITION BY asset ORDER BY event_time)),
 q AS (SELECT asset, event_time, CASE WHEN count(lr) OVER v = 48 THEN stddev_samp(lr) OVER v END AS vol, abs(close / nullif(lag(close, 48) OVER w, 0) - 1) AS ret48, CASE WHEN count(abs(lr) / nullif(close * volume, 0)) OVER v = 48 THEN avg(abs(lr) / nullif(close * volume, 0)) OVER v END AS illiq FROM r
 WINDOW w AS (PARTITION BY asset ORDER BY event_time), v AS (PARTITION BY asset ORDER BY event_time ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)), z AS (SELECT *, ret48 / nullif(vol, 0) AS trend FROM q)"""


@add("E22_regime_inputs", with_("hist", more=REG) + f"SELECT asset, {tsq('event_time')}, round(vol, 8) AS volatility, round(trend, 6) AS trend, round(illiq, 12) AS illiquidity FROM z")
def e22(spark, d):
    return regimes.inputs(t.long_history(spark, d), sizes=t.long_history_sizes(spark, d)).select("asset", ts("event_time"), r8("volatility"), F.round("trend", 6).alias("trend"), F.round("illiquidity", 12).alias("illiquidity"))


@add("E23_regime_labels", with_("hist", more=REG + ", th AS (SELECT asset, quantile_cont(vol, 0.75) AS qv, quantile_cont(trend, 0.60) AS qt, quantile_cont(illiq, 0.95) AS qi FROM z WHERE event_time < TIMESTAMP '1997-01-01' GROUP BY asset)") + f"""SELECT z.asset, {tsq('event_time')}, CASE WHEN coalesce(illiq > qi, false) THEN 'liquidity_stress' WHEN coalesce(trend > qt, false) AND coalesce(vol > qv, false) THEN 'trend_high_vol' WHEN coalesce(trend > qt, false) THEN 'trend_low_vol' WHEN coalesce(vol > qv, false) THEN 'range_high_vol' ELSE 'range_low_vol' END AS regime FROM z JOIN th USING (asset)""")
def e23(spark, d):
    frame = regimes.with_thresholds(t.long_history(spark, d), F.lit("1997-01-01").cast("timestamp_ntz"), sizes=t.long_history_sizes(spark, d))
    return frame.select("asset", ts("event_time"), regimes.label().alias("regime"))


@add("E24_expanding_thresholds", with_("hist", more=REG + ", p AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY event_time) - 1 AS pos FROM z), bl AS (SELECT DISTINCT asset, (pos - 200) // 100 AS block FROM p WHERE pos >= 200)") + "SELECT bl.asset, bl.block, round(quantile_cont(vol, 0.75), 8) AS q_volatility, round(quantile_cont(trend, 0.60), 6) AS q_trend, round(quantile_cont(illiq, 0.95), 12) AS q_illiquidity FROM bl JOIN p ON p.asset = bl.asset AND p.pos < 200 + 100 * bl.block GROUP BY ALL")
def e24(spark, d):
    sizes = t.long_history_sizes(spark, d)
    out = regimes.expanding_thresholds(regimes.inputs(t.long_history(spark, d), sizes=sizes), initial=200, every=100, sizes=sizes)
    return out.select("asset", "block", r8("q_volatility"), F.round("q_trend", 6).alias("q_trend"), F.round("q_illiquidity", 12).alias("q_illiquidity"))


@add("E34_portfolio_state", with_("decisions", more="e AS (SELECT *, max(equity_after) OVER w AS hwm, first_value(equity_after) OVER (PARTITION BY run_id, date_trunc('day', slot) ORDER BY seq) AS day_start FROM decisions WINDOW w AS (PARTITION BY run_id ORDER BY slot, seq))") + f"SELECT run_id, seq, round(hwm, 4) AS high_water, round(equity_after / hwm - 1, 8) AS drawdown, round(equity_after - day_start, 4) AS day_change, CASE WHEN equity_after / hwm - 1 <= -0.10 THEN strftime(date_trunc('day', slot) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') END AS paused_until FROM e")
def e34(spark, d):
    out = strategy.portfolio_state(t.decisions(spark, d), pause_at=-0.10)
    return out.select("run_id", "seq", F.round("high_water", 4).alias("high_water"), r8("drawdown"), F.round("day_change", 4).alias("day_change"), ts("paused_until"))


@add("F1_universe_top_k", with_("b24", more="s AS (SELECT event_time AS selection_time, asset, rank() OVER (PARTITION BY event_time ORDER BY quote_volume DESC) + rank() OVER (PARTITION BY event_time ORDER BY volume DESC) AS score, count(*) OVER (PARTITION BY event_time) AS eligible FROM b24)") + f"SELECT {tsq('selection_time')}, asset, score, rank, eligible, eligible < 5 AS short FROM (SELECT *, row_number() OVER (PARTITION BY selection_time ORDER BY score, asset) AS rank FROM s) WHERE rank <= 3")
def f1(spark, d):
    c = t.bars(spark, d, 24).select(F.col("event_time").alias("selection_time"), "asset", F.col("quote_volume").alias("median_quote_volume"), F.col("volume").alias("median_oi_value"), F.lit(None).cast("string").alias("reason"))
    return universe.select_universe(c, 3, 5).select(ts("selection_time"), "asset", "score", "rank", "eligible", "short")


@add("F2_competition_rank", with_("b24") + f"SELECT {tsq('event_time')}, asset, rank() OVER (PARTITION BY event_time ORDER BY trades DESC) AS rank FROM b24")
def f2(spark, d):
    return t.bars(spark, d, 24).select(ts("event_time"), "asset", universe.competition_rank("trades", ["event_time"]).alias("rank"))


@add("F3_core_plus_top", with_("wide", more="v AS (SELECT asset, median(volume) AS mv FROM wide GROUP BY asset)") + "SELECT asset, 0 AS rank FROM v WHERE asset IN ('u0', 'u1') UNION ALL SELECT asset, rank FROM (SELECT asset, row_number() OVER (ORDER BY mv DESC, asset) AS rank FROM v WHERE asset NOT IN ('u0', 'u1')) WHERE rank <= 8 AND (SELECT count(*) FROM v WHERE asset NOT IN ('u0', 'u1')) >= 5")
def f3(spark, d):
    return universe.core_plus_top(t.wide_bars(spark, d).groupBy("asset").agg(F.median("volume").alias("median_volume")), ["u0", "u1"])


@add("F4_neutral_targets", with_("wide", more="s AS (SELECT event_time, asset, close / nullif(open, 0) - 1 AS signal FROM wide WHERE open <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY event_time ORDER BY signal DESC, asset) AS top, row_number() OVER (PARTITION BY event_time ORDER BY signal, asset DESC) AS bottom, count(*) OVER (PARTITION BY event_time) AS n FROM s), m AS (SELECT *, greatest(3, CAST(floor(0.2 * n) AS BIGINT)) AS leg FROM k)") + f"SELECT {tsq('event_time')}, asset, round(CASE WHEN n < 6 THEN 0.0 WHEN top <= leg THEN 0.5 / leg WHEN bottom <= leg THEN -0.5 / leg ELSE 0.0 END, 8) AS weight FROM m")
def f4(spark, d):
    return strategy.neutral_targets(t.wide_bars(spark, d).withColumn("signal", F.try_divide(F.col("close"), F.col("open")) - 1), q=0.2, least=3).select(ts("event_time"), "asset", r8("weight"))


@add("F5_tail_trades", with_("trades") + "SELECT outcome, trade_id, leg, round(pnl, 6) AS pnl FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY exit_time DESC, trade_id DESC, leg DESC) AS rn FROM trades) WHERE rn <= 50")
def f5(spark, d):
    return strategy.last_rows(t.trades(spark, d), ["outcome"], ["exit_time", "trade_id", "leg"], 50).select("outcome", "trade_id", "leg", F.round("pnl", 6).alias("pnl"))


@add("F6_every_kth", with_("b1") + f"SELECT asset, {tsq('event_time')}, round(close, 8) AS close FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY event_time) - 1 AS rn FROM b1) WHERE rn % 6 = 0")
def f6(spark, d):
    return strategy.every_kth(t.bars(spark, d), 6).select("asset", ts("event_time"), r8("close"))


@add("F7_ranked_signals", with_("wide") + f"SELECT {tsq('event_time')}, asset, row_number() OVER (PARTITION BY event_time ORDER BY abs(close / open - 1) DESC, asset) AS rank, CASE WHEN close > open THEN 1 ELSE -1 END AS direction FROM wide WHERE close <> open AND open <> 0")
def f7(spark, d):
    return strategy.ranked_signals(t.wide_bars(spark, d).withColumn("factor", F.try_divide(F.col("close"), F.col("open")) - 1)).select(ts("event_time"), "asset", "rank", "direction")


@add("F8_latest_state", with_("decisions") + f"SELECT run_id, arg_max(seq, (slot, seq)) AS seq, {tsq('max(slot)', 'slot')}, count(*) AS history FROM decisions GROUP BY run_id")
def f8(spark, d):
    return strategy.latest_state(t.decisions(spark, d)).select("run_id", "seq", ts("slot"), "history")


@add("F9_first_round", with_("props", more="e AS (SELECT *, row_number() OVER (PARTITION BY research_family, mechanism ORDER BY factor_id) AS r1 FROM props WHERE length(formula) >= 200), g AS (SELECT *, row_number() OVER (PARTITION BY research_family ORDER BY factor_id) AS r2 FROM e WHERE r1 = 1)") + "SELECT p.factor_id, CASE WHEN length(p.formula) < 200 THEN 'NOT_PASSED' WHEN g.r2 <= 2 THEN 'SELECTED' WHEN g.r2 IS NOT NULL THEN 'FAMILY_CAP' ELSE 'MECHANISM_TAKEN' END AS reason FROM props p LEFT JOIN g ON p.factor_id = g.factor_id")
def f9(spark, d):
    from asofly.operators.proposals import first_round

    return first_round(t.proposals(spark, d).withColumn("passed", F.length("formula") >= 200), cap=2).select("factor_id", "reason")


CYCLE = """u AS (SELECT event_time, count(*) AS n, median(quote_volume) AS mv, median(volume) AS mo, coalesce(sum(CASE WHEN rn <= 3 AND quote_volume > 0 THEN quote_volume END) / nullif(sum(CASE WHEN quote_volume > 0 THEN quote_volume END), 0), 0) AS conc FROM (SELECT *, row_number() OVER (PARTITION BY event_time ORDER BY quote_volume DESC, asset) AS rn FROM b24) GROUP BY event_time),
 p AS (SELECT *, row_number() OVER (ORDER BY event_time) AS pos, avg(n) OVER t5 AS n5, median(mv) OVER t5 AS mv5, median(mo) OVER t5 AS mo5, median(conc) OVER t5 AS c5, median(mv) OVER b5 AS mvb, median(mo) OVER b5 AS mob FROM u WINDOW t5 AS (ORDER BY event_time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b5 AS (ORDER BY event_time ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING)),
 h AS (SELECT *, CASE WHEN pos >= 10 THEN mvb ELSE median(CASE WHEN pos <= 5 THEN mv END) OVER r END AS mvp, CASE WHEN pos >= 10 THEN mob ELSE median(CASE WHEN pos <= 5 THEN mo END) OVER r END AS mop FROM p WINDOW r AS (ORDER BY event_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 m AS (SELECT *, CASE WHEN mvp > 0 THEN (mv5 - mvp) / mvp ELSE 0 END AS vmom, CASE WHEN mop > 0 THEN (mo5 - mop) / mop ELSE 0 END AS omom FROM h)"""


@add("I8_market_cycle", with_("b24", "funding", more=CYCLE + """, al AS (SELECT date_trunc('day', available_time) AS day, avg(CASE WHEN funding_rate > 0 THEN 1.0 ELSE 0.0 END) AS share, count(DISTINCT asset) / 5.0 AS coverage FROM funding GROUP BY 1),
 s AS (SELECT m.*, al.share, al.coverage, greatest(least(n5 / 12, 1), 0) AS breadth, 1 / (1 + exp(-least(greatest(3 * vmom, -20), 20))) AS vm, 1 / (1 + exp(-least(greatest(3 * omom, -20), 20))) AS om, least(greatest((c5 - 0.55) / 0.35, 0), 1) AS pen FROM m ASOF LEFT JOIN al ON m.event_time >= al.day),
 k AS (SELECT *, 0.40 * breadth + 0.30 * vm + 0.25 * om + 0.05 * (1 - pen) AS b0, 0.35 * (1 - breadth) + 0.30 * (1 - vm) + 0.25 * (1 - om) + 0.10 * pen AS risk FROM s),
 f AS (SELECT *, CASE WHEN coverage >= 0.5 THEN CASE WHEN (1 - 2 * share) > 0 AND risk > b0 THEN 0.0 ELSE least(greatest((1 - 2 * share) * 0.10, -0.10), 0.10) END END AS term FROM k),
 g AS (SELECT *, CASE WHEN term IS NULL THEN b0 ELSE least(greatest(b0 + term, 0), 1) END AS bull FROM f),
 z AS (SELECT *, greatest(0.05, 1 - abs(bull - risk)) AS neutral, pos >= 8 AS enough FROM g),
 q AS (SELECT *, CASE WHEN enough THEN bull / (bull + neutral + risk) ELSE 0 END AS pb, CASE WHEN enough THEN neutral / (bull + neutral + risk) ELSE 0 END AS pn, CASE WHEN enough THEN risk / (bull + neutral + risk) ELSE 0 END AS pr FROM z)""") + f"""SELECT {tsq('event_time')}, round(pb, 6) AS p_bull, round(pn, 6) AS p_neutral, round(pr, 6) AS p_risk_off, round(greatest(pb, pn, pr), 6) AS confidence, round(CASE WHEN enough THEN term END, 8) AS funding_term, pos AS sample_count,
 CASE WHEN NOT enough THEN 'insufficient_evidence' WHEN pr >= pn AND pr >= pb THEN 'risk_off' WHEN pn >= pb THEN 'neutral' ELSE 'bull' END AS label FROM q""")
def i8(spark, d):
    """Five rows where the default is thirty: the events span a month."""
    features = regimes.universe_features(t.bars(spark, d, 24), "quote_volume", "volume")
    aligned = quality.daily_funding(t.funding(spark, d), assets=5).withColumn("event_time", F.col("day").cast("timestamp_ntz"))
    out = regimes.market_cycle(features, aligned, rows=5, least=8)
    return out.select(ts("event_time"), *(F.round(c, 6).alias(c) for c in ("p_bull", "p_neutral", "p_risk_off", "confidence")), r8("funding_term"), "sample_count", "label")


@add("E35_cycle_features", with_("b24", more=CYCLE) + f"SELECT {tsq('event_time')}, round(n5 / 12, 8) AS breadth, round(mv5, 6) AS trailing, round(mvp, 6) AS baseline, round(vmom, 8) AS volume_momentum, round(omom, 8) AS oi_momentum, round(c5, 8) AS concentration FROM m")
def e35(spark, d):
    out = regimes.cycle_features(regimes.universe_features(t.bars(spark, d, 24), "quote_volume", "volume"), rows=5)
    return out.select(ts("event_time"), r8("breadth"), F.round("trailing_volume", 6).alias("trailing"), F.round("baseline_volume", 6).alias("baseline"), r8("volume_momentum"), r8("oi_momentum"), r8("concentration"))
