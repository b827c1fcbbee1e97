"""Set-wise strategy analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.functions.factors import W, change
from asofly.operators.joins import first_touch
from asofly.operators.prefix import prefix_sums
from asofly.operators.timeblocks import in_blocks, numbered, running, with_compounded, with_drawdown
from asofly.plans.shared import stash


def vector_backtest(frame: DataFrame, *, cost_bps: float) -> DataFrame:
    """Position (the last signal, clipped to one), turnover, gross and net return of each bar. Needs signal and ret."""
    position = F.greatest(F.least(F.coalesce(F.lag("signal", 1).over(W()), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0))
    turnover = F.abs(F.col("position") - F.coalesce(F.lag("position", 1).over(W()), F.lit(0.0)))
    out = in_blocks(frame, lambda f: f.withColumn("position", position).withColumn("turnover", turnover), before=2)
    out = out.withColumn("gross", F.col("position") * F.coalesce("ret", F.lit(0.0)))
    return out.withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 10000)


def trade_metrics(trades: DataFrame, by: list[str]) -> DataFrame:
    """Counts, win rate, averages, profit factor (null without losses), totals, best and worst."""
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") <= 0, F.col("pnl"))
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        F.try_divide(F.sum(win), F.nullif(-F.sum(loss), F.lit(0.0))).alias("profit_factor"), F.sum("pnl").alias("total"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"),
    )


def variant_metrics(decisions: DataFrame, trades: DataFrame, *, initial: float | None = None) -> DataFrame:
    """Final equity, return (on `initial`, or the first equity), deepest drawdown, win rate, fees and net profit of each run.

    decisions: run_id, slot, seq, equity_after; trades: run_id, pnl (after fees), fee. Runs without trades have no win rate.
    """
    order = F.struct("slot", "seq")
    peak = F.col("_peak")
    out = running(decisions, {"_peak": ("max", F.col("equity_after"))}, by=["run_id"], order=["slot", "seq"])
    out = out.withColumn("_dd", F.when(peak > 0, F.try_divide(F.col("equity_after"), peak) - 1).otherwise(0.0))
    first, last = F.lit(initial) if initial is not None else F.min_by("equity_after", order), F.max_by("equity_after", order)
    out = out.groupBy("run_id").agg(last.alias("final_equity"), (F.try_divide(last, first) - 1).alias("total_return"), F.least(F.min("_dd"), F.lit(0.0)).alias("max_drawdown"), F.count(F.lit(1)).alias("n"))
    t = trades.groupBy("run_id").agg(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.count(F.lit(1)).alias("trade_count"), F.sum("fee").alias("fees_paid"), F.sum("pnl").alias("net_profit"))
    return out.join(t, "run_id", "left").fillna(0, ["trade_count", "fees_paid", "net_profit"])


def with_returns(prices: DataFrame) -> DataFrame:
    return with_drawdown(in_blocks(prices, lambda f: f.withColumn("ret", change("close", 1)), before=1), "close", "dd")


def equity_metrics(prices: DataFrame, days: int = 365) -> DataFrame:
    """Final equity, total return, annualised volatility (population), Sharpe-like ratio (0 when flat), drawdown and days that
    moved; the first return counts as 0."""
    r = F.coalesce("ret", F.lit(0.0))
    vol = F.stddev_pop(r) * F.sqrt(F.lit(days))
    first, last = F.min_by("close", "event_time"), F.max_by("close", "event_time")
    return with_returns(prices).groupBy("asset").agg(
        last.alias("final_equity"), (F.try_divide(last, first) - 1).alias("total_return"), vol.alias("volatility"), F.when(vol > 0, F.try_divide(F.avg(r) * days, vol)).otherwise(0.0).alias("sharpe"), F.min("dd").alias("max_drawdown"),
        F.count_if(F.abs(r) > 0).alias("active_days"),
    )


def sharpe_and_drawdown(prices: DataFrame, days: int) -> DataFrame:
    """Annualised Sharpe ratio (sample deviation; 0 when flat) and the deepest drawdown."""
    return with_returns(prices).groupBy("asset").agg(sharpe(days).alias("sharpe"), F.min("dd").alias("max_drawdown"))


def sharpe(days: int) -> Column:
    return F.when(F.stddev_samp("ret") > 0, F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(days))).otherwise(0.0)


def portfolio_kpis(trades: DataFrame) -> DataFrame:
    return trades.agg(F.countDistinct("asset").alias("assets"), F.count(F.lit(1)).alias("n_trades"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.sum("pnl").alias("total"))


def fold_metrics(frame: DataFrame, days: int = 365) -> DataFrame:
    return frame.groupBy("asset", "fold").agg(sharpe(days).alias("sharpe"), F.sum("ret").alias("total"), F.min("ret").alias("worst"))


def promotion(folds: DataFrame, *, positive: float = 0.70, median_sharpe: float = 0.80, worst: float = -0.25) -> DataFrame:
    """Reasons against promoting each asset's strategy, from its folds."""
    a = folds.groupBy("asset").agg(F.avg(F.when(F.col("total") > 0, 1.0).otherwise(0.0)).alias("positive_ratio"), F.median("sharpe").alias("median_sharpe"), F.min("worst").alias("worst"))
    rules = [("POSITIVE_FOLDS", F.col("positive_ratio") < positive), ("MEDIAN_SHARPE", F.col("median_sharpe") < median_sharpe), ("WORST_DRAWDOWN", F.col("worst") < worst)]
    return a.withColumn("reasons", F.array_compact(F.array(*(F.when(rule, code) for code, rule in rules))))


def equal_weight(prices: DataFrame) -> DataFrame:
    """Mean return across assets per time, and its compounded equity."""
    r = with_returns(prices).filter("ret is not null").groupBy("event_time").agg(F.avg("ret").alias("ret"))
    return with_compounded(r, {"equity": "ret"}, by=[])


def daily_pnl(trades: DataFrame) -> DataFrame:
    return trades.groupBy("asset", F.date_format("exit_time", "yyyy-MM-dd").alias("day")).agg(F.sum("pnl").alias("pnl"))


def portfolio_state(decisions: DataFrame, *, pause_at: float) -> DataFrame:
    """High-water mark, drawdown, change since the day's first decision, and the pause that a deep drawdown starts."""
    day = Window.partitionBy("run_id", F.date_trunc("day", F.col("slot"))).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = running(decisions, {"high_water": ("max", F.col("equity_after"))}, by=["run_id"], order=["slot", "seq"]).withColumn("drawdown", F.try_divide(F.col("equity_after"), F.col("high_water")) - 1)
    out = out.withColumn("day_change", F.col("equity_after") - F.first("equity_after").over(day))
    return out.withColumn("paused_until", F.when(F.col("drawdown") <= pause_at, F.expr("date_trunc('day', slot) + interval 1 day")))


def neutral_targets(signals: DataFrame, *, q: float, least: int) -> DataFrame:
    """Weights of a dollar-neutral book per time: the n highest and n lowest signals, n = max(least, floor(q N)).

    The bottom is taken from the reverse of the same total order; with fewer than 2 x least assets all are flat. Assets
    without a signal take no part.
    """
    w = Window.partitionBy("event_time")
    out = signals.filter("signal is not null").withColumns({"_top": F.row_number().over(w.orderBy(F.desc("signal"), "asset")), "_low": F.row_number().over(w.orderBy("signal", F.desc("asset"))), "_n": F.count(F.lit(1)).over(w)})
    leg = F.greatest(F.lit(least), F.floor(q * F.col("_n")))
    weight = F.when(F.col("_n") < 2 * least, 0.0).when(F.col("_top") <= leg, 0.5 / leg).when(F.col("_low") <= leg, -0.5 / leg).otherwise(0.0)
    return out.withColumn("weight", weight).drop("_top", "_low", "_n")


def last_rows(frame: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return frame.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def every_kth(frame: DataFrame, k: int) -> DataFrame:
    """Every k-th row of each asset, the first one included."""
    return numbered(frame, "_rn").filter(F.col("_rn") % k == 0).drop("_rn")


def ranked_signals(frame: DataFrame) -> DataFrame:
    """Assets ranked by the size of a factor per time, zeros dropped, direction by its sign."""
    w = Window.partitionBy("event_time").orderBy(F.desc(F.abs("factor")), "asset")
    return frame.filter("factor <> 0").withColumn("rank", F.row_number().over(w)).withColumn("direction", F.when(F.col("factor") > 0, 1).otherwise(-1))


def latest_state(events: DataFrame) -> DataFrame:
    """Latest event of each run, and how many there were."""
    return events.groupBy("run_id").agg(F.max_by(F.struct("seq", "slot"), F.struct("slot", "seq")).alias("r"), F.count(F.lit(1)).alias("history")).select("run_id", "r.seq", "r.slot", "history")


def compare_allocations(returns: DataFrame, *, cap: float, initial: float = 100.0) -> DataFrame:
    """Equity of equal weights against volume weights under a cap."""
    day = returns.groupBy("event_time").agg(F.avg("ret").alias("_e"), (cap * F.try_divide(F.sum(F.col("ret") * F.col("volume")), F.sum("volume"))).alias("_w"))
    return with_compounded(day, {"equal_weight": "_e", "weighted": "_w"}, initial, by=[]).select("event_time", "equal_weight", "weighted")


def review_summary(decisions: DataFrame, *, now: str | None = None, least_days: float = 30, floor: float, hours: int = 24) -> DataFrame:
    """What an operator reviews of each run at `now` (without it, the run's last decision): days completed, to a tenth;
    slots from the first decision's to now's without a decision, their number and the first of them; the current equity, the
    high-water mark and the day's loss against the equity before the day (the day's first, where there's none); breaches
    of an equity floor; and whether it's ready: days enough, no breach, no slot missing. Later decisions don't count.

    decisions: run_id, slot, seq, equity_after. Missing slots are gaps between consecutive ones, so they are never listed.
    """
    at = F.col("slot").cast("timestamp_ntz")
    d = decisions.select("run_id", at.alias("slot"), "seq", "equity_after")
    if now is not None:
        d = d.filter(F.col("slot") <= F.lit(now).cast("timestamp_ntz"))
    number = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / (hours * 3600))
    order = F.struct("slot", "seq")
    end = F.lit(now).cast("timestamp_ntz") if now is not None else F.col("_last")
    last = d.groupBy("run_id").agg(F.min("slot").alias("_first"), F.max("slot").alias("_last"), F.max("equity_after").alias("high_water_mark"), F.max_by("equity_after", order).alias("current_equity"), F.count_if(F.col("equity_after") < floor).alias("breaches")).withColumn("_end", end)

    day = F.date_trunc("day", F.col("_end")).cast("timestamp_ntz")
    days = d.join(last.select("run_id", day.alias("_day")), "run_id").groupBy("run_id").agg(F.max_by("equity_after", F.when(F.col("slot") < F.col("_day"), order)).alias("_before"), F.min_by("equity_after", F.when(F.col("slot") >= F.col("_day"), order)).alias("_own"))
    start = F.coalesce("_before", "_own")

    slots = d.select("run_id", number(F.col("slot")).alias("_s")).distinct().unionByName(last.select("run_id", (number(F.col("_end")) + 1).alias("_s")))  # the slot after now's closes the last gap
    slots = in_blocks(slots, lambda f: f.withColumn("_p", F.lag("_s", 1).over(Window.partitionBy("run_id").orderBy("_s"))), before=1, by="run_id", order="_s")
    gap = F.col("_s") - F.col("_p") - 1
    gaps = slots.filter("_p is not null").groupBy("run_id").agg(F.sum(gap).alias("missing_slots"), F.min(F.when(gap > 0, F.col("_p") + 1)).alias("_m"))
    out = last.join(days, "run_id").join(gaps, "run_id")
    age = F.expr("timestampdiff(SECOND, _first, _end)") / 86400
    first = F.timestamp_seconds(F.col("_m") * hours * 3600).cast("timestamp_ntz").alias("first_missing")
    ready = (age >= least_days) & (F.col("breaches") == 0) & (F.col("missing_slots") == 0)
    return out.select("run_id", F.round(age, 1).alias("completed_days"), "missing_slots", first, "current_equity", "high_water_mark", F.greatest(start - F.col("current_equity"), F.lit(0.0)).alias("daily_loss"), "breaches", ready.alias("review_ready"))


def walk_forward_outcomes(bars: DataFrame, signals: DataFrame, variants: DataFrame, costs: DataFrame, *, delays: tuple[int, ...], horizon_hours: int) -> DataFrame:
    """Outcomes of signals of both sides under each variant and cost scenario, by asset and fold, training and test rows apart.

    bars: from inference.walk_forward; signals: asset, event_time, side (1 or -1); variants (few): variant, stop, target as
    shares of the entry; costs (few): scenario, fee_bps, slip_bps, delay. A signal enters at the open of the bar `delay` bars after
    the next, pays on both ways, and leaves at its first touch. Per variant, scenario, asset and fold: trades, longs, mean
    net and win rate of the test rows; trades and mean net of the training rows before them, which end a purge and an
    embargo earlier; and whether the variant has the highest mean there (`chosen`; ties, to ten decimals: the smaller name), so a choice
    made on training rows is judged on test rows. Sums of training rows are merged over the folds.
    """
    after = {f"_{c}{k}": F.lead(c, k + o).over(W()) for k in delays for c, o in (("open", 1), ("event_time", 0))}
    p = in_blocks(bars.select("asset", "event_time", "open", "test_fold", "train_from", "last_fold"), lambda f: f.withColumns(after), after=max(delays) + 1)
    fills = F.explode(F.array(*(F.struct(F.lit(k).alias("delay"), F.col(f"_open{k}").alias("entry"), F.col(f"_event_time{k}").alias("start")) for k in delays))).alias("f")
    s = p.join(signals, ["asset", "event_time"]).select("asset", F.col("event_time").alias("signal_time"), "side", "test_fold", "train_from", "last_fold", fills).select("*", "f.*").drop("f").filter("entry > 0")
    s = s.crossJoin(F.broadcast(variants)).withColumns({"stop": F.col("entry") * (1 - F.col("side") * F.col("stop")), "target": F.col("entry") * (1 + F.col("side") * F.col("target"))}).withColumnRenamed("start", "event_time")
    own = ["variant", "delay", "signal_time"]
    s = stash(s, "signals")  # touched, and joined to what touched it
    hit = first_touch(s.select(*own, "asset", "event_time", "side", "stop", "target"), bars, horizon_hours=horizon_hours, key=own)
    done = hit.join(s.select(*own, "asset", "side", "entry", "test_fold", "train_from", "last_fold"), [*own, "asset"]).join(F.broadcast(costs), "delay")
    net = F.col("side") * (F.col("exit_price") / F.col("entry") - 1) - 2 * (F.col("fee_bps") + F.col("slip_bps")) / 10000
    done = done.select(F.struct("variant", "scenario", "asset").alias("key"), "side", "test_fold", "train_from", net.alias("net"))
    part = stash(done.groupBy("key", "test_fold", "train_from").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == 1).alias("longs"), F.count_if(F.col("net") > 0).alias("wins"), F.sum("net").alias("net")), "outcomes")
    last = part.select("key", F.col("key.asset").alias("asset")).distinct().join(bars.groupBy("asset").agg(F.max("last_fold").alias("last")), "asset").select("key", "last")
    trained = prefix_sums(part.filter("train_from is not null").withColumnRenamed("train_from", "block"), last, ["n", "net"], key="key")
    trained = trained.select("key", F.col("block").alias("fold"), F.col("n").alias("train_n"), F.try_divide("net", "n").alias("train_mean"))
    tested = part.filter("test_fold is not null").groupBy("key", F.col("test_fold").alias("fold")).agg(*(F.sum(c).alias(c) for c in ("n", "longs", "wins", "net")))
    out = trained.join(tested, ["key", "fold"], "left").select("key.*", "fold", "train_n", "train_mean", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("longs", F.lit(0)).alias("longs"), F.try_divide("net", "n").alias("mean_net"), F.try_divide("wins", "n").alias("win_rate"))
    best = F.row_number().over(Window.partitionBy("scenario", "asset", "fold").orderBy(F.round("train_mean", 10).desc_nulls_last(), "variant"))  # a group is the variants
    return out.withColumn("chosen", (best == 1) & F.col("train_mean").isNotNull())
