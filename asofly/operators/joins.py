"""Grids, interval joins, first touches and lineage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.functions.factors import W
from asofly.operators.timeblocks import in_blocks, numbered, running
from asofly.plans.shared import stash


def source_plan(assets: DataFrame, datasets: list[tuple[str, str]], start: str, end: str) -> DataFrame:
    """Objects to acquire: each asset, dataset (name, 'month' or 'day') and period from start to end, with its identity."""
    kinds = F.array(*(F.struct(F.lit(n).alias("dataset"), F.lit(g).alias("granularity")) for n, g in datasets))
    grid = assets.select("asset", F.explode(kinds).alias("k")).select("asset", "k.dataset", "k.granularity")
    periods = F.when(F.col("granularity") == "month", F.expr(f"sequence(date_trunc('month', date'{start}'), timestamp'{end}', interval 1 month)")).otherwise(F.expr(f"sequence(timestamp'{start}', timestamp'{end}', interval 1 day)"))
    out = grid.select("asset", "dataset", "granularity", F.explode(periods).alias("_p")).withColumn("period", F.to_date("_p")).drop("_p")
    label = F.when(F.col("granularity") == "month", F.date_format("period", "yyyy-MM")).otherwise(F.date_format("period", "yyyy-MM-dd"))
    return out.withColumn("period_label", label).withColumn("identity", F.concat_ws("|", "dataset", "asset", "granularity", "period_label"))


def pre_listing(plan: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Planned objects marked KEEP, PRE_LISTING_EXCLUDED, or BOUNDARY_MISSING where no first period is known."""
    j = plan.join(boundaries, "asset", "left")
    status = F.when(F.col("first_period").isNull(), "BOUNDARY_MISSING").when(F.col("period") < F.col("first_period"), "PRE_LISTING_EXCLUDED").otherwise("KEEP")
    return j.withColumn("status", status)


def grid_faults(expected: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are missing from, doubled in or unexpected in observed."""
    n = observed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    missing = expected.join(n, key, "left_anti").select(*key, F.lit("MISSING").alias("fault"))
    extra = n.join(expected, key, "left_anti").select(*key, F.lit("UNEXPECTED").alias("fault"))
    return missing.unionByName(extra).unionByName(n.filter("_n > 1").select(*key, F.lit("DUPLICATE").alias("fault")))


def delay_columns(frames: DataFrame, delays: list[int]) -> DataFrame:
    """One row per bar with a column for each delay."""
    wide = frames.groupBy("asset", "event_time").pivot("delay", delays).agg(F.first("open_interest"))
    return wide.select("asset", "event_time", *(F.col(str(d)).alias(f"oi_{d}m") for d in delays))


def first_touch(signals: DataFrame, bars: DataFrame, *, horizon_hours: int, key: list[str] | None = None) -> DataFrame:
    """For each signal (asset, event_time, side, stop, target; key: columns that also tell signals apart) the first later bar within the horizon that hits one.

    Bars and signals meet in time buckets one horizon wide, so each signal sees two buckets of its own asset only. The stop
    wins a bar that hits both; without a hit the last close in the horizon is the exit.
    """
    width = horizon_hours * 3600
    at = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / width)
    s = signals.withColumn("_k", F.explode(F.array(at("event_time"), at("event_time") + 1)))
    b = bars.select("asset", at("event_time").alias("_k"), F.col("event_time").alias("t"), "high", "low", "close")
    near = (F.col("t") > F.col("event_time")) & (F.expr("timestampdiff(SECOND, event_time, t)") <= width)
    j = s.join(b, ["asset", "_k"]).filter(near)
    long = F.col("side") == 1
    stop = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    goal = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    j = j.withColumn("_o", F.when(stop, "STOP").when(goal, "TARGET"))
    price = F.when(F.col("_o") == "STOP", F.col("stop")).otherwise(F.col("target"))
    hit = F.min_by(F.struct(F.col("_o").alias("outcome"), price.alias("price"), "t"), F.when(F.col("_o").isNotNull(), F.col("t")))
    last = F.max_by(F.struct(F.lit("OPEN").alias("outcome"), F.col("close").alias("price"), "t"), "t")
    best = j.groupBy(*(key or []), "asset", "event_time").agg(F.coalesce(hit, last).alias("r"))
    return best.select(*(key or []), "asset", "event_time", "r.outcome", F.col("r.price").alias("exit_price"), F.col("r.t").alias("exit_time"))


def funding_cashflow(positions: DataFrame, funding: DataFrame, *, days: float = 0.25) -> DataFrame:
    """Funding paid over each position's interval, both ends included: minus notional times sign times rate.

    positions: position_id, asset, entry, exit, notional, sign. Entries and exits are stacked with the rates and take the
    rates' running sums at their place, so no position meets single rates; what lies between is the difference. Sums are
    of decimals (18 places at least), so what lies before an interval leaves no rounding in it. Rates too large for them or
    not finite are counted and summed apart, and count where an interval holds one. days: the width of blocks of time.
    """
    same = ["position_id", "asset", "entry", "exit", "notional", "sign"]
    some = positions.select(*same).filter(F.col("asset").isNotNull() & (F.col("entry") <= F.col("exit")))
    some = some.groupBy(*same).agg(F.count(F.lit(1)).alias("_m"))  # rows that are equal are one, taken so many times
    ends = F.explode(F.array(F.struct(F.col("entry").alias("_t"), F.lit(0).alias("_o")), F.struct(F.col("exit").alias("_t"), F.lit(2).alias("_o"))))  # before and after rates of the same time
    ends = some.withColumn("_e", ends).select(*same, "_m", "_e.*")
    rate = F.col("funding_rate").cast("double")
    rates = funding.filter(F.col("asset").isNotNull() & F.col("event_time").isNotNull()).select("asset", F.col("event_time").alias("_t"), F.lit(1).alias("_o"), rate.alias("_r"))
    stacked = rates.unionByName(ends, allowMissingColumns=True)

    r, one = F.col("_r"), F.lit(1).cast("long")
    finite = ~F.isnan(r) & (F.abs(r) < float("inf"))
    exact = finite & (F.abs(r) < 1e6)
    parts = {
        "_n": ("sum", F.when(F.col("_o") == 1, one)), "_some": ("sum", F.when(r.isNotNull(), one)), "_sum": ("sum", F.when(exact, r).cast("decimal(28,20)")),
        "_far": ("sum", F.when(finite & ~exact, one)), "_farsum": ("sum", F.when(finite & ~exact, r)),
        "_up": ("sum", F.when(r == float("inf"), one)), "_down": ("sum", F.when(r == float("-inf"), one)), "_nan": ("sum", F.when(F.isnan(r), one)),
    }
    at = running(stacked, parts, order=["_t", "_o"], days=days).filter("_o <> 1")
    zero = F.lit(0)
    between = lambda c: F.coalesce(F.max(F.when(F.col("_o") == 2, F.col(c))), zero) - F.coalesce(F.max(F.when(F.col("_o") == 0, F.col(c))), zero)
    out = at.groupBy(*same, "_m").agg(*(between(c).alias(c) for c in parts)).filter("_n > 0")
    total = F.col("_sum").cast("double") + F.when(F.col("_far") > 0, F.col("_farsum")).otherwise(0.0)
    for c, v in (("_up", "inf"), ("_down", "-inf"), ("_nan", "nan")):
        total = total + F.when(F.col(c) > 0, float(v)).otherwise(0.0)
    paid = F.when(F.col("_some") > 0, -F.col("notional") * F.col("sign") * total * F.col("_m"))
    return out.groupBy("position_id").agg(F.sum(paid).alias("cashflow"), F.sum(F.col("_n") * F.col("_m")).alias("events"))


def dependent_slices(slices: DataFrame) -> DataFrame:
    """Pairs of slices of one asset whose bar sets intersect: joined on single bars, not on pairs of slices."""
    x = slices.select("asset", "slice_id", F.explode("bars").alias("bar"))
    y = x.select("asset", F.col("slice_id").alias("other"), "bar")
    return x.join(y, ["asset", "bar"]).filter("slice_id < other").select("asset", "slice_id", "other").distinct()


def missing_runs(assets: DataFrame, calendar: DataFrame, observed: DataFrame) -> DataFrame:
    """asset, first and last position in the calendar (numbered in order of time, from 0) of every run of times that an
    expected asset has no row at: a row for each run, however long.

    assets: asset; calendar: event_time, pos; observed: asset, event_time. The grid itself is never made.
    """
    n = calendar.count()
    at = observed.select("asset", "event_time").distinct().join(assets.select("asset").distinct(), "asset", "left_semi").join(calendar, "event_time").select("asset", "pos")
    ends = assets.select("asset").distinct().select("asset", F.explode(F.array(F.lit(-1).cast("long"), F.lit(n).cast("long"))).alias("pos"))
    was = F.lag("pos", 1).over(Window.partitionBy("asset").orderBy("pos"))
    runs = in_blocks(at.unionByName(ends), lambda f: f.withColumn("_was", was), before=1, order="pos")
    return runs.filter(F.col("pos") - F.col("_was") > 1).select("asset", (F.col("_was") + 1).alias("first"), (F.col("pos") - 1).alias("last"))


def calendar_faults(assets: DataFrame, times: DataFrame, observed: DataFrame) -> DataFrame:
    """grid_faults of every asset at every time, without the grid: gaps are found as runs and spelt out at the end."""
    calendar = stash(numbered(times.select("event_time").distinct(), by=[]), "calendar")
    n = stash(observed.groupBy("asset", "event_time").agg(F.count(F.lit(1)).alias("_n")), "cells")
    assets = stash(assets.select("asset").distinct(), "assets")
    runs = missing_runs(assets, calendar, n)
    missing = runs.select("asset", F.explode(F.sequence("first", "last")).alias("pos")).join(calendar, "pos").select("asset", "event_time", F.lit("MISSING").alias("fault"))
    n = n.join(assets.withColumn("_a", F.lit(True)), "asset", "left").join(calendar.withColumn("_t", F.lit(True)).drop("pos"), "event_time", "left")
    faults = F.array(F.when(F.col("_a").isNull() | F.col("_t").isNull(), "UNEXPECTED"), F.when(F.col("_n") > 1, "DUPLICATE"))
    return missing.unionByName(n.select("asset", "event_time", F.explode(F.array_compact(faults)).alias("fault")))


def missing_slots(observed: DataFrame, *, hours: int, grace_minutes: int) -> DataFrame:
    """Slots strictly between a run's first and last decision with none within the grace period."""
    step = hours * 3600
    sec = F.col("slot").cast("timestamp").cast("double")
    seen = observed.withColumn("_s", F.floor(sec / step)).withColumn("_late", sec - F.col("_s") * step)
    span = seen.groupBy("run_id").agg(F.min("_s").alias("a"), F.max("_s").alias("b")).filter("b - a > 1")
    grid = span.select("run_id", F.explode(F.expr("sequence(a + 1, b - 1)")).alias("_s"))
    ok = seen.filter(F.col("_late") <= grace_minutes * 60).select("run_id", "_s").distinct()
    return grid.join(ok, ["run_id", "_s"], "left_anti").select("run_id", (F.col("_s") * step).cast("timestamp").cast("timestamp_ntz").alias("slot"))


def lineage_status(sources: DataFrame, catalog: DataFrame, key: list[str]) -> DataFrame:
    """OK, MISSING or AMBIGUOUS: how many catalog entries each source has."""
    n = catalog.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return sources.join(n, key, "left").withColumn("status", F.when(F.col("_n").isNull(), "MISSING").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("OK")).drop("_n")


def next_bar_fill(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """A signal at a bar fills at the next bar's open; reason where it can't. signals: asset, event_time, signal_id."""
    after = {"fill_price": F.lead("open", 1).over(W()), "fill_time": F.lead("event_time", 1).over(W())}
    b = in_blocks(bars.select("asset", "event_time", "open"), lambda f: f.withColumns(after), after=1).drop("open").withColumn("_in", F.lit(True))
    turn = F.row_number().over(Window.partitionBy("asset", "event_time").orderBy("signal_id"))
    j = signals.withColumn("_rn", turn).join(b, ["asset", "event_time"], "left")
    reason = F.when(F.col("_rn") > 1, "DUPLICATE_SIGNAL").when(F.col("_in").isNull(), "TIMESTAMP_NOT_IN_BARS").when(F.col("fill_time").isNull(), "NO_NEXT_BAR")
    return j.withColumn("reason", reason).withColumn("fill_price", F.when(reason.isNull(), F.col("fill_price"))).drop("_rn", "_in")


def uncommon_times(bars: DataFrame, assets: int) -> DataFrame:
    """Times at which not every asset has a bar."""
    return bars.groupBy("event_time").agg(F.countDistinct("asset").alias("present")).filter(F.col("present") != assets)


def same_sets(left: DataFrame, right: DataFrame, key: list[str], item: str) -> DataFrame:
    """Whether each key has equal sets of items on both sides."""
    of = lambda f, n: f.groupBy(*key).agg(F.array_sort(F.collect_set(item)).alias(n))
    return of(left, "_l").join(of(right, "_r"), key, "full").select(*key, F.coalesce(F.col("_l") == F.col("_r"), F.lit(False)).alias("equal"))

