"""Walk-forward folds, inference under many tests, bootstraps, redundancy, increments, gates."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.functions.factors import W, average_rank, corr, log_return, realized_volatility
from asofly.operators.cross_section import taker_imbalance
from asofly.operators.labels import open_to_open
from asofly.operators.prefix import prefix_quantiles, prefix_sums
from asofly.operators.regimes import QUANTILES
from asofly.operators.timeblocks import POS, in_blocks, numbered
from asofly.plans.shared import stash


def research_holdout(bars: DataFrame, share: float) -> DataFrame:
    """Rows of each asset before and after a split by position, and how many lie in both (none)."""
    n = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("_n"))
    early = F.col("pos") + 1 <= F.floor(share * F.col("_n"))
    return numbered(bars).join(n, "asset").groupBy("asset").agg(F.count_if(early).alias("research"), F.count_if(~early).alias("holdout"), F.count_if(early & ~early).alias("overlap"))


def weight_turnover(before: DataFrame, after: DataFrame) -> DataFrame:
    """Weights of two moments over the union of their assets, absent ones 0."""
    j = before.select("asset", F.col("weight").alias("_b")).join(after.select("asset", F.col("weight").alias("_a")), "asset", "full")
    j = j.select("asset", F.coalesce("_b", F.lit(0.0)).alias("before"), F.coalesce("_a", F.lit(0.0)).alias("after"))
    return j.withColumn("turnover", F.abs(F.col("after") - F.col("before")))


def walk_forward(frame: DataFrame, *, initial: int | Column, test: int | Column, purge: int = 0, embargo: int = 0, folds: int | None = None) -> DataFrame:
    """Rows with the folds they serve: fold k tests positions [initial + k test, + test), and trains on all before it
    less the purge (label horizon) and the embargo.

    A row serves one fold as a test row (test_fold) and all from train_from on as a training row (null: none), which is one
    row, however many folds there are; last_fold is the asset's last. Statistics of training rows are those of a prefix:
    fold_counts and operators.prefix merge them over the folds. initial and test may be made of `_n`, the asset's rows.
    folds: so many at most. Assets without a whole fold are left out.
    """
    n = frame.groupBy("asset").agg(F.count(F.lit(1)).alias("_n"))
    p = numbered(frame).join(n, "asset").withColumn("_initial", F.lit(initial) if isinstance(initial, int) else initial).withColumn("_test", F.lit(test) if isinstance(test, int) else test)
    initial, test = F.col("_initial"), F.col("_test")
    last = F.floor((F.col("_n") - initial) / test) - 1
    p = p.withColumn("last_fold", last if folds is None else F.least(last, F.lit(folds - 1))).filter("last_fold >= 0")
    own = F.when(F.col("pos") >= initial, F.floor((F.col("pos") - initial) / test))
    first = F.greatest(F.ceil((F.col("pos") + 1 + purge + embargo - initial) / test), F.lit(0))
    within = lambda c: F.when(c <= F.col("last_fold"), c)
    return p.withColumn("test_fold", within(own)).withColumn("train_from", within(first)).drop("_initial", "_test", "_n")


def simple_folds(frame: DataFrame, *, folds: int, purge: int = 0, embargo: int = 0) -> DataFrame:
    """walk_forward with so many equal test blocks after a first training block of the same length."""
    block = F.greatest(F.floor(F.col("_n") / (folds + 1)), F.lit(1))
    return walk_forward(frame, initial=block, test=block, purge=purge, embargo=embargo, folds=folds)


def fold_counts(rows: DataFrame) -> DataFrame:
    """asset, fold, test_rows and train_rows of rows from walk_forward, training rows merged over the folds."""
    last = rows.groupBy("asset").agg(F.max("last_fold").alias("last"))
    test = rows.filter("test_fold is not null").select("asset", F.col("test_fold").alias("block"), F.lit(1).alias("test_rows"), F.lit(0).alias("train_rows"))
    train = rows.filter("train_from is not null").select("asset", F.col("train_from").alias("block"), F.lit(0).alias("test_rows"), F.lit(1).alias("train_rows"))
    tested = test.groupBy("asset", F.col("block").alias("fold")).agg(F.sum("test_rows").alias("test_rows"))
    trained = prefix_sums(train, last, ["train_rows"], key="asset").withColumnRenamed("block", "fold")
    return trained.join(tested, ["asset", "fold"], "left").fillna(0, ["test_rows"]).select("asset", "fold", "test_rows", "train_rows")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    from math import exp, lgamma, log

    if not np.isfinite(t) or df <= 0:
        return 0.0 if np.isinf(t) and df > 0 else float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def _spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for r, k in zip(rho, n, strict=True):
        if r is None or not np.isfinite(r) or k < 30:
            out.append(None)
        else:
            out.append(0.0 if abs(r) >= 1 else t_two_sided(r * np.sqrt((k - 2) / (1 - r * r)), k - 2))
    return pd.Series(out, dtype="float64")


def spearman_p(rho: str, n: str) -> Column:
    """p-value of a rank correlation by the t approximation, null under 30 rows. For slice tables, which are small."""
    return F.pandas_udf(_spearman_p, "double")(rho, n)


def cross_section_ic(frame: DataFrame, x: str, y: str, *, least: int = 3) -> DataFrame:
    """Rank correlation across assets at each time with at least `least`, then its mean, deviation, number and t."""
    ok = frame.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = ok.withColumn("_rx", average_rank(x, ["event_time"])).withColumn("_ry", average_rank(y, ["event_time"]))
    ic = r.groupBy("event_time").agg(F.count(F.lit(1)).alias("_n"), corr("_rx", "_ry").alias("ic")).filter((F.col("_n") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))
    out = ic.agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("t", F.try_divide(F.col("mean_ic") * F.sqrt("n"), F.col("std_ic"))).withColumn("p", normal_two_sided("t"))


def normal_two_sided(t: str, terms: int = 80) -> Column:
    """Two-sided p-value of a standard normal, erfc(|t| / sqrt 2), to about 1e-12 of its size down to where doubles end.

    Under 2 it's 1 less the series erf(x) = 2 x exp(-x^2) / sqrt(pi) * sum of (2 x^2)^n / (2n + 1)!!; from there on, where
    that difference would lose its digits, the continued fraction exp(-x^2) / sqrt(pi) / (x + 1/2 / (x + 2/2 / (x + ...))).
    """
    x = F.abs(F.col(t)) / F.sqrt(F.lit(2.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    root = F.sqrt(F.lit(3.141592653589793))
    erf = 2 * x * F.exp(-x * x) / root * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["total"])
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1)), x, lambda f, n: x + n / 2.0 / f)
    return F.when(x < 2, 1 - erf).otherwise(F.exp(-x * x) / root / fraction)


def benjamini_hochberg(tests: DataFrame, *, p: str = "p", key: str = "name", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """rank, critical value, adjusted p (monotone) and decision; ties by key. Null and NaN p-values aren't counted."""
    by = by or []
    ok = tests.filter(F.col(p).isNotNull() & ~F.isnan(p))
    order = Window.partitionBy(*by).orderBy(p, key)
    out = ok.withColumn("rank", F.row_number().over(order)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    out = out.withColumn("critical", F.col("rank") / F.col("_m") * alpha)
    adjusted = F.min(F.col(p) * F.col("_m") / F.col("rank")).over(Window.partitionBy(*by).orderBy(F.desc("rank")))
    limit = F.max(F.when(F.col(p) <= F.col("critical"), F.col("rank"))).over(Window.partitionBy(*by))
    return out.withColumn("adjusted", F.least(adjusted, F.lit(1.0))).withColumn("reject", F.coalesce(F.col("rank") <= limit, F.lit(False))).drop("_m")


def spread_rank(frame: DataFrame, x: str, by: list[str], name: str, buckets: int = 256) -> DataFrame:
    """The frame with tie-averaged ranks of x within few, very large groups: no task holds a whole group.

    Values are counted, dealt into ranges between approximate quantiles, and ranked within a range on top of the ranges below.
    """
    counts = frame.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n"))
    edges = frame.groupBy(*by).agg(F.percentile_approx(x, [i / buckets for i in range(1, buckets)]).alias("_edges"))
    own = F.size(F.filter("_edges", lambda q: q < F.col(x)))
    counts = counts.join(F.broadcast(edges), by).withColumn("_k", own).drop("_edges")  # a row for each of few groups
    below = counts.groupBy(*by, "_k").agg(F.sum("_n").alias("_t"))
    below = below.withColumn("_below", F.coalesce(F.sum("_t").over(Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    within = F.sum("_n").over(Window.partitionBy(*by, "_k").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.withColumn("_up", within).join(F.broadcast(below), [*by, "_k"]).select(*by, x, (F.col("_below") + F.col("_up") - (F.col("_n") - 1) / 2).alias(name))
    return frame.join(ranks, [*by, x])


def rank_correlations(frame: DataFrame, names: list[str]) -> DataFrame:
    """Spearman correlation of every pair of factor columns over the rows that have both: one row per pair."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]))
    known = stash(frame.select(*dict.fromkeys(names)), "factors")  # read several times
    long = known.select(F.explode(pairs).alias("p")).select("p.*").filter("x is not null and y is not null")
    r = spread_rank(spread_rank(long, "x", ["a", "b"], "_rx"), "y", ["a", "b"], "_ry")
    return r.groupBy("a", "b").agg(corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def redundancy_clusters(correlations: list[tuple[str, str, float]], names: list[str], cut: float = 0.3) -> dict[str, int]:
    """Average-linkage clusters of factors at distance 1 - |rho|, ties by name. For the few factors of a run."""
    far = {frozenset((a, b)): 1 - abs(r) for a, b, r in correlations if r is not None and np.isfinite(r)}
    groups = [[n] for n in sorted(names)]
    between = lambda g, h: np.mean([far.get(frozenset((a, b)), 1.0) for a in g for b in h])
    while len(groups) > 1:
        d, i, j = min((between(g, h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if d > cut:
            break
        groups[i] = sorted(groups[i] + groups.pop(j))
    return {n: k for k, g in enumerate(groups) for n in g}


def gram(frame: DataFrame, columns: list[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of the columns with each other and with the target, in one aggregate."""
    ok = frame.dropna(subset=[*columns, target])
    sums = [F.sum(F.col(a) * F.col(b)) for a in columns for b in [*columns, target]]
    row = [float(v or 0.0) for v in ok.agg(*sums).first()]
    m = np.array(row).reshape(len(columns), len(columns) + 1)
    return m[:, :-1], m[:, -1]


def ridge(frame: DataFrame, columns: list[str], target: str, penalty: float = 1.0) -> list[float]:
    """Coefficients without intercept, the penalty unscaled."""
    a, b = gram(frame, columns, target)
    return np.linalg.solve(a + penalty * np.eye(len(columns)), b).tolist()


def predicted(columns: list[str], weights: list[float]) -> Column:
    return sum((F.col(c) * w for c, w in zip(columns, weights, strict=True)), F.lit(0.0))


def increment(train: DataFrame, valid: DataFrame, base: list[str], candidate: str, target: str, *, cost_bps: float) -> DataFrame:
    """One row: correlation and cost-adjusted return on validation of ridge fits without and with a candidate, and a verdict.

    Rows with any value missing are left out; with fewer than five on either side all figures are null and there's no gain.
    Turnover is the mean step of a position within an asset.
    """
    columns = [*base, candidate, target]
    rows, v = train.dropna(subset=columns), valid.dropna(subset=columns)
    fits = {"baseline": predicted(base, ridge(rows, base, target)) if base else F.lit(0.0), "extended": predicted([*base, candidate], ridge(rows, [*base, candidate], target))}
    figures = [corr(candidate, target).alias("_standalone"), F.count(F.lit(1)).alias("n_valid")]
    v = v.withColumns({f"_p_{name}": p for name, p in fits.items()} | {f"_s_{name}": F.signum(p) for name, p in fits.items()})
    v = in_blocks(v, lambda f: f.withColumns({f"_d_{name}": F.abs(F.col(f"_s_{name}") - F.lag(f"_s_{name}", 1).over(W())) for name in fits}), before=1)
    for name in fits:
        figures += [corr(f"_p_{name}", target).alias(f"_ic_{name}"), (F.avg(F.col(f"_s_{name}") * F.col(target)) - F.coalesce(F.avg(f"_d_{name}"), F.lit(0.0)) * cost_bps / 10000).alias(f"_return_{name}")]
    out = v.agg(*figures).crossJoin(rows.agg(F.count(F.lit(1)).alias("n_train")))  # one row each
    enough = (F.col("n_valid") >= 5) & (F.col("n_train") >= 5)
    fit = lambda c: F.when(enough, F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)))
    out = out.select("n_train", "n_valid", *(fit(c).alias(c[1:]) for c in ("_standalone", "_ic_baseline", "_ic_extended", "_return_baseline", "_return_extended")))
    gain = (F.col("ic_extended") - F.col("ic_baseline") > 0.001) & (F.col("return_extended") > F.col("return_baseline"))
    return out.withColumn("incremental", F.coalesce(gain, F.lit(False)))


def largest_share(column: str, where: Column, by: list[str], frame: DataFrame, name: str) -> DataFrame:
    """Largest share of one value among the rows that satisfy a condition, per group; 0 without any."""
    n = frame.groupBy(*by, column).agg(F.count_if(where).alias("_n"))
    return n.groupBy(*by).agg(F.coalesce(F.try_divide(F.max("_n"), F.sum("_n")), F.lit(0.0)).alias(name))


def development_gate(slices: DataFrame, facts: DataFrame, *, least_n: int = 30, check_hourly: bool = True) -> DataFrame:
    """Reasons against each factor, in a fixed order, and what they rest on; passed: there's none.

    slices: factor_id, fold, asset, regime, n, rank_ic, reject. facts, one row per factor: direction (1, -1, or 0 for the
    sign of most slices), representative, delta_5bps and delta_10bps (incremental returns), hour_direction (null if unknown),
    delay_directions (an array, null where delays don't matter; three are expected).
    """
    s = slices.filter((F.col("n") >= least_n) & F.col("rank_ic").isNotNull() & ~F.isnan("rank_ic"))
    most = s.groupBy("factor_id").agg(F.count_if(F.col("rank_ic") > 0).alias("_up"), F.count_if(F.col("rank_ic") != 0).alias("_moved"))
    f = facts.join(most, "factor_id", "left").withColumn("target", F.when(F.col("direction") != 0, F.col("direction")).when(F.coalesce("_moved", F.lit(0)) == 0, 0).when(F.col("_up") >= F.col("_moved") / 2, 1).otherwise(-1))
    s = s.join(f.select("factor_id", "target"), "factor_id").withColumn("_fits", F.signum("rank_ic") == F.col("target"))
    backed = F.col("reject") & F.col("_fits")
    g = s.groupBy("factor_id").agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if("reject").alias("survivors"), F.countDistinct(F.when(F.col("reject"), F.struct("fold", "asset", "regime"))).alias("_apart"),
        F.count_if("_fits").alias("_n_fits"), F.countDistinct(F.when(F.col("reject"), F.col("asset"))).alias("assets"),
    )
    g = f.join(g, "factor_id", "left").join(largest_share("asset", backed, ["factor_id"], s, "asset_share"), "factor_id", "left").join(largest_share("regime", backed, ["factor_id"], s, "regime_share"), "factor_id", "left")
    g = g.fillna(0, ["eligible", "survivors", "_apart", "_n_fits", "assets", "asset_share", "regime_share"]).withColumn("agreement", F.coalesce(F.try_divide(F.col("_n_fits"), F.col("eligible")), F.lit(0.0)))
    hour, delays = F.coalesce("hour_direction", F.lit(0)), F.col("delay_directions")
    rules = [
        ("BH_SURVIVING_SLICES_LT_2", F.col("survivors") < 2), ("INDEPENDENT_SLICES_LT_2", F.col("_apart") < 2), ("DIRECTION_AGREEMENT_LT_60PCT", F.col("agreement") < 0.6), ("ASSETS_LT_2", F.col("assets") < 2),
        ("REDUNDANT_NON_REPRESENTATIVE", ~F.col("representative")), ("FINAL_FOLD_5BPS_NON_POSITIVE", ~F.coalesce(F.col("delta_5bps") > 0, F.lit(False))), ("TEN_BPS_NEGATIVE", ~F.coalesce(F.col("delta_10bps") >= 0, F.lit(False))),
        ("ASSET_SUPPORT_CONCENTRATION_GT_50PCT", F.col("asset_share") > 0.5), ("REGIME_SUPPORT_CONCENTRATION_GT_50PCT", F.col("regime_share") > 0.5),
        ("ONE_HOUR_SENSITIVITY_UNAVAILABLE", F.lit(check_hourly) & (hour == 0)), ("ONE_HOUR_DIRECTION_UNSTABLE", F.lit(check_hourly) & (hour != 0) & (hour != F.col("target"))),
        ("OI_DELAY_STABILITY_UNAVAILABLE", delays.isNotNull() & (F.size(delays) < 3)), ("OI_DELAY_DIRECTION_UNSTABLE", (F.size(delays) >= 3) & F.exists(delays, lambda x: (x == 0) | (x != F.col("target")))),
    ]
    out = g.withColumn("reasons", F.array_compact(F.array(*(F.when(rule, code) for code, rule in rules)))).withColumn("passed", F.size("reasons") == 0)
    return out.select("factor_id", "target", "eligible", "survivors", "agreement", "assets", "asset_share", "regime_share", "reasons", "passed")


def held_weights(weights: DataFrame, returns: DataFrame, *, fee_bps: float) -> DataFrame:
    """Per time: status, gross return of the target weights, turnover against the weights held until then, fee, net.

    weights: event_time, asset, weight; returns: event_time, asset, ret. Until the next time a weight drifts with its own
    return and is divided by one plus the book's return; an asset that is held but no longer named is sold. A time with a
    weight whose return is null or not finite is EXECUTION_BAR_INVALID, one whose book loses everything
    NONPOSITIVE_DENOMINATOR: it has no gross return, and the time after it no turnover, since what was held isn't known.
    """
    ret = F.when(~F.isnan("ret") & (F.abs("ret") != float("inf")), F.col("ret"))
    j = weights.join(returns, ["event_time", "asset"], "left").withColumn("_r", ret).withColumn("_on", F.col("weight") != 0)
    book = j.groupBy("event_time").agg(F.sum(F.col("weight") * F.coalesce("_r", F.lit(0.0))).alias("gross"), F.count_if(F.col("_on") & F.col("_r").isNull()).alias("bad_bars"), F.count_if("_on").alias("active"))
    w = Window.orderBy("event_time")  # one row per time
    book = book.withColumn("status", F.when(F.col("bad_bars") > 0, "EXECUTION_BAR_INVALID").when(1 + F.col("gross") <= 0, "NONPOSITIVE_DENOMINATOR").otherwise("OK"))
    book = book.withColumns({"_next": F.lead("event_time", 1).over(w), "_known": F.coalesce(F.lag("status", 1).over(w) == "OK", F.lit(True)), "drifted": F.coalesce((F.lag("status", 1).over(w) == "OK") & (F.lag("active", 1).over(w) > 0), F.lit(False))})
    grown = F.try_divide(F.col("weight") * (1 + F.coalesce("_r", F.lit(0.0))), 1 + F.col("gross"))
    held = j.join(book.filter("status = 'OK'").select("event_time", "gross", "_next"), "event_time").select(F.col("_next").alias("event_time"), "asset", F.lit(0.0).alias("_to"), grown.alias("_from")).filter("event_time is not null")
    moved = j.select("event_time", "asset", F.col("weight").alias("_to"), F.lit(0.0).alias("_from")).unionByName(held).groupBy("event_time", "asset").agg(F.abs(F.sum("_to") - F.sum("_from")).alias("_t"))
    out = book.join(moved.groupBy("event_time").agg(F.sum("_t").alias("turnover")), "event_time").withColumn("turnover", F.when(F.col("_known"), F.col("turnover")))
    out = out.withColumn("gross", F.when(F.col("status") == "OK", F.col("gross"))).withColumn("fee", F.col("turnover") * fee_bps / 10000)
    return out.withColumn("net", F.col("gross") - F.col("fee")).drop("_next", "_known")


def book_summary(book: DataFrame) -> DataFrame:
    """One row: bars in all, flat, active, drifted into, refused, and total turnover and fee of held_weights."""
    live = (F.col("active") > 0) & (F.col("status") == "OK")
    return book.agg(
        F.count(F.lit(1)).alias("total_bars"), F.count_if(F.col("active") == 0).alias("flat_bars"), F.count_if(live).alias("active_bars"), F.count_if("drifted").alias("drifted_bars"),
        F.count_if(F.col("status") != "OK").alias("refused_bars"), F.sum("turnover").alias("turnover"), F.sum("fee").alias("fee"),
    )


SLICE = ["factor_id", "horizon", "q", "fold", "asset", "regime"]


def with_bitmaps(rows: DataFrame, keys: list[str], position: str, *aggregates: Column) -> DataFrame:
    """One row for each key: the aggregates, and bars, bitmaps of the positions that are not null: an array of bucket (of
    32,768 positions) and bits."""
    some = rows.filter(F.col(position).isNotNull()).groupBy(*keys, F.bitmap_bucket_number(position).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits"))
    maps = some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("bars"))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    own = rows.groupBy(*keys).agg(*aggregates) if aggregates else rows.select(*keys).distinct()
    out = own.join(maps.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "bars"), reduce(and_, same), "left").drop(*(f"_k{i}" for i in range(len(keys))))
    return out.withColumn("bars", F.coalesce("bars", F.expr("cast(array() as array<struct<bucket:bigint,bits:binary>>)")))


def overlapping(slices: DataFrame, key: str, within: str) -> DataFrame:
    """Keys of slices (key, within, bars as bitmaps) that share a position with another one of the same `within`.

    A slice overlaps those before it in some order if their union and it hold more positions than their union with it; and
    likewise those after it. So bitmaps are merged along two windows, and neither positions nor pairs become rows.
    """
    maps = slices.select(key, within, F.inline("bars")).groupBy(within, "bucket", key).agg(F.bitmap_or_agg("bits").alias("bits"))
    count = lambda order, last: F.bitmap_count(F.bitmap_or_agg("bits").over(Window.partitionBy(within, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, last)))
    met = [F.coalesce(count(order, -1), F.lit(0)) + F.bitmap_count("bits") > count(order, 0) for order in (F.col(key).asc(), F.col(key).desc())]
    return maps.withColumn("_met", met[0] | met[1]).filter("_met").select(key).distinct()


def family_gate(slices: DataFrame, units: DataFrame, *, horizons: list[str], qs: list[float], primary: tuple[str, float], blocked: list[str] | None = None, direction: int = 1, alpha: float = 0.05, least_n: int = 30, least_family: int = 1) -> DataFrame:
    """One row: verdict (PASS, FAIL, INSUFFICIENT, BLOCKED), ordered reasons, and what they rest on.

    slices: SLICE, p, direction_estimate, n_effective, bars (bitmaps of the positions it was tested on, by `with_bitmaps`); units: fold, asset, regime,
    effective, missing, infeasible: the cells that were registered beforehand, each with every factor, horizon and q. All
    slices of the family are adjusted together; the verdict looks at the primary horizon and q alone. Survivors of one asset
    that share bars aren't independent and don't count. Preconditions that failed (`blocked`) end it before anything is read.
    """
    if blocked:
        return units.agg(F.count(F.lit(1)).alias("units")).select(F.lit("BLOCKED").alias("verdict"), F.array(*map(F.lit, blocked)).alias("reasons"), "units", *(F.lit(None).cast("long").alias(c) for c in ("denominator", "survivors", "assets")), *(F.lit(None).cast("double").alias(c) for c in ("consistency", "asset_share", "regime_share")))
    key = F.concat_ws("|", *SLICE)
    adjusted = benjamini_hochberg(slices.withColumn("_key", key), key="_key", alpha=alpha).select("_key", "adjusted")
    s = slices.withColumn("_key", key).join(adjusted.groupBy("_key").agg(F.min("adjusted").alias("adjusted")), "_key", "left")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    cells = ["fold", "asset", "regime"]
    grid = units.select(*cells).distinct().withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    grid = grid.crossJoin(F.broadcast(slices.select("factor_id").distinct())).select(F.concat_ws("|", *SLICE).alias("_key"))  # a family's few factors
    seen = s.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    holes = grid.join(seen, "_key", "left_anti").agg(F.count(F.lit(1)).alias("missing_slices"))
    odd = seen.join(grid.withColumn("_in", F.lit(True)), "_key", "left").agg(F.count_if(F.col("_n") > 1).alias("double_slices"), F.count_if(F.col("_in").isNull()).alias("unknown_slices"))
    whole = s.agg(F.count_if(finite("p")).alias("denominator"), F.count_if(~finite("p")).alias("no_p"), F.count_if(~finite("direction_estimate")).alias("no_direction"))
    u = units.agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("effective") == 0).alias("empty_units"), F.coalesce(F.try_divide(F.sum(F.col("missing") + F.col("infeasible")), F.sum(F.col("effective") + F.col("missing") + F.col("infeasible"))), F.lit(0.0)).alias("excluded"), (F.count(F.lit(1)) - F.countDistinct(*cells)).alias("double_units"))
    p = s.filter((F.col("horizon") == primary[0]) & (F.col("q") == primary[1]))
    strong = p.filter((F.col("n_effective") >= least_n) & (F.col("adjusted") < alpha))
    left = strong.join(overlapping(strong, "_key", "asset"), "_key", "left_anti")
    fits = F.signum("direction_estimate") == direction
    main = p.agg(F.count_if(F.col("n_effective") < least_n).alias("small_cells"), F.count_if((F.col("n_effective") >= least_n) & finite("direction_estimate")).alias("_eligible"), F.count_if((F.col("n_effective") >= least_n) & finite("direction_estimate") & fits).alias("_fits"))
    lives = left.agg(F.count(F.lit(1)).alias("survivors"), F.countDistinct("asset").alias("assets"))
    for c in ("asset", "regime"):
        lives = lives.crossJoin(left.groupBy(c).count().agg(F.coalesce(F.try_divide(F.max("count"), F.sum("count")), F.lit(0.0)).alias(f"{c}_share")))
    r = whole.crossJoin(u).crossJoin(holes).crossJoin(odd).crossJoin(main).crossJoin(lives)  # one row each
    r = r.withColumn("consistency", F.coalesce(F.try_divide(F.col("_fits"), F.col("_eligible")), F.lit(0.0)))
    thin = [
        ("ZERO_BAR_PREREGISTERED_UNIT", F.col("empty_units") > 0), ("BH_DENOMINATOR_BELOW_MINIMUM", F.col("denominator") < least_family), ("EXCLUSION_RATIO_EXCEEDS_TOLERANCE", F.col("excluded") > 0.5), ("INSUFFICIENT_CELL", F.col("small_cells") > 0),
        ("DUPLICATE_PREREGISTERED_UNIT", F.col("double_units") > 0), ("PREREGISTERED_SLICE_MISSING", F.col("missing_slices") > 0), ("DUPLICATE_SLICE_KEY", F.col("double_slices") > 0), ("UNREGISTERED_SLICE", F.col("unknown_slices") > 0),
        ("MISSING_P_VALUE", F.col("no_p") > 0), ("MISSING_DIRECTION_ESTIMATE", F.col("no_direction") > 0),
    ]
    bad = [
        ("ASSET_DIVERSITY_BELOW_MINIMUM", F.col("assets") < 2), ("ASSET_CONCENTRATION_EXCEEDS_MAX", F.col("asset_share") > 0.5), ("REGIME_CONCENTRATION_EXCEEDS_MAX", F.col("regime_share") > 0.5), ("DIRECTION_CONSISTENCY_BELOW_MINIMUM", F.col("consistency") < 0.6),
    ]
    codes = lambda rules: F.array_compact(F.array(*(F.when(rule, code) for code, rule in rules)))
    r = r.withColumn("_thin", codes(thin)).withColumn("_bad", codes(bad))
    few = F.col("survivors") < 2
    verdict = F.when((F.size("_thin") > 0) | few, "INSUFFICIENT").when(F.size("_bad") > 0, "FAIL").otherwise("PASS")
    reasons = F.when(F.size("_thin") > 0, F.col("_thin")).when(few, F.array(F.lit("SURVIVING_SLICES_BELOW_MINIMUM"))).otherwise(F.col("_bad"))
    return r.select(verdict.alias("verdict"), reasons.alias("reasons"), "units", "denominator", "survivors", "assets", "consistency", "asset_share", "regime_share")


def holdout_evaluation(frame: DataFrame, x: str, y: str, *, direction: int, delayed: dict[int, str] | None = None) -> DataFrame:
    """One row: assets, mean return in each asset's own direction, what 5 and 10 bps leave of it, reasons, passed.

    delayed: columns of the same factor under several publication delays, whose direction must be that of the factor.
    """
    every = {"x": x, **{f"d{k}": c for k, c in (delayed or {}).items()}}
    long = frame.select("asset", F.col(y).alias("_y"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in every.items()))).alias("_v")).select("asset", "_y", "_v.*")
    r = long.filter(F.col("value").isNotNull() & F.col("_y").isNotNull())
    r = r.withColumn("_rx", average_rank("value", ["name", "asset"])).withColumn("_ry", average_rank("_y", ["name", "asset"]))
    ic = r.groupBy("name", "asset").agg(corr("_rx", "_ry").alias("ic")).filter(F.col("ic").isNotNull() & ~F.isnan("ic"))
    mean = frame.filter(F.col(y).isNotNull()).groupBy("asset").agg(F.avg(y).alias("_mean"))
    own = ic.filter("name = 'x'").join(mean, "asset").withColumn("_ret", F.signum("ic") * F.col("_mean"))
    out = own.agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.signum("ic") != direction).alias("_against"), F.count_if(F.col("_ret") > 0).alias("_support"), F.avg("_ret").alias("mean_return"))
    rules = [
        ("HOLDOUT_ASSET_COVERAGE_LT_2", F.col("assets") < 2), ("HOLDOUT_DIRECTION_UNSTABLE", F.lit(direction != 0) & (F.col("_against") > 0)), ("HOLDOUT_ASSET_CONCENTRATION_GT_50PCT", F.col("_support") == 1),
        ("HOLDOUT_5BPS_NON_POSITIVE", ~F.coalesce(F.col("mean_return") - 0.0005 > 0, F.lit(False))), ("HOLDOUT_10BPS_NEGATIVE", ~F.coalesce(F.col("mean_return") - 0.0010 >= 0, F.lit(False))),
    ]
    if delayed is not None:
        d = ic.filter("name <> 'x'").groupBy("name").agg(F.signum(F.median("ic")).alias("_s")).agg(F.count(F.lit(1)).alias("_delays"), F.count_if(F.col("_s") != direction).alias("_off"))
        out = out.crossJoin(d)  # one row each
        rules += [("HOLDOUT_OI_DELAY_STRESS_UNAVAILABLE", F.col("_delays") < 3), ("HOLDOUT_OI_DELAY_DIRECTION_UNSTABLE", (F.col("_delays") >= 3) & F.lit(direction != 0) & (F.col("_off") > 0))]
    out = out.withColumn("after_5bps", F.col("mean_return") - 0.0005).withColumn("after_10bps", F.col("mean_return") - 0.0010)
    out = out.withColumn("reasons", F.array_compact(F.array(*(F.when(rule, code) for code, rule in rules)))).withColumn("passed", F.size("reasons") == 0)
    return out.select("assets", "mean_return", "after_5bps", "after_10bps", "reasons", "passed")


def horizon_diagnostics(slices: DataFrame) -> DataFrame:
    """Slices (SLICE, p) with the p-value adjusted over their whole family, for the record only: no verdict looks at them."""
    key = F.concat_ws("|", *SLICE)
    adjusted = benjamini_hochberg(slices.withColumn("_key", key), key="_key").select("_key", "adjusted")
    return slices.withColumn("_key", key).join(adjusted, "_key", "left").drop("_key").withColumn("diagnostic_only", F.lit(True))


def near_equivalents(correlations: DataFrame, factor: str, *, threshold: float = 0.7) -> DataFrame:
    """other_factor_id, rank_ic and label: which existing factors one nearly repeats. correlations: of rank_correlations."""
    other = F.when(F.col("a") == factor, F.col("b")).otherwise(F.col("a"))
    label = F.when(F.abs("rho") > threshold, "statistically_near_equivalent").otherwise("")
    return correlations.filter((F.col("a") == factor) | (F.col("b") == factor)).select(other.alias("other_factor_id"), F.col("rho").alias("rank_ic"), label.alias("label"))


def gate_inputs(bars: DataFrame, *, horizons: tuple[int, ...], qs: tuple[float, ...] = (0.2,), bar_hours: int, window: int = 48, least_volume: float = 0.0, least_rows: int = 100) -> DataFrame:
    """Per asset, fold, regime, horizon (bars held) and q: the cell's rows with signal and label, rows without a next bar or
    with one that can't be traded, the slice's number, rank correlation and p-value of signal and label (null under 30 rows
    or where one of them doesn't vary), and bars, the positions of the cell as bitmaps. What family_gate takes is made of it
    by gate_slices and gate_units.

    The signal is the cross-sectional taker imbalance, the label the open-to-open return; folds are anchored (a quarter of
    an asset's rows to begin with, thirds of the rest to test) and a regime is high where volatility exceeds the quantile of
    the fold's own training rows. Assets with fewer than least_rows bars have no folds.
    """
    f = numbered(taker_imbalance(bars).withColumnRenamed("value", "signal").drop("reason"), POS)
    f = in_blocks(f, lambda g: g.withColumn("_lr", log_return("close")).withColumn("volatility", realized_volatility("_lr", window)), before=window)
    for k in horizons:
        f = open_to_open(f, holding_bars=k, bar_hours=bar_hours, least_volume=least_volume).withColumnRenamed("label", f"_y{k}").withColumnRenamed("reason", f"_r{k}")
    enough = f.groupBy("asset").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= least_rows).select("asset")
    initial = F.greatest(F.lit(60), F.floor(F.col("_n") / 4))
    folds = walk_forward(f.join(enough, "asset", "left_semi"), initial=initial, test=F.greatest(F.lit(30), F.floor((F.col("_n") - initial) / 3)), purge=1, embargo=6)
    folds = stash(folds.select("asset", "event_time", "pos", "test_fold", "train_from", "last_fold", "signal", "volatility", *(f"_{x}{k}" for x in "yr" for k in horizons)), "folds")
    last = folds.groupBy("asset").agg(F.max("last_fold").alias("last"))
    train = folds.filter("train_from is not null").select("asset", F.col("train_from").alias("block"), "volatility")
    limits = prefix_quantiles(train, last, {"volatility": QUANTILES["volatility"]}, key="asset", prefix="_q_").select("asset", F.col("block").alias("fold"), F.col("_q_volatility").alias("_q"))
    t = folds.filter("test_fold is not null").withColumnRenamed("test_fold", "fold").join(limits, ["asset", "fold"]).withColumn("regime", F.when(F.coalesce(F.col("volatility") > F.col("_q"), F.lit(False)), "high_vol").otherwise("low_vol"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("horizon"), F.col(f"_y{k}").alias("y"), F.col(f"_r{k}").alias("why")) for k in horizons)))
    cells = with_bitmaps(t, ["asset", "fold", "regime"], "pos")
    t = t.select("asset", "fold", "regime", "signal", each.alias("_h")).select("asset", "fold", "regime", "signal", "_h.*")
    by = ["asset", "fold", "regime", "horizon"]
    both = F.col("signal").isNotNull() & F.col("y").isNotNull()
    units = t.groupBy(*by).agg(F.count_if(both).alias("effective"), F.count_if(F.col("why") == "MISSING_NEXT_BAR").alias("missing"), F.count_if(F.col("why") == "EXECUTION_BAR_INVALID").alias("infeasible"))
    r = t.filter(both).withColumn("_rx", average_rank("signal", by)).withColumn("_ry", average_rank("y", by))
    stats = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n_effective"), F.nullif(corr("_rx", "_ry"), F.lit(float("nan"))).alias("direction_estimate"))
    out = units.join(stats, by, "left").fillna(0, ["n_effective"]).join(cells, ["asset", "fold", "regime"])
    return out.withColumn("p", spearman_p("direction_estimate", "n_effective")).withColumn("q", F.explode(F.array(*map(F.lit, qs))))


def gate_slices(inputs: DataFrame, factor: str) -> DataFrame:
    """The slices of family_gate from gate_inputs; without a p-value there's no direction either."""
    known = F.col("p").isNotNull()
    return inputs.select(F.lit(factor).alias("factor_id"), F.concat(F.col("horizon").cast("string"), F.lit("h")).alias("horizon"), "q", F.concat(F.lit("fold_"), F.col("fold").cast("string")).alias("fold"), "asset", "regime", "p", F.when(known, F.col("direction_estimate")).alias("direction_estimate"), "n_effective", "bars")


def gate_units(inputs: DataFrame, primary: int) -> DataFrame:
    """The registered units of family_gate from gate_inputs: the cells of the primary horizon."""
    one = inputs.filter(F.col("horizon") == primary).groupBy("asset", "fold", "regime").agg(*(F.first(c).alias(c) for c in ("effective", "missing", "infeasible")))
    return one.withColumn("fold", F.concat(F.lit("fold_"), F.col("fold").cast("string")))


def factor_run(frame: DataFrame, names: list[str], y: str, *, train: str, last: str, cost_bps: float) -> DataFrame:
    """Slices of every factor (factor_id, asset, fold) outside the training fold: n, rank correlation, p and adjusted p, with
    the factor's cluster (by training rows alone), whether it represents it, and what it adds to the others on the last fold.
    """
    test = frame.filter(F.col("fold") != train)
    long = test.select("asset", "fold", F.col(y).alias("_y"), F.explode(F.array(*(F.struct(F.lit(x).alias("factor_id"), F.col(x).alias("_x")) for x in names))).alias("_f")).select("asset", "fold", "_y", "_f.*")
    by = ["factor_id", "asset", "fold"]
    ok = long.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull()).withColumn("_rx", average_rank("_x", by)).withColumn("_ry", average_rank("_y", by))
    s = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), corr("_rx", "_ry").alias("rank_ic")).withColumn("p", spearman_p("rank_ic", "n")).withColumn("_key", F.concat_ws("|", *by))
    adjusted = benjamini_hochberg(s, key="_key").select("_key", "adjusted", "reject")
    past = frame.filter(F.col("fold") == train)
    clusters = redundancy_clusters([(r["a"], r["b"], r["rho"]) for r in rank_correlations(past, names).collect()], names)  # a row for each pair of factors
    first: dict[int, str] = {}
    for n in sorted(names):
        first.setdefault(clusters[n], n)
    gains = [(n, increment(past, frame.filter(F.col("fold") == last), [m for m in names if m != n], n, y, cost_bps=cost_bps).first()) for n in names]
    facts = [(n, clusters[n], first[clusters[n]] == n, None if g["return_extended"] is None else g["return_extended"] - g["return_baseline"], g["incremental"]) for n, g in gains]
    facts = frame.sparkSession.createDataFrame(facts, "factor_id string, cluster int, representative boolean, delta_return double, incremental boolean")
    return s.join(adjusted, "_key", "left").join(F.broadcast(facts), "factor_id").drop("_key").fillna({"reject": False})
