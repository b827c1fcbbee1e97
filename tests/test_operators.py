"""Hand-computed cases, prefix and order invariance, edges."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofly.functions import factors as fx
from asofly.functions import patterns, scalars
from asofly.functions.expressions import Node, evaluate
from asofly.functions.registry import enumerate_trees
from asofly.operators import asof, bootstrap, indicators, inference, joins, labels, regimes, resample
from asofly.plans import publish
from asofly.sources import files

T0 = datetime(2024, 1, 1)


def series(spark, values, asset="a", hours=1):
    rows = [(asset, T0 + timedelta(hours=i * hours), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "asset string, event_time timestamp_ntz, close double")


def test_resample_four_hours(spark):
    bars = [("a", T0 + timedelta(hours=i), o, h, lo, c, 25.0, T0 + timedelta(hours=i + 1)) for i, (o, h, lo, c) in enumerate([(100.0, 105.0, 99.0, 101.0), (101.0, 108.0, 100.0, 102.0), (102.0, 106.0, 101.0, 103.0), (103.0, 107.0, 102.0, 104.0)])]
    out = resample.resample_ohlcv(spark.createDataFrame(bars, "asset string, event_time timestamp_ntz, open double, high double, low double, close double, volume double, available_time timestamp_ntz"), "4 hours").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in out] == [(100, 108, 99, 104, 100)]
    assert out[0].available_time == T0 + timedelta(hours=4)


def test_asof_sees_equal_times_and_never_later_ones(spark):
    b = spark.createDataFrame([("a", T0 + timedelta(hours=4 * i)) for i in range(3)], "asset string, available_time timestamp_ntz")
    f = spark.createDataFrame([("a", T0 + timedelta(hours=4), 2.0), ("a", T0 + timedelta(hours=8, seconds=1), 3.0), ("b", T0, 9.0)], "asset string, available_time timestamp_ntz, rate double")
    got = {r.available_time: r.rate for r in asof.asof_join(b, f, by=["asset"]).collect()}
    assert list(got.values()) == [None, 2.0, 2.0]


def test_asof_carries_rows_over_blocks(spark):
    rng = np.random.default_rng(9)
    at = lambda: T0 + timedelta(hours=int(rng.integers(0, 24 * 200)))
    bars = [(rng.choice(["a", "b", None]), at(), i) for i in range(300)]
    aux = [(rng.choice(["a", "b"]), at(), float(i)) for i in range(25)]
    b = spark.createDataFrame([(None if k is None else str(k), t, n) for k, t, n in bars], "asset string, available_time timestamp_ntz, n int")
    f = spark.createDataFrame([(str(k), t, v) for k, t, v in aux], "asset string, available_time timestamp_ntz, rate double")
    want = {n: (sorted((u, str(v)) for a, u, v in aux if a == k and u <= t) or [(None, None)])[-1][0] for k, t, n in bars}
    for days in (1, 7, 1000):
        got = {r.n: r.aux_available_time for r in asof.asof_join(b, f, by=["asset"], block_days=days).collect()}
        assert got == want


def test_asof_empty_sides(spark):
    b = spark.createDataFrame([], "asset string, available_time timestamp_ntz")
    f = spark.createDataFrame([("a", T0, 1.0)], "asset string, available_time timestamp_ntz, rate double")
    assert asof.asof_join(b, f, by=["asset"]).count() == 0
    assert [r.rate for r in asof.asof_join(f.drop("rate"), f.limit(0), by=["asset"]).collect()] == [None]


def test_open_to_open_label(spark):
    rows = [("a", T0 + timedelta(hours=i), 100 * 1.1**i, 1.0, 1.0) for i in range(5)]
    out = labels.open_to_open(spark.createDataFrame(rows, "asset string, event_time timestamp_ntz, open double, volume double, quote_volume double"), holding_bars=1).orderBy("event_time").collect()
    assert out[0].label == pytest.approx(math.log(1.1))
    assert [r.reason for r in out] == ["", "", "", "MISSING_NEXT_BAR", "MISSING_NEXT_BAR"]


def test_prefix_and_partition_invariance(spark):
    values = np.cumsum(np.random.default_rng(1).normal(size=120)) + 100
    one = series(spark, values[:80]).withColumn("z", fx.zscore("close", 12)).orderBy("event_time").toPandas()
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        two = series(spark, values).repartition(5).withColumn("z", fx.zscore("close", 12)).orderBy("event_time").toPandas()
        pd.testing.assert_series_equal(one.z, two.z[:80])
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("alpha", [2 / 3, 2 / 21, 2 / 201])
def test_ewm_over_many_chunks(spark, alpha):
    values = np.random.default_rng(2).normal(size=1500)
    got = indicators.ewm(series(spark, values), "close", alpha, "y").orderBy("event_time").toPandas().y
    np.testing.assert_allclose(got, pd.Series(values).ewm(alpha=alpha, adjust=False).mean(), atol=1e-10)


def test_benjamini_hochberg_against_the_definition(spark):
    p = np.round(np.random.default_rng(3).uniform(size=60) ** 3, 2)
    frame = spark.createDataFrame([(f"f{i:02d}", float(x)) for i, x in enumerate(p)], "name string, p double")
    got = {r["name"]: (r["adjusted"], r["reject"]) for r in inference.benjamini_hochberg(frame).collect()}
    order = sorted(range(60), key=lambda i: (p[i], f"f{i:02d}"))
    low, want = 1.0, {}
    for k in range(59, -1, -1):
        low = min(low, p[order[k]] * 60 / (k + 1))
        want[f"f{order[k]:02d}"] = low
    assert {k: pytest.approx(v[0]) for k, v in got.items()} == want
    passed = [k for k in range(60) if p[order[k]] <= (k + 1) / 60 * 0.05]
    assert sum(v[1] for v in got.values()) == (max(passed) + 1 if passed else 0)


def test_student_t_table_values():
    assert inference.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert inference.t_two_sided(2.042, 30) == pytest.approx(0.05, abs=2e-4)
    assert inference.t_two_sided(0.0, 30) == pytest.approx(1.0)


def test_bootstrap_is_repeatable_and_covers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    frame = spark.createDataFrame([("a", T0 + timedelta(hours=i), float(v), float(v + rng.normal())) for i, v in enumerate(x)], "asset string, event_time timestamp_ntz, x double, y double")
    a, b = (bootstrap.stationary_bootstrap(frame.repartition(k), "x", "y", draws=100).collect()[0] for k in (1, 5))
    assert (a.low, a.high) == (b.low, b.high) and 0.4 < a.low < a.high < 0.9


def test_redundancy_clusters():
    got = inference.redundancy_clusters([("a", "b", 0.99), ("a", "c", 0.1), ("b", "c", -0.05)], ["a", "b", "c"])
    assert got["a"] == got["b"] != got["c"]


def test_first_touch_stop_wins(spark):
    bars = spark.createDataFrame([("a", T0 + timedelta(hours=i), h, lo, c) for i, (h, lo, c) in enumerate([(102.0, 99.0, 101.0), (112.0, 89.0, 105.0), (106.0, 100.0, 104.0)])], "asset string, event_time timestamp_ntz, high double, low double, close double")
    sig = spark.createDataFrame([("a", T0, 1, 90.0, 110.0)], "asset string, event_time timestamp_ntz, side int, stop double, target double")
    r = joins.first_touch(sig, bars, horizon_hours=4).collect()[0]
    assert (r.outcome, r.exit_price, r.exit_time) == ("STOP", 90.0, T0 + timedelta(hours=1))


def test_expression_trees_validate_and_hash():
    a, b = Node.column("close"), Node.column("volume")
    assert (a + b).digest() == (b + a).digest() and (a - b).digest() != (b - a).digest()
    assert a.delta(3).lag(2).lookback == 5
    with pytest.raises(ValueError):
        a.lag(0)
    with pytest.raises(ValueError):
        Node.column("label_1h")


def test_expression_evaluates_nested_windows(spark):
    out = evaluate(series(spark, [1, 3, 6, 10]), {"x": Node.column("close").delta(1).lag(1)}).orderBy("event_time").toPandas()
    assert out.x.tolist()[2:] == [2.0, 3.0]


def test_fingerprint_counts_repeats(spark):
    f = series(spark, [1, 2, 3])
    one, two = (publish.fingerprint(x).collect()[0].fingerprint for x in (f, f.unionByName(f)))
    assert one != two and one == publish.fingerprint(f.repartition(3)).collect()[0].fingerprint


def test_register_conflicts(spark):
    cols = "asset string, event_time timestamp_ntz, close double"
    a = publish.manifest(spark.createDataFrame([("a", T0, 1.0)], cols).withColumn("available_time", F.col("event_time")), "n", "raw")
    assert publish.register(a, a).count() == 1
    with pytest.raises(ValueError, match="MANIFEST_CONFLICT"):
        publish.register(a.withColumn("fingerprint", F.lit("other")), a).count()


def test_new_partitions_are_appended_once_null_keys_included(spark, tmp_path):
    path = f"file://{tmp_path}/parts"
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0), (None, 3.0)], "asset string, v double")
    known = publish.write_new_partitions(rows.filter("asset = 'a'"), path, "asset")
    known = publish.write_new_partitions(rows, path, "asset", known)
    publish.write_new_partitions(rows, path, "asset", known)  # a no-op, for the null key too
    assert sorted(map(str, spark.read.schema("v double, asset string").parquet(path).collect())) == sorted(map(str, rows.select("v", "asset").collect()))
    with pytest.raises(ValueError, match="PARTITION_CONTENT_CHANGED"):
        publish.write_new_partitions(rows.dropDuplicates(), path, "asset", known)


def test_empty_frames(spark):
    e = series(spark, [])
    assert e.withColumn("m", fx.momentum("close", 3)).count() == 0
    assert indicators.ewm(e, "close", 0.1, "y").count() == 0


BAR = "asset string, event_time timestamp_ntz, open double, high double, low double, close double, volume double"


def candles(spark, rows, asset="a"):
    return spark.createDataFrame([(asset, T0 + timedelta(hours=i), *map(float, r), 1.0) for i, r in enumerate(rows)], BAR)


def listed(frame, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in frame.orderBy("event_time").select(*columns).collect()]


def test_engulfing_is_strict_and_inside_bar_is_not(spark):
    """(open, high, low, close): a touching body doesn't engulf, equal highs and lows are inside."""
    rows = [(10, 11, 8, 9), (9, 12, 8, 10), (10, 12, 8, 9), (8.9, 13, 8, 10.1), (10.2, 13, 8, 8.8), (9, 12, 8, 10)]
    out = candles(spark, rows).withColumns({"e": patterns.engulfing(), "i": patterns.inside_bar()})
    assert listed(out, "e") == [0, 0, 0, 1, -1, 0]
    assert listed(out, "i") == [0, 0, 1, 0, 1, 1]


def test_pin_bar_measures_the_wick_in_average_ranges(spark):
    rows = [(10.0, 10.2, 8.0, 10.1), (10.0, 12.0, 9.9, 10.1), (10.0, 10.2, 9.5, 10.1), (10.0, 12.0, 8.0, 10.0), (10.0, 12.0, 8.0, 11.6), (10.0, 10.0, 10.0, 10.0)]
    out = candles(spark, rows).withColumn("atr", F.lit(2.0)).withColumn("p", patterns.pin_bar("atr"))
    assert listed(out, "p") == [1, -1, 0, 0, 0, 0]  # long lower wick, long upper, short of 0.6 x 2, equal wicks, large body, no range


def test_levels_are_clustered_apart_and_strictly(spark):
    rows = spark.createDataFrame([([100.0, 100.5, 102.0, 103.5, 100.0],), ([1.0, 1.009],), ([],)], "v array<double>")
    got = [[(round(g.total / g.n, 6), g.n) for g in r[0]] for r in rows.select(indicators.level_groups(F.col("v"), 0.008)).collect()]
    assert got == [[(round(300.5 / 3, 6), 3), (102.0, 1), (103.5, 1)], [(1.0, 1), (1.009, 1)], []]
    peaks = [10, 11, 12, 15, 12, 11, 10, 8, 10, 11, 12, 15, 12, 11, 10]
    out = indicators.support_resistance(candles(spark, [(p, p, p, p) for p in peaks])).collect()
    assert {(r.kind, r["mean"], r.n) for r in out} == {("resistance", 15.0, 2), ("support", 8.0, 1)}


def test_held_weights_drift_with_the_book(spark):
    """Half long a (+10 %), half short b (-20 %): the book makes 15 %, so a drifts to 0.55 / 1.15 and b to -0.4 / 1.15."""
    t = [T0 + timedelta(hours=i) for i in range(4)]
    w = spark.createDataFrame([(t[0], "a", 0.5), (t[0], "b", -0.5), (t[1], "a", 0.5), (t[2], "a", 0.5), (t[3], "a", 0.5)], "event_time timestamp_ntz, asset string, weight double")
    r = spark.createDataFrame([(t[0], "a", 0.1), (t[0], "b", -0.2), (t[1], "a", None), (t[2], "a", 0.0), (t[3], "a", -3.0)], "event_time timestamp_ntz, asset string, ret double")
    out = inference.held_weights(w, r, fee_bps=10.0).orderBy("event_time").collect()
    assert [x.status for x in out] == ["OK", "EXECUTION_BAR_INVALID", "OK", "NONPOSITIVE_DENOMINATOR"]
    assert out[0].gross == pytest.approx(0.15) and out[0].turnover == 1.0 and out[0].net == pytest.approx(0.15 - 0.001)
    assert out[1].gross is None and out[1].turnover == pytest.approx(abs(0.5 - 0.55 / 1.15) + 0.4 / 1.15)
    assert out[2].turnover is None and out[3].turnover == pytest.approx(0.0)
    s = inference.book_summary(inference.held_weights(w, r, fee_bps=10.0)).collect()[0]
    assert (s.total_bars, s.flat_bars, s.active_bars, s.drifted_bars, s.refused_bars) == (4, 0, 2, 2, 2)


def test_market_cycle_by_hand(spark):
    """Constant features: momentum 0, so both scores are 0.5; breadth 0.5, no penalty: bull 0.525, risk 0.45."""
    days = [(T0 + timedelta(days=i), 6, 100.0, 50.0, 0.4) for i in range(31)]
    f = spark.createDataFrame(days, "event_time timestamp_ntz, member_count int, median_quote_volume double, median_oi_value double, top3_share double")
    out = regimes.market_cycle(f).orderBy("event_time").collect()
    assert all(r.label == "insufficient_evidence" and r.confidence == 0 for r in out[:29])
    bull, risk = 0.40 * 0.5 + 0.30 * 0.5 + 0.25 * 0.5 + 0.05, 0.35 * 0.5 + 0.30 * 0.5 + 0.25 * 0.5
    neutral = 1 - abs(bull - risk)
    assert out[29].p_bull == pytest.approx(bull / (bull + risk + neutral)) and out[29].label == "neutral"
    up = spark.createDataFrame([(T0, 0.0, 1.0), (T0 + timedelta(days=30), 1.0, 0.4)], "event_time timestamp_ntz, share_positive double, coverage double")
    lifted = regimes.market_cycle(f, up).orderBy("event_time").collect()
    assert lifted[29].funding_term == pytest.approx(0.10)  # no rate was positive
    assert lifted[30].funding_term is None  # the latest covers too little


def test_cycle_baseline_is_the_first_rows_while_history_is_short(spark):
    vol = [1.0, 2.0, 100.0, 4.0, 5.0, 6.0, 7.0]
    f = spark.createDataFrame([(T0 + timedelta(days=i), 12, v, v, 0.5) for i, v in enumerate(vol)], "event_time timestamp_ntz, member_count int, median_quote_volume double, median_oi_value double, top3_share double")
    out = regimes.cycle_features(f, rows=3).orderBy("event_time").collect()
    assert [r.trailing_volume for r in out] == [1.0, 1.5, 2.0, 4.0, 5.0, 5.0, 6.0]
    assert [r.baseline_volume for r in out] == [1.0, 1.5, 2.0, 2.0, 2.0, 2.0, 4.0]
    assert out[6].volume_momentum == pytest.approx(0.5)


def test_spread_rank_equals_average_rank(spark):
    x = np.random.default_rng(6).integers(0, 60, 700).tolist() + [5] * 300
    frame = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)], "g int, x double")
    got = inference.spread_rank(frame, "x", ["g"], "r", buckets=16).toPandas()
    np.testing.assert_allclose(got.r, got.groupby("g").x.rank())


def test_increment_is_the_ridge_fit_of_numpy(spark):
    rng = np.random.default_rng(7)
    n = 80
    a, c = rng.normal(size=n), rng.normal(size=n)
    y = 0.3 * a + 0.4 * c + 0.1 * rng.normal(size=n)
    frame = spark.createDataFrame([("a", T0 + timedelta(hours=i), float(a[i]), float(c[i]), float(y[i])) for i in range(n)], "asset string, event_time timestamp_ntz, b double, c double, y double")
    cut = F.lit(T0 + timedelta(hours=50)).cast("timestamp_ntz")
    got = inference.increment(frame.filter(F.col("event_time") < cut), frame.filter(F.col("event_time") >= cut), ["b"], "c", "y", cost_bps=5.0).collect()[0]
    x = np.column_stack([a, c])
    w = np.linalg.solve(x[:50].T @ x[:50] + np.eye(2), x[:50].T @ y[:50])
    p, s = x[50:] @ w, np.sign(x[50:] @ w)
    assert got.ic_extended == pytest.approx(np.corrcoef(p, y[50:])[0, 1])
    assert got.return_extended == pytest.approx(np.mean(s * y[50:]) - np.mean(np.abs(np.diff(s))) * 0.0005) and got.incremental


def test_spearman_p_and_normal_p(spark):
    out = spark.createDataFrame([(0.5, 30), (1.0, 40), (0.9, 10), (None, 50)], "r double, n int").select(inference.spearman_p("r", "n")).collect()
    assert out[0][0] == pytest.approx(0.00488, abs=5e-5) and out[1][0] == 0.0 and out[2][0] is None and out[3][0] is None
    p = [r[0] for r in spark.createDataFrame([(0.0,), (1.959964,), (-3.290527,), (40.0,)], "t double").select(inference.normal_two_sided("t")).collect()]
    assert p == pytest.approx([1.0, 0.05, 0.001, 0.0], abs=1e-6)


def test_circular_bootstrap_blocks(spark):
    frame = spark.createDataFrame([("a", T0 + timedelta(hours=i), float(i)) for i in range(24)], "asset string, event_time timestamp_ntz, r double")
    one, two = (bootstrap.circular_bootstrap(frame.repartition(k), "r", np.mean, block=24, samples=20).collect()[0] for k in (1, 4))
    assert (one.low, one.high) == (two.low, two.high) == (11.5, 11.5)  # a block of all rows has their mean, wherever it starts
    free = bootstrap.circular_bootstrap(frame, "r", np.median, block=6, samples=60).collect()[0]
    assert free.low < 11.5 < free.high and free.samples == 60


def test_factor_run_agrees_with_its_parts(spark):
    rng = np.random.default_rng(8)
    rows = [(a, T0 + timedelta(hours=i), f, *map(float, (x, x + 0.01 * e, e, 0.5 * x + e2))) for a in "ab" for i, (f, x, e, e2) in enumerate(zip(["train"] * 60 + ["last"] * 60, rng.normal(size=120), rng.normal(size=120), rng.normal(size=120), strict=True))]
    frame = spark.createDataFrame(rows, "asset string, event_time timestamp_ntz, fold string, f1 double, f2 double, f3 double, y double")
    out = inference.factor_run(frame, ["f1", "f2", "f3"], "y", train="train", last="last", cost_bps=5.0).toPandas()
    assert len(out) == 6 and set(out.fold) == {"last"}
    by = out.groupby("factor_id").first()
    assert by.cluster["f1"] == by.cluster["f2"] != by.cluster["f3"] and by.representative.tolist() == [True, False, True]
    test = frame.filter("fold = 'last' and asset = 'a'").toPandas()
    assert out[(out.factor_id == "f1") & (out.asset == "a")].rank_ic.iloc[0] == pytest.approx(test.f1.rank().corr(test.y.rank()))


def test_blocked_family_is_not_judged(spark):
    s = spark.createDataFrame([], "factor_id string, horizon string, q double, fold string, asset string, regime string, p double, direction_estimate double, n_effective long, bars array<struct<bucket:bigint,bits:binary>>")
    u = spark.createDataFrame([], "fold string, asset string, regime string, effective long, missing long, infeasible long")
    r = inference.family_gate(s, u, horizons=["1h"], qs=[0.2], primary=("1h", 0.2), blocked=["PROTOCOL_SHA"]).collect()[0]
    assert r.verdict == "BLOCKED" and r.reasons == ["PROTOCOL_SHA"]
    r = inference.family_gate(s, u, horizons=["1h"], qs=[0.2], primary=("1h", 0.2)).collect()[0]
    assert r.verdict == "INSUFFICIENT" and r.reasons == ["BH_DENOMINATOR_BELOW_MINIMUM"]


def with_bars(slices):
    """Slices whose bars are lists, with bitmaps instead."""
    values = [F.first(c).alias(c) for c in ("p", "direction_estimate", "n_effective")]
    return inference.with_bitmaps(slices.withColumn("pos", F.explode_outer("bars")), inference.SLICE, "pos", *values)


def test_family_passes_fails_and_finds_faults(spark):
    unit = [("f", a, g, 50, 0, 0) for a in "xy" for g in "uv"]
    good = [("t", "1h", 0.2, "f", a, g, 0.001, 0.3, 50, [i * 10]) for i, (a, g) in enumerate((a, g) for a in "xy" for g in "uv")]
    cols = "factor_id string, horizon string, q double, fold string, asset string, regime string, p double, direction_estimate double, n_effective long, bars array<int>"
    u = spark.createDataFrame(unit, "fold string, asset string, regime string, effective long, missing long, infeasible long")
    judge = lambda rows: (lambda r: (r.verdict, r.reasons, r.survivors))(inference.family_gate(with_bars(spark.createDataFrame(rows, cols)), u, horizons=["1h"], qs=[0.2], primary=("1h", 0.2)).collect()[0])
    assert judge(good) == ("PASS", [], 4)
    assert judge(good[:3]) == ("INSUFFICIENT", ["PREREGISTERED_SLICE_MISSING"], 3)
    assert judge([*good[:3], (*good[3][:6], None, 0.3, 50, [30])]) == ("INSUFFICIENT", ["MISSING_P_VALUE"], 3)
    assert judge([(*r[:7], -0.3, *r[8:]) for r in good]) == ("FAIL", ["DIRECTION_CONSISTENCY_BELOW_MINIMUM"], 4)
    assert judge([(*r[:9], [7]) for r in good]) == ("INSUFFICIENT", ["SURVIVING_SLICES_BELOW_MINIMUM"], 0)  # one asset's slices share a bar


def test_order_size_by_hand(spark):
    rows = [(100.0, 95.0, 100.0, [], []), (100.0, 80.0, 100.0, [], []), (100.0, 100.0, 100.0, [], []), (100.0, 80.0, 100.0, [7.0], [30.0]), (100.0, 80.0, 100.0, [10.0], [30.0]), (100.0, 80.0, 100.0, [], [90.0]), (100.0, 80.0, 0.0, [], []), (1000.0, 1.0, 1000.0, [9.999], [])]
    f = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, entry double, stop double, ref_price double, open_risks array<double>, open_notionals array<double>")
    got = [(r.reason, r.quantity, r.stop_risk) for r in scalars.order_size(f, step=0.001, least_quantity=0.001, least_notional=5.0).orderBy("i").collect()]
    assert got == [
        (None, 0.9, 4.5), (None, 0.5, 10.0), ("INVALID_STOP_DISTANCE", None, None), (None, 0.15, 3.0), ("RISK_BUDGET_EXHAUSTED", None, None), ("GROSS_CAPACITY_EXHAUSTED", None, None), ("INVALID_REF_PRICE", None, None), ("MIN_NOTIONAL_OR_STEP_CONFLICT", None, None),
    ]


def test_tolerant_csv_keeps_the_first_row_of_a_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,Open_Price,H,l,close\n2024-01-01,9,9,9,9\n2024-01-01,5,5,5,5\n1704153600,1,2,1,2\n1704153600000,3,3,3,3\n20240103,4,4,4,4\n")
    got = [(r.event_time.day, r.open, r.volume) for r in files.tolerant_csv(spark, str(tmp_path)).orderBy("event_time").collect()]
    assert got == [(1, 9.0, 0.0), (2, 1.0, 0.0), (3, 4.0, 0.0)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "y.csv").write_text("time,open,high,low\n1,2,3,4\n")
    with pytest.raises(ValueError, match="close"):
        files.tolerant_csv(spark, str(tmp_path / "bad"))


def test_memberships_and_delay_views_must_be_whole(spark):
    b = candles(spark, [(1, 1, 1, 1)]).withColumn("available_time", F.col("event_time"))
    m = spark.createDataFrame([("a", T0), ("a", T0 + timedelta(hours=1))], "asset string, selection_time timestamp_ntz")
    with pytest.raises(ValueError, match="DUPLICATE_MEMBERSHIP"):
        asof.members_only(b, m)
    with pytest.raises(ValueError, match="DELAY_VIEW_MISSING"):
        asof.asof_by_delay(b, spark.createDataFrame([], "asset string, delay int, available_time timestamp_ntz, open_interest double"), (5,))


def test_grammar_is_bounded_and_valid():
    trees = enumerate_trees(["close", "volume"], [6, 12], depth=3, most=400)
    assert len(trees) == 400 == len({t.text() for t in trees}) and max(t.depth for t in trees) == 3
    assert all(t.columns() <= {"close", "volume"} for t in trees)
    assert Node.column("close").rolling_mean(12).lookback == 12
    assert Node.column("close").digest(parents=("a", "b")) == Node.column("close").digest(parents=("b", "a")) != Node.column("close").digest(unit="usd")


def test_trees_read_allowed_columns_only(spark):
    with pytest.raises(ValueError, match="UNKNOWN_COLUMNS"):
        evaluate(series(spark, [1, 2]).withColumn("secret", F.lit(1.0)), {"x": Node.column("secret").lag(1)})
