"""Walk-forward outcomes, limits by fold, review summaries, refused lists and the grammar, against plain versions."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofly.functions.expressions import Node, evaluate
from asofly.functions.registry import SearchSpace, candidates, enumerate_trees, grow
from asofly.operators import inference, strategy
from asofly.operators.evaluation import evaluate_factor, fold_limits
from asofly.sources import files

T0 = datetime(2024, 1, 1)
BAR = "asset string, event_time timestamp_ntz, open double, high double, low double, close double"


def walk(assets, n, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for a in assets:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        start = np.concatenate([[100.0], close[:-1]])
        rows += [(a, T0 + timedelta(hours=i), float(o), float(max(o, c) * 1.01), float(min(o, c) * 0.99), float(c)) for i, (o, c) in enumerate(zip(start, close, strict=True))]
    return rows


def test_limits_are_those_of_the_folds_own_training_rows(spark):
    rows = walk("ab", 90)
    b = spark.createDataFrame(rows, BAR)
    folds = inference.walk_forward(b, initial=30, test=20, purge=2, embargo=3)
    got = {(r.asset, r.fold): (r.lo, r.hi) for r in fold_limits(folds, "close", 0.1, 0.9).collect()}
    assert len(got) == 6
    for (asset, k), (lo, hi) in got.items():
        known = [r[5] for r in rows if r[0] == asset][: 30 + 20 * k - 5]
        assert np.allclose([lo, hi], np.quantile(known, [0.1, 0.9]))


def test_evaluation_equals_a_plain_one(spark):
    rows = walk("ab", 120)
    b = spark.createDataFrame(rows, BAR).withColumn("y", F.col("close") / F.col("open") - 1).withColumn("g", F.when(F.hour("event_time") < 12, "am").otherwise("pm"))
    b = b.withColumn("x", F.when(F.hour("event_time") != 5, F.sin("close")))
    out = evaluate_factor(inference.walk_forward(b, initial=40, test=40, purge=1), "x", "y", by=["asset", "fold", "g"], low=0.2, high=0.8).toPandas().set_index(["asset", "fold", "g"])
    frame, n = b.toPandas().sort_values(["asset", "event_time"]), 0
    for asset, f in frame.groupby("asset"):
        f = f.reset_index(drop=True)
        for k in (0, 1):
            lo, hi = f.x[: 40 + 40 * k - 1].dropna().quantile([0.2, 0.8])
            for g, s in f[40 + 40 * k : 80 + 40 * k].groupby("g"):
                x = s.x.clip(lo, hi)
                ok = x.notna()
                r = out.loc[(asset, k, g)]
                assert r.n == ok.sum() and np.isclose(r.coverage, ok.mean()) and np.isclose(r.turnover, x[ok].diff().abs().mean())
                assert np.allclose([r.ic, r.rank_ic], [x[ok].corr(s.y[ok]), x[ok].rank().corr(s.y[ok].rank())])
                n += 1
    assert n == len(out) == 8


def plain_outcomes(rows, side, variants, costs, horizon, initial, test, purge):
    """One signal after another."""
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    trades = []
    for asset, bars in by.items():
        for i, bar in enumerate(bars):
            s = side(bar)
            for scenario, fee, slip, delay in costs:
                for variant, stop, target in variants:
                    if s is None or i + delay + 1 >= len(bars):
                        continue
                    entry, start = bars[i + delay + 1][2], bars[i + delay][1]
                    leave = None
                    for b in bars[i + delay + 1 :]:
                        if b[1] > start + timedelta(hours=horizon):
                            break
                        leave = b[5]
                        low, high = entry * (1 - stop), entry * (1 + target)
                        if s == 1 and b[4] <= low or s == -1 and b[3] >= entry * (1 + stop):
                            leave = entry * (1 - s * stop)
                            break
                        if s == 1 and b[3] >= high or s == -1 and b[4] <= entry * (1 - target):
                            leave = entry * (1 + s * target)
                            break
                    trades.append((variant, scenario, asset, i, s, s * (leave / entry - 1) - 2 * (fee + slip) / 10000))
    t = pd.DataFrame(trades, columns=["variant", "scenario", "asset", "i", "side", "net"])
    out = {}
    for key, g in t.groupby(["variant", "scenario", "asset"]):
        for k in range((len(by[key[2]]) - initial) // test):
            edge = initial + test * k
            before, own = g[g.i + 1 + purge <= edge], g[(g.i >= edge) & (g.i < edge + test)]
            out[(*key, k)] = (len(before), before.net.mean(), len(own), int((own.side == 1).sum()), own.net.mean(), (own.net > 0).mean())
    return out


def test_walk_forward_outcomes_equal_a_plain_run(spark):
    rows = walk("ab", 70)
    variants, costs = [("tight", 0.02, 0.03), ("wide", 0.06, 0.08)], [("base", 4.0, 5.0, 0), ("late", 4.0, 5.0, 2)]
    b = spark.createDataFrame(rows, BAR)
    side = F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1)
    signals = b.select("asset", "event_time", side.alias("side"))
    folds = inference.walk_forward(b, initial=25, test=15, purge=6, embargo=2)
    got = strategy.walk_forward_outcomes(folds, signals, spark.createDataFrame(variants, "variant string, stop double, target double"), spark.createDataFrame(costs, "scenario string, fee_bps double, slip_bps double, delay int"), delays=(0, 2), horizon_hours=6).collect()
    want = plain_outcomes(rows, lambda r: 1 if r[5] > r[2] else -1 if r[5] < r[2] else None, variants, costs, 6, 25, 15, 8)
    assert len(got) == len(want) == 24
    for r in got:
        assert np.allclose((r.train_n, r.train_mean, r.n, r.longs, r.mean_net, r.win_rate), want[(r.variant, r.scenario, r.asset, r.fold)])
        others = [w[1] for (v, s, a, k), w in want.items() if (s, a, k) == (r.scenario, r.asset, r.fold)]
        assert r.chosen == (r.train_mean >= max(others) - 1e-12)
    assert {r.longs < r.n for r in got} == {True}  # both sides


def test_later_bars_leave_training_figures_as_they_are(spark):
    """Figures of a fold's training rows don't change when what follows its test rows is taken away."""
    rows = walk("a", 70)
    make = lambda r: strategy.walk_forward_outcomes(inference.walk_forward(spark.createDataFrame(r, BAR), initial=25, test=15, purge=6, embargo=2), spark.createDataFrame(r, BAR).select("asset", "event_time", F.lit(-1).alias("side")), spark.createDataFrame([("v", 0.02, 0.03)], "variant string, stop double, target double"), spark.createDataFrame([("base", 4.0, 5.0, 0)], "scenario string, fee_bps double, slip_bps double, delay int"), delays=(0,), horizon_hours=6)
    whole, part = ({r.fold: (r.train_n, r.train_mean) for r in make(x).collect()} for x in (rows, rows[:56]))
    assert set(part) == {0, 1} and all(np.allclose(whole[k], part[k]) for k in part)


def decisions(spark, rows):
    return spark.createDataFrame([("r", T0 + timedelta(hours=h), i, float(e)) for i, (h, e) in enumerate(rows)], "run_id string, slot timestamp_ntz, seq int, equity_after double")


def test_review_summary(spark):
    every = [(24 * d, 100 + d) for d in range(31)]
    r = strategy.review_summary(decisions(spark, every), floor=50).collect()[0]
    assert (r.completed_days, r.missing_slots, r.current_equity, r.high_water_mark, r.daily_loss, r.review_ready) == (30.0, 0, 130, 130, 0, True)
    holes = [x for x in every if x[0] not in (24 * 4, 24 * 5, 24 * 9)]
    r = strategy.review_summary(decisions(spark, holes), now="2024-01-31 12:00:00", floor=50).collect()[0]
    assert (r.completed_days, r.missing_slots, r.first_missing, r.review_ready) == (30.5, 3, T0 + timedelta(days=4), False)
    r = strategy.review_summary(decisions(spark, every), now="2024-02-02 00:00:00", floor=50).collect()[0]
    assert (r.completed_days, r.missing_slots, r.first_missing, r.review_ready) == (32.0, 2, T0 + timedelta(days=31), False)
    r = strategy.review_summary(decisions(spark, [(0, 100), (10, 90), (25, 80), (30, 70)]), now="2024-01-02 20:00:00", floor=75).collect()[0]
    assert (r.completed_days, r.daily_loss, r.high_water_mark, r.breaches, r.review_ready) == (1.8, 20.0, 100.0, 1, False)
    r = strategy.review_summary(decisions(spark, [(0, 100), (10, 90), (25, 80)]), now="2024-01-01 12:00:00", floor=75).collect()[0]
    assert (r.current_equity, r.daily_loss, r.breaches) == (90.0, 10.0, 0)  # later decisions aren't known; the day's first stands in


ENTRY = {"identity_key": "k", "status": "permanently_unavailable", "reason_code": "SOURCE_ARCHIVE_404", "source_url": "u", "evidence_ref": "e", "observed_on": "2024-01-02"}


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        ({"exclusions": [ENTRY, {**ENTRY, "identity_key": "l"}]}, ["k", "l"]),
        ({"exclusions": []}, []),
        ({}, []),
        ({"exclusions": [ENTRY, ENTRY]}, "CANONICAL_INPUT_EXCLUSIONS_DUPLICATE"),
        ({"schema_version": "canonical-input-exclusions-v2", "exclusions": [ENTRY]}, "CANONICAL_INPUT_EXCLUSIONS_INVALID"),
        ({"schema_version": None, "exclusions": [ENTRY]}, "CANONICAL_INPUT_EXCLUSIONS_INVALID"),
        ({"exclusions": "none"}, "CANONICAL_INPUT_EXCLUSIONS_INVALID"),
        ({"exclusions": [{**ENTRY, "status": "late"}]}, "CANONICAL_INPUT_EXCLUSIONS_INVALID"),
        ({"exclusions": [{**ENTRY, "observed_on": "soon"}]}, "CANONICAL_INPUT_EXCLUSIONS_INVALID"),
        ({"exclusions": [{k: v for k, v in ENTRY.items() if k != "source_url"}]}, "CANONICAL_INPUT_EXCLUSIONS_INVALID"),
        ({"exclusions": [{k: v for k, v in ENTRY.items() if k != "identity_key"}]}, "CANONICAL_INPUT_EXCLUSIONS_INVALID"),
        ("{", "CANONICAL_INPUT_EXCLUSIONS_INVALID"),
        (None, "CANONICAL_INPUT_EXCLUSIONS_INVALID"),
    ],
)
def test_exclusion_lists_are_taken_or_refused_as_a_whole(spark, payload, want):
    text = json.dumps({"schema_version": files.EXCLUSIONS_VERSION, **payload}) if isinstance(payload, dict) else payload
    got = files.exclusions(spark.createDataFrame([("f", text)], "path string, payload string")).collect()
    if isinstance(want, str):
        assert [(r.path, r.identity_key, r.error) for r in got] == [("f", None, want)]
    else:
        assert sorted(r.identity_key for r in got) == want and all(r.error is None for r in got)


def test_universe_documents_that_are_wanted_and_not_there_are_rows(spark):
    doc = lambda i, members: json.dumps({"artifact_id": i, "selection_time": "2024-01-02 00:00:00", "members": members})
    docs = spark.createDataFrame([(doc("a", [{"asset": "x", "rank": 1}]),), (doc("b", []),), (doc("c", [{"asset": "y", "rank": 1}]),), ("{bad",), (None,)], "payload string")
    got = files.universe_days(docs, spark.createDataFrame([("a",), ("a",), ("b",), ("d",)], "artifact_id string")).collect()
    assert sorted((r.artifact_id, r.asset or "", r.error or "") for r in got) == [("a", "x", ""), ("d", "", "POPULAR_UNIVERSE_ARTIFACT_MISSING")]
    assert sorted(r.error or r.asset for r in files.universe_days(docs).collect()) == ["POPULAR_UNIVERSE_ARTIFACT_INVALID", "POPULAR_UNIVERSE_ARTIFACT_INVALID", "x", "y"]


def test_grammar_comes_best_first_and_lazily():
    some = enumerate_trees(["close", "volume"], [6, 12], depth=3, most=500)
    order = [(t.depth, t.lookback) for t in some]
    assert order == sorted(order) and len({t.text() for t in some}) == 500
    assert next(grow(["close"], list(range(2, 400)), depth=6)).text() == "column(close)"
    every = list(grow(["close", "volume"], [6], depth=2))
    assert len(every) == 2 + 2 * 7 + 5  # columns, windowed ones, two ratios, two differences and one sum


def test_candidates_are_bounded_and_the_same_each_time(spark):
    found = candidates(SearchSpace())
    assert [c.name for c in found[:6]] == ["momentum_6", "volatility_6", "volume_trend_6", "zscore_close_6", "rank_close_6", "momentum_12"]
    assert len(found) == 20 == len({c.factor_id for c in found}) and [c.rank for c in found] == list(range(20)) and found == candidates(SearchSpace())
    assert len(candidates(SearchSpace(most=900))) == 20 and len(candidates(SearchSpace(most=3))) == 3
    deep = candidates(SearchSpace(windows=(6,), most=20))
    assert max(c.tree.depth for c in deep) == 3 and all(c.lookback == c.tree.lookback for c in deep)
    assert all(c.tree.depth <= 2 for c in candidates(SearchSpace(windows=(6,), depth=2)))
    assert [c.name for c in deep] != [c.name for c in candidates(SearchSpace(windows=(6,), seed=8))]
    with pytest.raises(ValueError, match="positive"):
        SearchSpace(most=0)
    rows = [("a", T0 + timedelta(hours=i), float(i + 1), float(2 * i + 1), float(i), float(i)) for i in range(8)]
    b = spark.createDataFrame(rows, "asset string, event_time timestamp_ntz, close double, volume double, high double, low double")
    out = evaluate(b, {c.name: c.tree for c in deep}).orderBy("event_time").toPandas()
    assert out.momentum_6.dropna().tolist() == [6.0, 3.0] and out.volume_trend_6.dropna().tolist() == [6.0, 8.0, 10.0]
    assert Node.column("close").zscore(6).text() in {c.tree.text() for c in deep}
