"""Windows in blocks, prefix statistics, bootstraps, archives and streams against plain versions and brute force."""

from __future__ import annotations

import io
import math
import re
import struct
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from asofly.functions import factors as fx
from asofly.operators import bootstrap, indicators, inference, joins, labels, regimes, rolling, timeblocks, universe
from asofly.operators.prefix import prefix_quantiles, prefix_sums
from asofly.queries import catalog
from asofly.sources import archives
from asofly.streaming import bars as streams

T0 = datetime(2024, 1, 1)


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks so small that every window crosses them."""
    monkeypatch.setattr(timeblocks, "DAYS", 1)
    monkeypatch.setattr(timeblocks, "ROWS", 8)


@pytest.fixture(scope="module")
def bars(spark):
    """Uneven bars of three assets (one null), with gaps of days."""
    rng = np.random.default_rng(5)
    rows = []
    for a, n in (("a", 90), ("b", 31), (None, 17), ("one", 1)):
        at = T0
        for _ in range(n):
            at += timedelta(hours=int(rng.choice([1, 1, 1, 5, 70])))
            o, c = rng.uniform(90, 110, 2)
            rows.append((a, at, float(o), float(max(o, c) + rng.uniform(0, 2)), float(min(o, c) - rng.uniform(0, 2)), float(c), float(rng.integers(0, 9)), float(rng.integers(1, 9))))
    return spark.createDataFrame(rows, "asset string, event_time timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double")


def table(frame, *columns):
    return frame.select("asset", "event_time", *columns).toPandas().sort_values(["asset", "event_time"], na_position="first").reset_index(drop=True)


def same(got, want):
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_bounded_frames_equal_plain_windows(bars, small_blocks):
    columns = {"m": fx.momentum("close", 5), "z": fx.zscore("close", 7), "f": fx.forward_log_return("close", 3), "s": indicators.swings(3), "k": indicators.swings(3, confirmed=True)}
    same(table(timeblocks.in_blocks(bars, lambda f: f.withColumns(columns), before=7, after=3), *columns), table(bars.withColumns(columns), *columns))


def test_running_values_equal_plain_windows(bars, small_blocks):
    w = fx.W().rowsBetween(Window.unboundedPreceding, 0)
    some = F.when(F.col("volume") > 5, F.col("volume"))
    got = timeblocks.running(bars, {"total": ("sum", F.col("volume")), "top": ("max", F.col("close")), "low": ("min", F.col("close")), "held": ("last", some), "none": ("sum", some)})
    want = bars.withColumns({"total": F.sum("volume").over(w), "top": F.max("close").over(w), "low": F.min("close").over(w), "held": F.last(some, ignorenulls=True).over(w), "none": F.sum(some).over(w)})
    same(table(got, "total", "top", "low", "held", "none"), table(want, "total", "top", "low", "held", "none"))
    same(table(timeblocks.numbered(bars), "pos"), table(bars.withColumn("pos", F.row_number().over(fx.W()) - 1), "pos"))


def test_drawdown_compounding_and_episodes(bars, small_blocks):
    w = fx.W().rowsBetween(Window.unboundedPreceding, 0)
    same(table(timeblocks.with_drawdown(bars, "close", "dd"), "dd"), table(bars.withColumn("dd", F.col("close") / F.max("close").over(w) - 1), "dd"))
    r = bars.withColumn("r", F.when(F.col("volume") == 8, -1.0).otherwise(F.col("close") / 100 - 1))
    ruined = F.max(F.when(F.col("r") <= -1, 1).otherwise(0)).over(w) == 1
    same(table(timeblocks.with_compounded(r, {"e": "r"}, 10.0), "e"), table(r.withColumn("e", F.when(~ruined, 10 * F.exp(F.sum(F.when(F.col("r") > -1, F.log1p("r"))).over(w)))), "e"))
    up = bars.withColumn("s", (F.col("close") > 100).cast("string"))
    new = up.withColumn("n", F.when(F.lag("s").over(fx.W()).eqNullSafe(F.col("s")), 0).otherwise(1))
    same(table(timeblocks.with_episodes(up, "s", "e"), "e"), table(new.withColumn("e", F.sum("n").over(w)), "e"))
    whole = timeblocks.with_compounded(r.filter("asset = 'a'"), {"e": "r"}, by=[])
    assert whole.count() == 90 and timeblocks.with_drawdown(bars.limit(0), "close", "dd").count() == 0


def test_averages_labels_and_ranks_over_blocks(bars, small_blocks, monkeypatch):
    monkeypatch.setattr(indicators, "CHUNK", 4)
    got = table(indicators.emas(bars, "close", {"e5": 5, "e30": 30}), "e5", "e30", "close")
    for _, g in got.groupby("asset", dropna=False):
        for n in (5, 30):
            np.testing.assert_allclose(g[f"e{n}"], g.close.ewm(span=n, adjust=False).mean(), atol=1e-9)
    small = table(labels.open_to_open(bars, holding_bars=2), "label", "reason")
    monkeypatch.setattr(timeblocks, "ROWS", 4096)
    same(small, table(labels.open_to_open(bars, holding_bars=2), "label", "reason"))
    monkeypatch.setattr(timeblocks, "ROWS", 8)
    ranked = table(rolling.rolling_rank(bars.withColumn("v", F.when(F.col("volume") > 0, F.col("volume"))), "v", 5, "r"), "v", "r")
    for _, g in ranked.groupby("asset", dropna=False):
        np.testing.assert_allclose(g.r, g.v.rolling(5).rank(pct=True), atol=1e-12)


def test_structure_breaks_and_patterns_do_not_depend_on_blocks(bars, monkeypatch):
    columns = ("bos", "engulfing", "inside", "trend", "atr", "ema_trend", "next_open")
    want = table(indicators.patterns(bars), *columns)
    monkeypatch.setattr(timeblocks, "DAYS", 1)
    monkeypatch.setattr(timeblocks, "ROWS", 8)
    monkeypatch.setattr(indicators, "CHUNK", 16)
    same(table(indicators.patterns(bars), *columns), want)


@pytest.mark.parametrize("name", ["E1_momentum", "E3_realized_volatility", "E9_dual_horizon_frame", "E13_open_to_open_label", "E14_expression_windows", "E17_ema", "E19_drawdown", "E20_compounded_equity", "E21_state_episodes", "E25_swing_points", "E30_break_of_structure", "D21_equity_metrics", "I13_gate_inputs"])
def test_no_window_sorts_a_whole_asset(spark, small, name):
    """Every window is within a block, a chunk or a moment, or over the few ends of blocks."""
    plan = catalog.queries()[name](spark, small)
    text = plan._jdf.queryExecution().analyzed().toString()
    specs = re.findall(r"windowspecdefinition\(([^,()]+(?:\[[^\]]*\])?(?:\.\w+)?#?\d*)", text)
    assert specs and not [s for s in specs if s.split("#")[0] in ("event_type", "l_suppkey")], specs


# --- prefixes


def test_prefix_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(b), float(x) if rng.random() > 0.1 else None, float(rng.integers(0, 4))) for k, n in (("a", 400), ("b", 60), (None, 30)) for b, x in zip(rng.integers(0, 14, n), rng.normal(size=n), strict=True)]
    rows.append(("c", 3, None, float("nan")))
    frame = spark.createDataFrame(rows, "key string, block long, x double, t double")
    last = spark.createDataFrame([("a", 9), ("b", 12), (None, 4), ("c", 4)], "key string, last long")
    got = prefix_quantiles(frame, last, {"x": 0.75, "t": 0.6}, key="key", prefix="q_", rows=16).toPandas()
    assert len(got) == 10 + 13 + 5 + 5
    data = pd.DataFrame(rows, columns=["key", "block", "x", "t"])
    for r in got.itertuples():
        own = data[(data.key.isna() if r.key is None or r.key != r.key else data.key == r.key) & (data.block <= r.block)]
        for c, q in (("x", 0.75), ("t", 0.6)):
            values = own[c].dropna()
            want = np.percentile(values, 100 * q) if len(values) else math.nan
            assert getattr(r, f"q_{c}") == pytest.approx(want, abs=1e-12, nan_ok=True)


def test_prefix_sums_and_folds(spark):
    frame = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("a", 3, 1.0)], "key string, block long, v double")
    got = prefix_sums(frame, spark.createDataFrame([("a", 4)], "key string, last long"), ["v"], key="key").orderBy("block").collect()
    assert [r.v for r in got] == [0, 5, 5, 6, 6]
    line = spark.createDataFrame([("a", T0 + timedelta(hours=i)) for i in range(50)], "asset string, event_time timestamp_ntz")
    rows = inference.walk_forward(line, initial=20, test=10, purge=2, embargo=1)
    assert rows.count() == 50  # one row each, however many folds it serves
    counts = inference.fold_counts(rows).orderBy("fold").collect()
    assert [(r.test_rows, r.train_rows) for r in counts] == [(10, 17), (10, 27), (10, 37)]


def test_expanding_thresholds_move_rows_once(spark):
    """What is exchanged grows with the rows, not with rows times blocks."""
    rng = np.random.default_rng(7)
    frame = spark.createDataFrame([("a", T0 + timedelta(hours=i), *map(float, rng.normal(size=3))) for i in range(600)], "asset string, event_time timestamp_ntz, volatility double, trend double, illiquidity double")
    got = regimes.expanding_thresholds(frame, initial=20, every=5).toPandas().sort_values("block")
    data = frame.toPandas()
    assert list(got.block) == list(range(116))
    for r in got.itertuples():
        assert r.q_volatility == pytest.approx(np.percentile(data.volatility[: 20 + 5 * r.block], 75))
        assert r.q_illiquidity == pytest.approx(np.percentile(data.illiquidity[: 20 + 5 * r.block], 95))
    assert "explode(sequence(_first" not in regimes.expanding_thresholds(frame, initial=20, every=5)._jdf.queryExecution().toString()


# --- bootstraps


def test_bootstrap_hashes_are_sparks(spark):
    h = spark.range(200).select("id", F.xxhash64(F.lit(7), F.lit("slice")).alias("s"), F.xxhash64(F.lit(7), F.lit("slice"), F.col("id").cast("int")).alias("i"), F.xxhash64(F.lit(7), F.lit("slice"), "id").alias("l")).toPandas()
    seed = np.array([int(h.s[0]) & (2**64 - 1)], np.uint64)
    assert (bootstrap.hash_int(h.id.to_numpy(), seed).astype(np.int64) == h.i).all() and (bootstrap.hash_long(h.id.to_numpy(), seed).astype(np.int64) == h.l).all()


def test_bootstraps_equal_their_row_versions(spark):
    rng = np.random.default_rng(1)
    rows = [(k, T0 + timedelta(hours=i), float(rng.integers(0, 20)), float(rng.integers(0, 9))) for k, n in (("a", 120), ("b", 77), ("c", 2), ("d", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "asset string, event_time timestamp_ntz, x double, y double").repartition(5)
    listed = lambda f: {r[0]: [None if v is None else round(v, 9) for v in r[1:]] for r in f.collect()}
    want = listed(bootstrap.stationary_rows(frame, "x", "y", draws=30, mean_block=5, seed=42, by="asset"))
    assert listed(bootstrap.stationary_bootstrap(frame, "x", "y", draws=30)) == want
    assert listed(bootstrap.stationary_bootstrap(frame, "x", "y", draws=30, limit=100)) == want  # one slice as rows, the others as arrays
    want = listed(bootstrap.circular_rows(frame, "x", F.median, block=7, samples=25, seed=3, by="asset"))
    assert listed(bootstrap.circular_bootstrap(frame, "x", np.median, block=7, samples=25, seed=3)) == want
    assert listed(bootstrap.circular_bootstrap(frame, "x", np.median, column=F.median, block=7, samples=25, seed=3, limit=100)) == want
    with pytest.raises(ValueError, match="aggregate expression"):
        bootstrap.circular_bootstrap(frame, "x", np.median, block=7, samples=25, limit=100)


def test_normal_tails_keep_their_digits(spark):
    ts = [0.0, 0.3, 1.0, 2.5, 2.83, 3.0, 8.0, 18.0, 26.9, 37.0]
    got = [r.p for r in spark.createDataFrame([(t,) for t in ts], "t double").select(inference.normal_two_sided("t").alias("p")).collect()]
    assert got == pytest.approx([math.erfc(t / math.sqrt(2)) for t in ts], rel=1e-9, abs=0)


def test_overlaps_of_bitmaps_equal_sets(spark):
    rng = np.random.default_rng(3)
    sets = {f"s{i}": (str(rng.choice(["a", "b"])), {int(x) for x in rng.choice(90_000, rng.integers(0, 40))}) for i in range(60)}
    rows = [(k, a, x) for k, (a, s) in sets.items() for x in s] + [(k, a, None) for k, (a, s) in sets.items()]
    slices = inference.with_bitmaps(spark.createDataFrame(rows, "key string, asset string, pos long"), ["key", "asset"], "pos")
    want = {k for k, (a, s) in sets.items() if any(k != q and a == b and s & v for q, (b, v) in sets.items())}
    assert {r.key for r in inference.overlapping(slices, "key", "asset").collect()} == want and 0 < len(want) < 60


# --- archives


def zipped(text: bytes, method=zipfile.ZIP_DEFLATED) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", method) as z:
        z.writestr("x.csv", text)
    return buf.getvalue()


HEAD = ",".join(archives.FUNDING).encode()
GOOD = HEAD + b"\n" + b"".join(b"%d,8,0.0001\n" % (1704067200000 + i) for i in range(50_000))


def test_every_fault_of_an_archive_is_a_row(spark):
    good = zipped(GOOD)
    damaged = bytearray(good)
    damaged[len(good) // 2 : len(good) // 2 + 40] = bytes(40)
    encrypted = bytearray(zipped(HEAD + b"\n1,8,0.1\n"))
    encrypted[6] |= 1
    encrypted[encrypted.index(b"PK\x01\x02") + 8] |= 1
    unknown = bytearray(zipped(HEAD + b"\n1,8,0.1\n"))
    struct.pack_into("<H", unknown, 8, 77)
    struct.pack_into("<H", unknown, unknown.index(b"PK\x01\x02") + 10, 77)
    wrong = bytearray(zipped(HEAD + b"\n1,8,0.1\n", zipfile.ZIP_STORED))
    wrong[wrong.index(b"0.1")] = ord("7")
    files = {
        "good": good, "mark": zipped(b"\xef\xbb\xbf" + HEAD + b"\r\n1,8,0.5\r\n"), "damaged": bytes(damaged), "cut": good[: len(good) // 2], "encrypted": bytes(encrypted), "unknown": bytes(unknown), "crc": bytes(wrong), "none": b"", "text": b"no zip",
        "latin": zipped(HEAD + b"\n1,8,\xff\xfe\n"), "short": zipped(HEAD + b"\n1,8,0.5\n1,8\n\n1,8,0.5,9\n2,8,0.6\n"), "empty": zipped(b""), "headonly": zipped(HEAD + b"\n"), "other": zipped(b"a,b\n1,2\n"),
    }
    frame = spark.createDataFrame([(f"/raw/x-funding-{n}.zip", bytearray(c)) for n, c in files.items()], "path string, content binary")
    out = archives.funding(frame).toPandas()
    out["name"] = out.path.str.extract(r"funding-(\w+)\.zip")
    errors = out[out.error.notna()].set_index("name").error.str.split(":").str[0].to_dict()
    assert errors == {
        "damaged": "ARCHIVE_DAMAGED", "cut": "ARCHIVE_UNREADABLE", "encrypted": "ARCHIVE_ENCRYPTED", "unknown": "ARCHIVE_COMPRESSION_UNKNOWN", "crc": "ARCHIVE_DAMAGED", "none": "ARCHIVE_UNREADABLE", "text": "ARCHIVE_UNREADABLE",
        "latin": "ARCHIVE_NOT_UTF8", "short": "ROWS_MALFORMED", "empty": "ARCHIVE_EMPTY", "headonly": "ARCHIVE_EMPTY", "other": "SCHEMA_CHANGED",
    }
    assert out[out.error.isna()].groupby("name").size().to_dict() == {"good": 50_000, "mark": 1, "short": 2}
    assert out[out.name == "short"].error.dropna().tolist() == ["ROWS_MALFORMED: 2 of 4, the first is row 2"]
    lines = archives.zip_lines(frame).toPandas()
    assert lines.error.notna().sum() == 8 and (lines.path.str.contains("good") & lines.error.isna()).sum() == 50_001


# --- streams


def test_a_late_bar_that_hit_earlier_wins_and_state_ends(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    schema = "asset string, event_time timestamp, open double, high double, low double, close double"
    bar = lambda h, low, high, asset="x": (asset, at(h), 10.0, high, low, 10.0)
    batches = [
        [bar(1, 9.0, 11.0), bar(6, 5.0, 11.0)],  # a stop at 6
        [bar(4, 9.0, 21.0)],  # late, a target at 4: it wins
        [bar(30, 9.0, 11.0)],  # the watermark passes 6
        [bar(31, 5.0, 21.0)],  # closed already
        [bar(300, 5.0, 11.0)],  # beyond the horizon: not watched any more
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/batch={i}")
    p = spark.createDataFrame([("p", "x", 1, T0, 10.0, 6.0, 20.0, 100.0, 7.0), ("q", "x", -1, at(7), 10.0, 50.0, 1.0, 100.0, 7.0)], "position_id string, asset string, side int, opened timestamp, entry double, stop double, target double, notional double, stop_risk double")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = []
    try:
        (tmp_path / "live").mkdir(exist_ok=True)
        live = spark.readStream.schema(schema).parquet(f"{tmp_path}/live")
        for i in range(len(batches)):
            for f in (tmp_path / "in" / f"batch={i}").glob("*.parquet"):
                (tmp_path / "live" / f"{i}-{f.name}").write_bytes(f.read_bytes())
            q = streams.exits(live, p, late="12 hours", horizon="10 days").writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "ends").load(f"{tmp_path}/state")
        left = state.count()
    finally:
        spark.conf.set(store, before)
    assert [(r.position_id, r.outcome, r.event_time, r.price) for r in got] == [("p", "TARGET", at(4), 20.0)]
    assert left == 0


def test_a_crashed_batch_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "id int, event_time timestamp, v double"
    rows = lambda *ids: spark.createDataFrame([(i, T0 + timedelta(hours=i), float(i)) for i in ids], schema)
    seen = lambda: sorted(r.id for r in streams.finished(spark, path, rows(1).schema).collect())
    assert streams.finished(spark, path, rows(1).schema) is None
    streams.append_new(rows(1, 2, 2), 0, path, ["id"])
    rows(3, 4).withColumn("day", F.to_date("event_time")).write.partitionBy("day").parquet(f"{path}/data/writer=intake/batch=1")  # written, never committed
    assert seen() == [1, 2]
    streams.append_new(rows(2, 3), 1, path, ["id"])  # the replay, which sees other rows
    assert seen() == [1, 2, 3]
    streams.append_new(rows(2, 3), 1, path, ["id"])
    streams.append_new(rows(3, 60), 0, path, ["id"], writer="other")
    assert seen() == [1, 2, 3, 60]


# --- calendars and trailing windows


def test_calendar_faults_equal_the_grid(spark, small_blocks):
    rng = np.random.default_rng(11)
    times = [T0 + timedelta(hours=int(h)) for h in sorted(rng.choice(400, 60, replace=False))]
    seen = [(str(a), times[int(i)]) for a in "abcx" for i in rng.choice(60, 45)] + [("a", T0 + timedelta(days=99)), ("b", times[0]), ("b", times[-1])]
    observed = spark.createDataFrame(seen, "asset string, event_time timestamp_ntz")
    assets = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "asset string")
    calendar = spark.createDataFrame([(x,) for x in times], "event_time timestamp_ntz")
    out = joins.calendar_faults(assets, calendar, observed)
    want = joins.grid_faults(assets.crossJoin(calendar), observed, ["asset", "event_time"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    runs = joins.missing_runs(assets, timeblocks.numbered(calendar, by=[]), observed)
    assert [(r.first, r.last) for r in runs.filter("asset = 'none'").collect()] == [(0, 59)]  # a run is one row, however long


def test_trailing_medians_equal_a_plain_join(spark):
    rng = np.random.default_rng(12)
    rows = []
    for a, n in (("a", 120), ("b", 40), (None, 5)):
        for d in rng.integers(0, 300, n):
            at = T0 + timedelta(days=int(d), hours=int(rng.integers(0, 24)))
            rows.append((a, at, at + timedelta(hours=int(rng.choice([0, 1, 30, 400]))), float(rng.integers(0, 9)) if rng.random() > 0.1 else None))
    frame = spark.createDataFrame(rows, "asset string, event_time timestamp_ntz, available_time timestamp_ntz, v double")
    days = spark.createDataFrame([(T0 + timedelta(days=i),) for i in range(0, 330, 3)], "selection_time timestamp_ntz")
    got = {(r.asset, r.selection_time): (r.days, r.median) for r in universe.trailing_stats(days, frame, "v", 10).collect()}
    want = {}
    for i in range(0, 330, 3):
        s = T0 + timedelta(days=i)
        for a in ("a", "b", None):
            own = [(e.date(), v) for k, e, av, v in rows if k == a and e < s and av <= s and e >= s - timedelta(days=10)]
            if own:
                values = [v for _, v in own if v is not None]
                want[a, s] = (len({d for d, _ in own}), float(np.median(values)) if values else None)
    assert got == want


def test_funding_cashflow_equals_all_pairs_without_making_them(spark):
    rng = np.random.default_rng(13)
    at = lambda: T0 + timedelta(minutes=30 * int(rng.integers(0, 200)))
    odd = {3: None, 50: float("nan"), 90: float("inf"), 120: float("-inf"), 150: 1e17}
    rates = [(str(rng.choice(["a", "b"])), at(), odd.get(i, float(rng.normal(0, 1e-4)))) for i in range(400)] + [(None, T0, 1.0), ("c", T0, None)]
    spans = [(i // 2, str(rng.choice(["a", "b"])), s, s + timedelta(minutes=30 * int(rng.integers(-2, 60))), float(rng.integers(-5, 90)), int(rng.choice([-1, 1]))) for i in range(300) for s in [at()]]
    spans += spans[:40] + [(900, "c", T0, T0, 5.0, 1), (901, None, T0, T0, 5.0, 1), (902, "a", T0, T0 + timedelta(days=9), None, 1), (903, "a", None, T0, 1.0, 1)]
    p = spark.createDataFrame(spans, "position_id long, asset string, entry timestamp_ntz, exit timestamp_ntz, notional double, sign int")
    f = spark.createDataFrame(rates, "asset string, event_time timestamp_ntz, funding_rate double")
    out = joins.funding_cashflow(p, f)
    assert "sequence(" not in out._jdf.queryExecution().toString()  # days spelt out and joined: pairs of rows
    pairs = p.join(f, (p.asset == f.asset) & f.event_time.between(p.entry, p.exit)).groupBy("position_id").agg(F.sum(-F.col("notional") * F.col("sign") * F.col("funding_rate")).alias("cashflow"), F.count(F.lit(1)).alias("events"))
    got, want = ({r.position_id: (r.cashflow, r.events) for r in x.collect()} for x in (out, pairs))
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] for k in want)
    for k, (w, _) in want.items():
        g = got[k][0]
        assert (g is None) == (w is None) and (w is None or g == pytest.approx(w, rel=1e-9, abs=1e-15, nan_ok=True)), (k, g, w)


@pytest.fixture(scope="module")
def histories(spark):
    """Daily rows of assets of several lengths (one null), with their sizes."""
    rng = np.random.default_rng(14)
    rows = [(a, T0 + timedelta(days=i), float(rng.uniform(90, 110)), float(rng.integers(0, 5))) for a, n in ((1, 90), (2, 40), (3, 12), (None, 33), (None, 0)) for i in range(n)]
    rows += [(4, T0 + timedelta(days=70 + i), 100.0, 1.0) for i in range(30)]
    frame = spark.createDataFrame(rows, "asset long, event_time timestamp_ntz, close double, volume double")
    return frame, frame.groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


def by_asset(frame, order):
    return frame.toPandas().sort_values(["asset", order], na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("rows", [8, 35, 4096])
def test_regime_inputs_of_short_and_long_assets_equal_those_in_blocks(histories, monkeypatch, rows):
    frame, sizes = histories
    want = by_asset(regimes.inputs(frame, 6), "event_time")
    monkeypatch.setattr(timeblocks, "ROWS", rows)
    out = regimes.inputs(frame, 6, sizes=sizes)
    same(by_asset(out, "event_time")[want.columns], want)
    assert ("_to" in out._jdf.queryExecution().analyzed().toString()) == (rows < 90)  # rows are copied only where an asset exceeds a chunk


@pytest.mark.parametrize("rows", [8, 35, 4096])
def test_thresholds_of_short_and_long_assets_equal_a_join(histories, monkeypatch, rows):
    frame, sizes = histories
    monkeypatch.setattr(timeblocks, "ROWS", rows)
    until = T0 + timedelta(days=60)
    out = regimes.with_thresholds(frame, F.lit(until).cast("timestamp_ntz"), 6, sizes=sizes)
    plain = regimes.inputs(frame, 6)
    want = plain.join(regimes.thresholds(plain.filter(F.col("event_time") < until), ["asset"]), "asset")
    want = by_asset(want, "event_time")
    assert set(want.asset) == {1, 2, 3}  # neither rows without an asset nor assets without earlier rows
    same(by_asset(out, "event_time")[want.columns], want)


@pytest.mark.parametrize("rows", [8, 35, 4096])
def test_expanding_thresholds_of_short_and_long_assets_equal_merged_counts(histories, monkeypatch, rows):
    frame, sizes = histories
    frame = regimes.inputs(frame, 6)
    want = by_asset(regimes.expanding_thresholds(frame, initial=3, every=5), "block")
    monkeypatch.setattr(timeblocks, "ROWS", rows)
    same(by_asset(regimes.expanding_thresholds(frame, initial=3, every=5, sizes=sizes), "block")[want.columns], want)
