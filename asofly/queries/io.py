"""Sources, sinks and streams, each over files or payloads that Spark derives from the given tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from asofly.plans import publish
from asofly.queries.base import add, r8, rq, ts, tsq, with_
from asofly.queries.core import BARQ, bar_columns
from asofly.sources import archives, files
from asofly.sources import tables as t
from asofly.streaming import bars as streams


def scratch(spark, tag: str) -> str:
    """A new folder under the shared one; a folder of our own only where none is set and everything runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="asofly-")
    return f"{root}/io-{tag}-{uuid.uuid4().hex}"


def iso(c: str = "event_time"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def millis(c: str = "event_time"):
    return (F.unix_timestamp(F.col(c).cast("timestamp")) * 1000).cast("string")


def text(c: str):
    return F.col(c).cast("string")


INGESTED = "2024-01-25 12:00:00"


@add("A1_legacy_csv", with_("b1") + f"SELECT {BARQ}, {tsq('available_time')}, '1 hour' AS interval, 'legacy_csv' AS source, '{INGESTED}' AS ingested_at, CASE WHEN available_time > TIMESTAMP '{INGESTED}' THEN 'INGESTED_BEFORE_AVAILABLE' END AS reason FROM b1")
def a1(spark, d):
    path = scratch(spark, "legacy")
    t.bars(spark, d).select(iso().alias("event_time"), "open", "high", "low", "close", "volume", "asset").write.option("header", True).partitionBy("asset").csv(path)
    return files.legacy_csv(spark, path, interval="1 hour", ingested_at=INGESTED).select(*bar_columns(), ts("available_time"), "interval", "source", ts("ingested_at"), "reason")


@add("A2_screening_load", with_("b4") + f"SELECT asset, {tsq('event_time')}, {tsq('available_time')}, {rq('close')}, {rq('volume')}, CAST(NULL AS VARCHAR) AS reason, true AS identified FROM b4")
def a2(spark, d):
    path = scratch(spark, "screening")
    t.bars(spark, d, 4).select(millis().alias("open_time"), millis("available_time").alias("close_time"), "close", "volume", "asset").write.option("header", True).partitionBy("asset").csv(path)
    once, again = (files.snapshot_id(spark, path, "4h") for _ in range(2))
    same = once.join(again.withColumnRenamed("files", "_f"), "snapshot_id").select(F.col("snapshot_id").rlike(r"^legacy-ohlcv-4h-[0-9a-f]{64}$").alias("identified"))  # one row
    return files.screening_csv(spark, path).crossJoin(F.broadcast(same)).select("asset", ts("event_time"), ts("available_time"), r8("close"), r8("volume"), "reason", "identified")


@add("A3_tolerant_csv", with_("b1") + f"SELECT asset, {tsq('event_time')}, round(open, 8) AS open, round(close, 8) AS close, 0.0::DOUBLE AS volume FROM b1")
def a3(spark, d):
    path = scratch(spark, "tolerant")
    b = t.bars(spark, d)
    at = F.when(F.hour("event_time") % 3 == 0, iso()).when(F.hour("event_time") % 3 == 1, millis()).otherwise(F.unix_timestamp(F.col("event_time").cast("timestamp")).cast("string"))
    later = b.withColumns({c: F.col(c) - 1 for c in ("open", "close")})  # the same times again, in files that come after
    b.unionByName(later).select(at.alias("Time"), F.col("open").alias("Open_Price"), F.col("high").alias("H"), F.col("low").alias("L"), F.col("close").alias("C"), "asset").write.option("header", True).csv(path)
    return files.tolerant_csv(spark, path).select("asset", ts("event_time"), r8("open"), r8("close"), "volume")


def _archives(frame, kind: str, line, header=None):
    """A ZIP per asset and day; header: a column of its first line, none where it's null."""
    day = F.date_format("event_time", "yyyy-MM-dd")
    rows = frame.select(F.concat(F.lit("/raw/"), "asset", F.lit(f"-{kind}-"), day, F.lit(".zip")).alias("path"), "event_time", F.concat_ws(",", *line).alias("line"))
    lines = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_time", "line"))), lambda x: x["line"]).alias("lines"))  # one archive's lines
    if header is not None:
        lines = lines.withColumn("lines", F.concat(F.array_compact(F.array(header)), "lines"))
    return archives.pack(lines)


NAMES = ",".join((*archives.OHLCV[:8], "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore"))  # the newer ones


def _bar_zips(spark, d, hours: int = 1, kind: str = "1h", header=None):
    line = [millis(), text("open"), text("high"), text("low"), text("close"), text("volume"), millis("available_time"), text("quote_volume"), text("trades"), text("taker_buy_base"), text("taker_buy_base"), F.lit("0")]
    return _archives(t.bars(spark, d, hours), kind, [F.coalesce(c, F.lit("")) for c in line], header)


ODD = "asset = 'view' AND extract('day' FROM event_time) = 3"


@add("A4_ohlcv_archives", with_("b1") + f"SELECT {BARQ}, trades, {tsq('available_time')}, '{INGESTED}' AS ingested_at, 'binance_ohlcv_archive' AS source, {tsq('event_time', 'source_open_time')}, {tsq('available_time', 'source_close_time')}, {rq('quote_volume')}, {rq('taker_buy_base')}, {rq('taker_buy_base', 'taker_buy_quote')}, '1h' AS interval, CAST(NULL AS VARCHAR) AS error FROM b1 WHERE NOT ({ODD})"
     " UNION ALL SELECT DISTINCT asset, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '" + INGESTED + "', 'binance_ohlcv_archive', NULL, NULL, NULL, NULL, NULL, '1h', 'SCHEMA_CHANGED: missing=[''taker_buy_quote''] unexpected=[''taker_quote'']' FROM b1 WHERE " + ODD)
def a4(spark, d):
    """A third of the archives have no header, the others newer names; one asset's third day of a month has an unknown one."""
    odd = F.contains("path", F.lit("/view-")) & F.col("path").rlike(r"-03\.zip$")
    header = F.when(odd, NAMES.replace("taker_buy_quote_volume", "taker_quote")).when(F.crc32("path") % 3 > 0, NAMES)
    out = archives.ohlcv(_bar_zips(spark, d, header=header), ingested_at=INGESTED)
    return out.select(*bar_columns(), "trades", ts("available_time"), ts("ingested_at"), "source", ts("source_open_time"), ts("source_close_time"), r8("quote_volume"), r8("taker_buy_base"), r8("taker_buy_quote"), "interval", "error")


@add("A5_funding_archives", with_("funding") + f"SELECT asset, {tsq('event_time')}, {tsq('event_time', 'available_time')}, '{INGESTED}' AS ingested_at, 'binance_funding_archive' AS source, round(funding_rate, 10) AS funding_rate, funding_interval_hours, CAST(NULL AS VARCHAR) AS error FROM funding UNION ALL SELECT DISTINCT asset, NULL, NULL, '{INGESTED}', 'binance_funding_archive', NULL, NULL, 'ARCHIVE_EMPTY' FROM funding UNION ALL SELECT DISTINCT asset, NULL, NULL, '{INGESTED}', 'binance_funding_archive', NULL, NULL, 'ARCHIVE_UNREADABLE' FROM funding")
def a5(spark, d):
    """Besides its good archives, each asset has one without rows and one that isn't an archive."""
    z = _archives(t.funding(spark, d), "funding", [millis(), text("funding_interval_hours"), text("funding_rate")], F.lit(",".join(archives.FUNDING)))
    bad = t.funding(spark, d).select("asset").distinct()
    empty = archives.pack(bad.select(F.concat(F.lit("/raw/"), "asset", F.lit("-funding-empty.zip")).alias("path"), F.array(F.lit(",".join(archives.FUNDING))).alias("lines")))
    broken = bad.select(F.concat(F.lit("/raw/"), "asset", F.lit("-funding-broken.zip")).alias("path"), F.lit(5).cast("long").alias("length"), F.lit("no zip").cast("binary").alias("content"))
    out = archives.funding(z.unionByName(empty).unionByName(broken), ingested_at=INGESTED)
    return out.select("asset", ts("event_time"), ts("available_time"), ts("ingested_at"), "source", F.round("funding_rate", 10).alias("funding_rate"), "funding_interval_hours", "error")


@add("A6_metrics_archives", with_("oi") + f"SELECT asset, {tsq('event_time')}, {tsq('available_time')}, '{INGESTED}' AS ingested_at, 'binance_metrics_archive' AS source, 'BINANCE_METRICS_DELAY_5M' AS availability_assumption, CASE WHEN open_interest >= 1001 THEN round(open_interest, 8) END AS sum_open_interest, round(sum_open_interest_value, 6) AS sum_open_interest_value, 1.5 AS top_trader_account_long_short_ratio, CAST(NULL AS DOUBLE) AS top_trader_position_long_short_ratio, 0.5 AS global_account_long_short_ratio, round(open_interest / 1000, 8) AS taker_long_short_volume_ratio, {tsq('event_time', 'source_timestamp')} FROM (SELECT * REPLACE (date_trunc('second', event_time) AS event_time, date_trunc('second', available_time) AS available_time) FROM oi)")
def a6(spark, d):
    value = F.when(F.col("open_interest") >= 1001, text("open_interest")).otherwise(F.lit(" "))
    z = _archives(t.open_interest(spark, d), "metrics", [iso(), F.col("asset"), value, text("sum_open_interest_value"), F.lit("1.5"), F.lit(""), F.lit("0.5"), (F.col("open_interest") / 1000).cast("string")], F.lit(",".join(archives.METRICS)))
    out = archives.metrics(z, ingested_at=INGESTED).filter("error is null")
    ratios = ("top_trader_account_long_short_ratio", "top_trader_position_long_short_ratio", "global_account_long_short_ratio")
    return out.select("asset", ts("event_time"), ts("available_time"), ts("ingested_at"), "source", "availability_assumption", r8("sum_open_interest"), F.round("sum_open_interest_value", 6).alias("sum_open_interest_value"), *ratios, r8("taker_long_short_volume_ratio"), "source_timestamp")


@add("A7_fear_greed", f"SELECT {tsq('date_trunc(' + chr(39) + 'second' + chr(39) + ', ts)', 'event_time')}, value, {tsq('date_trunc(' + chr(39) + 'second' + chr(39) + ', ts) + INTERVAL 24 HOUR', 'available_time')}, CAST(NULL AS VARCHAR) AS error FROM events UNION ALL SELECT NULL, NULL, NULL, CASE WHEN c_custkey % 2 = 0 THEN 'EXTERNAL_EMPTY' ELSE 'EXTERNAL_SCHEMA_CHANGED' END FROM customer")
def a7(spark, d):
    """Payloads of a thousand observations at most; and an empty or a malformed one for each customer."""
    e = t.read(spark, d, "events")
    one = F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"), text("value").alias("value"), F.lit("Fear").alias("value_classification"))
    p = e.groupBy(F.floor(F.col("event_id") / 1000).alias("k")).agg(F.to_json(F.struct(F.collect_list(one).alias("data"))).alias("payload")).select("payload")
    bad = t.read(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, '{"data":[]}').otherwise('{"data":"none"}').alias("payload"))
    return files.fear_greed(p.unionByName(bad)).select(ts("event_time"), "value", ts("available_time"), "error")


@add("A8_stablecoin_supply", f"SELECT {tsq('o_orderdate', 'event_time')}, o_totalprice AS supply FROM orders")
def a8(spark, d):
    o = t.read(spark, d, "orders")
    date = F.when(F.col("o_orderkey") % 2 == 0, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    supply = F.when(F.col("o_orderkey") % 3 == 0, text("o_totalprice")).otherwise(F.to_json(F.struct(F.col("o_totalprice").alias("peggedUSD"))))
    row = F.concat(F.lit('{"date":"'), date, F.lit('","totalCirculating":'), supply, F.lit("}"))
    p = o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("payload"))
    return files.stablecoin(p).filter("error is null").select(ts("event_time"), "supply")


@add("A9_fred_csv", f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS value, '{INGESTED}' AS available_time FROM orders WHERE o_orderkey % 5 <> 0")
def a9(spark, d):
    path = scratch(spark, "fred")
    v = F.when(F.col("o_orderkey") % 5 == 0, F.lit(".")).otherwise(text("o_totalprice"))
    t.read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("observation_date"), v.alias("DGS10")).write.option("header", True).csv(path)
    return files.fred(spark.read.option("header", True).csv(path), "DGS10", observed_at=INGESTED).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "value", ts("available_time"))


@add("A10_kline_json", with_("b1") + f"SELECT {BARQ}, CASE WHEN event_time > TIMESTAMP '{INGESTED}' THEN 'FUTURE_TIMESTAMP' END AS reason FROM b1 WHERE trades % 7 <> 0")
def a10(spark, d):
    row = F.when(F.col("trades") % 7 == 0, F.array(millis(), F.lit("broken"))).otherwise(F.array(millis(), *(text(c) for c in ("open", "high", "low", "close", "volume"))))
    p = t.bars(spark, d).groupBy("asset", F.to_date("event_time").alias("day")).agg(F.to_json(F.collect_list(row)).alias("payload"))
    return files.klines(p, now=INGESTED).select(*bar_columns(), "reason")


@add("A11_daily_returns", with_("b24") + "SELECT strftime(event_time, '%Y-%m-%d') AS day, " + ", ".join(f"round(max(CASE WHEN asset = '{a}' THEN close / nullif(open, 0) - 1 END), 8) AS {a}" for a in ("click", "error", "view")) + " FROM b24 GROUP BY 1")
def a11(spark, d):
    return archives.daily_returns(_bar_zips(spark, d, 24, "1d"), ["click", "error", "view"]).select("day", *(r8(c) for c in ("click", "error", "view")))


@add("A12_parquet_lake", with_("funding") + f"SELECT asset, {tsq('event_time')}, round(funding_rate, 10) AS funding_rate FROM funding")
def a12(spark, d):
    path = scratch(spark, "lake")
    t.funding(spark, d).withColumn("plan", F.lit("p1")).withColumn("part", F.col("asset")).write.partitionBy("plan", "part").parquet(path)
    out = files.lake(spark, path, ["asset", "event_time", "funding_rate"])
    return out.select("asset", ts("event_time"), F.round("funding_rate", 10).alias("funding_rate"))


@add("A13_snapshot_scan", with_("b1") + f"SELECT asset, {tsq('event_time')}, round(close, 8) AS close FROM b1")
def a13(spark, d):
    path = scratch(spark, "snapshot")
    t.bars(spark, d).write.parquet(path)
    return files.narrow(spark.read.parquet(path), ["asset", "event_time", "close", "not_there"], ["asset", "close"]).select("asset", ts("event_time"), r8("close"))


@add("A14_universe_documents", with_("members", more="g AS (SELECT *, strftime(selection_time, 'u-%Y-%m-%d') AS artifact_id, CASE WHEN day(selection_time) % 7 IN (3, 5) THEN 'POPULAR_UNIVERSE_ARTIFACT_MISSING' END AS error FROM members)") + f"SELECT artifact_id, asset, {tsq('selection_time')}, rank, error FROM g WHERE error IS NULL UNION ALL SELECT DISTINCT artifact_id, NULL, NULL, CAST(NULL AS INTEGER), error FROM g WHERE error IS NOT NULL")
def a14(spark, d):
    """A document a day, all wanted; two of each seven days are without one: of the one there's none, the other is damaged."""
    path = scratch(spark, "universe")
    m = t.membership(spark, d).groupBy("selection_time").agg(F.collect_list(F.struct("asset", "rank")).alias("members"))
    m = m.withColumn("artifact_id", F.date_format("selection_time", "'u-'yyyy-MM-dd"))
    payload = F.to_json(F.struct("artifact_id", iso("selection_time").alias("selection_time"), "members"))
    left = F.dayofmonth("selection_time") % 7
    m.filter(left != 3).select(F.when(left == 5, F.substring(payload, 1, 40)).otherwise(payload).alias("value")).write.text(path)
    out = files.universe_days(spark.read.text(path).withColumnRenamed("value", "payload"), m.select("artifact_id"))
    return out.select("artifact_id", "asset", ts("selection_time"), "rank", "error")


@add("A15_gated_write", with_("b1") + f"SELECT {BARQ} FROM b1")
def a15(spark, d):
    path = scratch(spark, "gated")
    publish.write_gated(t.bars(spark, d), path, step_hours=1)
    return spark.read.parquet(path).select(*bar_columns())


@add("A16_immutable_partitions", with_("b1") + "SELECT asset, count(*) AS n FROM b1 GROUP BY asset")
def a16(spark, d):
    path = scratch(spark, "parts")
    b = t.bars(spark, d)
    known = publish.write_new_partitions(b.filter("not asset <=> 'view'"), path, "asset")
    publish.write_new_partitions(b, path, "asset", known)  # only what's new is appended
    return spark.read.schema(b.schema).parquet(path).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


@add("A17_publish_snapshot", with_("b1") + f"SELECT 'macro-1h' AS name, 'research' AS layer, count(*) AS row_count, {tsq('min(event_time)', 'first_event')}, {tsq('max(available_time)', 'last_available')} FROM b1")
def a17(spark, d):
    m = publish.manifest(t.bars(spark, d), "macro-1h", "research")
    return m.select("name", "layer", "row_count", ts("min_event_time", "first_event"), ts("max_available_time", "last_available"))


@add("A18_manifest_register", with_("b1", "b4") + "SELECT 'b1' AS name, (SELECT count(*) FROM b1) AS row_count UNION ALL SELECT 'b4', (SELECT count(*) FROM b4)")
def a18(spark, d):
    one, four = publish.manifest(t.bars(spark, d), "b1", "canonical"), publish.manifest(t.bars(spark, d, 4), "b4", "canonical")
    cat = publish.register(publish.register(publish.register(None, one), four), one)
    return cat.select("name", "row_count")


@add("A19_archive_integrity", with_("b1", more="a AS (SELECT DISTINCT asset, date_trunc('day', event_time) AS day FROM b1)") + "SELECT CASE WHEN asset = 'click' THEN 'UNREGISTERED' WHEN asset = 'view' THEN 'CHECKSUM_MISMATCH' ELSE 'OK' END AS status, count(*) AS n FROM a GROUP BY 1")
def a19(spark, d):
    z = _bar_zips(spark, d)
    sha = F.when(F.contains("path", F.lit("view")), F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256))
    m = z.filter(~F.contains("path", F.lit("click"))).select("path", sha.alias("sha256"), F.col("length").alias("bytes"))
    return archives.integrity(z, m).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@add("A20_earliest_verified", with_("b1") + f"SELECT asset, 'bars' AS dataset, '1h' AS granularity, strftime(min(event_time), '%Y-%m-%d') AS first_period, {tsq('min(event_time)', 'first_event')} FROM b1 GROUP BY asset UNION ALL SELECT DISTINCT asset, 'bars', '4h', NULL, NULL FROM b1")
def a20(spark, d):
    """Hourly archives, of which the first periods are found, and four-hourly ones, which are asked for but not there."""
    z = _bar_zips(spark, d)
    ok = archives.integrity(z, z.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")))
    p = ok.withColumn("asset", archives.asset_of(F.col("path"))).withColumn("granularity", archives.interval_of(F.col("path"))).withColumn("dataset", F.lit("bars")).withColumn("period", F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.zip$", 1))
    first = archives.ohlcv(z).groupBy("path").agg(F.min("event_time").alias("first_event"))
    found = archives.earliest_verified(p.join(first, "path")).select("asset", "dataset", "granularity", "first_period", ts("first_event"))
    wanted = p.select("asset", "dataset", F.explode(F.array(F.lit("1h"), F.lit("4h"))).alias("granularity"))
    return found.unionByName(archives.unverified(found, wanted), allowMissingColumns=True)


@add("A21_fingerprint", with_("b1") + "SELECT asset, count(*) AS row_count, true AS stable FROM b1 GROUP BY asset")
def a21(spark, d):
    b = t.bars(spark, d).select("asset", iso().alias("event_time"), "close")
    other = b.repartition(7, "close")
    j = publish.fingerprint(b, ["asset"]).join(publish.fingerprint(other, ["asset"]).select("asset", F.col("fingerprint").alias("_f")), "asset")
    return j.select("asset", "row_count", (F.col("fingerprint") == F.col("_f")).alias("stable"))


LISTED = """l AS (SELECT DISTINCT event_type AS asset, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, CASE asset WHEN 'view' THEN 'CANONICAL_INPUT_EXCLUSIONS_INVALID' WHEN 'click' THEN 'CANONICAL_INPUT_EXCLUSIONS_DUPLICATE' END AS error FROM l)"""


@add("A22_exclusion_lists", f"WITH {LISTED} SELECT asset, asset || '|' || strftime(day, '%Y-%m-%d') AS identity_key, 'SOURCE_ARCHIVE_404' AS reason_code, strftime(day, '%Y-%m-%d') AS observed_on, error FROM g WHERE error IS NULL UNION ALL SELECT DISTINCT asset, NULL, NULL, NULL, error FROM g WHERE error IS NOT NULL")
def a22(spark, d):
    """A list for each asset, of every day with events: one of another version and one with a day twice are refused as a whole."""
    days = t.read(spark, d, "events").select(F.col("event_type").alias("asset"), F.to_date("ts").alias("day")).distinct()
    again = days.filter("asset = 'click'").groupBy("asset").agg(F.min("day").alias("day"))
    key = F.concat_ws("|", "asset", F.date_format("day", "yyyy-MM-dd"))
    entry = F.struct(key.alias("identity_key"), F.lit(files.EXCLUDED_STATUS).alias("status"), F.lit(files.EXCLUDED_REASON).alias("reason_code"), F.concat(F.lit("https://example.org/"), key).alias("source_url"), key.alias("evidence_ref"), F.date_format("day", "yyyy-MM-dd").alias("observed_on"))
    version = F.when(F.col("asset") == "view", "v0").otherwise(files.EXCLUSIONS_VERSION)
    lists = days.unionByName(again).groupBy("asset").agg(F.collect_list(entry).alias("exclusions"))
    p = lists.select(F.col("asset").alias("path"), F.to_json(F.struct(version.alias("schema_version"), "exclusions")).alias("payload"))
    return files.exclusions(p).select(F.col("path").alias("asset"), "identity_key", "reason_code", F.date_format("observed_on", "yyyy-MM-dd").alias("observed_on"), "error")


METRICS = ("n_trades", "win_rate", "avg_win", "avg_loss", "profit_factor", "total", "best", "worst")


@add("A23_result_export", with_("b1", "trades") + f"""SELECT 'curve' AS part, asset AS name, CAST(NULL AS VARCHAR) AS metric, {tsq('event_time', 'at')}, round(close, 8) AS value FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY event_time) - 1 AS rn FROM b1) WHERE rn % 6 = 0
 UNION ALL SELECT 'trade', outcome, NULL, {tsq('exit_time', 'at')}, round(pnl, 8) FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY exit_time DESC, trade_id DESC, leg DESC) AS rn FROM trades) WHERE rn <= 50
 UNION ALL SELECT 'metric', outcome, metric, NULL, value FROM (SELECT outcome, unnest(['n_trades', 'win_rate', 'avg_win', 'avg_loss', 'profit_factor', 'total', 'best', 'worst']) AS metric, unnest([count(*), round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 8), round(avg(CASE WHEN pnl > 0 THEN pnl END), 4), round(avg(CASE WHEN pnl <= 0 THEN pnl END), 4), round(sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl <= 0 THEN pnl END), 0), 8), round(sum(pnl), 4), round(max(pnl), 4), round(min(pnl), 4)]) AS value FROM trades GROUP BY outcome)""")
def a23(spark, d):
    """One JSON document set: every sixth bar, and of each group the last fifty trades and all metrics."""
    from asofly.operators import strategy

    path = scratch(spark, "export")
    none = F.lit(None).cast("string")
    curve = strategy.every_kth(t.bars(spark, d), 6).select(F.lit("curve").alias("part"), F.col("asset").alias("name"), none.alias("metric"), iso().alias("at"), F.col("close").alias("value"))
    tail = strategy.last_rows(t.trades(spark, d), ["outcome"], ["exit_time", "trade_id", "leg"], 50).select(F.lit("trade").alias("part"), F.col("outcome").alias("name"), none.alias("metric"), iso("exit_time").alias("at"), F.col("pnl").alias("value"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), 8 if m in ("win_rate", "profit_factor") else 4).alias("value")) for m in METRICS))).alias("m")
    metric = strategy.trade_metrics(t.trades(spark, d), ["outcome"]).select("outcome", each).select(F.lit("metric").alias("part"), F.col("outcome").alias("name"), "m.metric", none.alias("at"), "m.value")
    curve.unionByName(tail).unionByName(metric).write.partitionBy("part").json(path)
    return spark.read.schema("name string, metric string, at string, value double, part string").json(path).select("part", "name", "metric", "at", r8("value"))


@add("K4_archive_table_function", with_("b1") + f"SELECT asset, strftime(event_time, '%Y-%m-%d') AS day, CAST(row_number() OVER (PARTITION BY asset, date_trunc('day', event_time) ORDER BY event_time) - 1 AS INTEGER) AS line_no, {tsq('event_time')}, 12 AS fields, CAST(NULL AS VARCHAR) AS error FROM b1 UNION ALL SELECT DISTINCT asset, 'damaged', -1, NULL, CAST(NULL AS INTEGER), 'ARCHIVE_DAMAGED' FROM b1")
def k4(spark, d):
    """Every line of every archive; and, for each asset, one whose packed bytes are spoilt."""
    good = _bar_zips(spark, d)
    one = archives.pack(t.bars(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("/raw/"), "asset", F.lit("-1h-damaged.zip")).alias("path"), F.array(F.repeat(F.lit("1,2,3,"), 500)).alias("lines")))
    spoilt = F.concat(F.substring("content", 1, 60), F.unhex(F.lit("ffffffffffff")), F.expr("substring(content, 67)"))
    lines = archives.zip_lines(good.unionByName(one.withColumn("content", spoilt)))
    fields = F.split("line", ",")
    day = F.regexp_extract("path", r"-1h-(.+)\.zip$", 1)
    return lines.select(archives.asset_of(F.col("path")).alias("asset"), day.alias("day"), "line_no", ts(archives.moment(fields[0]), "event_time"), F.when(F.col("line").isNotNull(), F.size(fields)).alias("fields"), "error")


FILES = 4  # of a slice of the stream, which is a micro-batch


def _slices(spark, frame, path, at: str = "event_time"):
    """Write a frame in slices of time, one after another, so the files' times keep their order."""
    edges = [None, "2024-01-08", "2024-01-15", "2024-01-22", None]
    for low, high in zip(edges, edges[1:]):
        part = frame
        if low:
            part = part.filter(F.col(at) >= F.lit(low).cast(frame.schema[at].dataType))
        if high:
            part = part.filter(F.col(at) < F.lit(high).cast(frame.schema[at].dataType))
        part.repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def _stream(spark, d, tag):
    """events as a stream of Parquet files in order of time."""
    e = t.read(spark, d, "events").select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("tie"), "value")
    return _slices(spark, e, scratch(spark, tag))


def _drain(spark, frame, tag, mode="append"):
    path = scratch(spark, tag)
    q = frame.writeStream.outputMode(mode).option("checkpointLocation", path + "-state").trigger(availableNow=True).format("parquet").start(path)
    q.awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


@add("J1_streaming_bars", with_("b4") + f"SELECT asset, {tsq('event_time')}, round(open, 8) AS open, round(close, 8) AS close, round(volume, 6) AS volume FROM b4 WHERE available_time <= TIMESTAMP '2024-01-27'")
def j1(spark, d):
    out = _drain(spark, streams.stream_bars(_stream(spark, d, "ticks"), "4 hours", late="2 days"), "bars")
    # Windows that end two days before the last tick or earlier have passed the watermark.
    got = out.withColumn("event_time", F.col("event_time").cast("timestamp_ntz")).filter("event_time + interval 4 hours <= timestamp_ntz'2024-01-27'")
    return got.select("asset", ts("event_time"), r8("open"), r8("close"), F.round("volume", 6).alias("volume"))


@add("J2_exactly_once_intake", "SELECT event_type AS asset, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def j2(spark, d):
    s = _stream(spark, d, "intake")
    path, twice = scratch(spark, "table"), s.unionByName(s)
    q = streams.once(twice, ["asset", "tie"], late="40 days").writeStream.foreachBatch(lambda b, i: streams.append_new(b, i, path, ["asset", "tie"])).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return streams.finished(spark, path, s.schema).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@add("J3_record_routing", "SELECT coalesce(CASE WHEN value < 1 THEN 'MALFORMED' WHEN ts > TIMESTAMP '2024-01-20 00:01:00' THEN 'FUTURE' WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 5 DAY THEN 'STALE' END, 'ACCEPTED') AS reason, count(*) AS n FROM events GROUP BY 1")
def j3(spark, d):
    s = _stream(spark, d, "route").withColumn("value", F.when(F.col("value") >= 1, F.col("value")))
    out = _drain(spark, streams.route(s, now="2024-01-20 00:00:00", stale_minutes=5 * 1440), "routed")
    return out.groupBy(F.coalesce("reason", F.lit("ACCEPTED")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


POS = """p AS (SELECT asset, CASE WHEN side = 1 THEN 'long-' ELSE 'short-' END || asset AS position_id, side, TIMESTAMP '2024-01-05' AS opened, 50.0 AS entry, CASE WHEN side = 1 THEN 0.5 ELSE 400.0 END AS stop, CASE WHEN side = 1 THEN 200.0 ELSE 0.8 END AS target, 90.0 AS notional, 5.0 AS stop_risk FROM (SELECT DISTINCT asset FROM b4), (VALUES (1), (-1)) v(side)),
 x AS (SELECT p.*, b4.event_time, CASE WHEN (side = 1 AND low <= stop) OR (side = -1 AND high >= stop) THEN 'STOP' WHEN (side = 1 AND high >= target) OR (side = -1 AND low <= target) THEN 'TARGET' END AS outcome FROM b4 JOIN p ON p.asset = b4.asset WHERE event_time > opened)"""


@add("J4_exit_monitor", with_("b4", more=POS) + f"SELECT position_id, {tsq('min(event_time)', 'event_time')}, arg_min(outcome, event_time) AS outcome, round(arg_min(CASE WHEN outcome = 'STOP' THEN stop ELSE target END, event_time), 8) AS price, round(arg_min(CASE WHEN outcome = 'STOP' THEN -stop_risk ELSE notional * side * (target - entry) / entry END, event_time), 8) AS pnl FROM x WHERE outcome IS NOT NULL GROUP BY position_id")
def j4(spark, d):
    """A long and a short position in every asset, the bars coming in slices of time."""
    b = t.bars(spark, d, 4)
    side = F.explode(F.array(F.lit(1), F.lit(-1)))
    p = b.select("asset").distinct().withColumn("side", side).withColumns({
        "position_id": F.concat(F.when(F.col("side") == 1, "long-").otherwise("short-"), "asset"), "opened": F.lit("2024-01-05").cast("timestamp_ntz"), "entry": F.lit(50.0),
        "stop": F.when(F.col("side") == 1, 0.5).otherwise(400.0), "target": F.when(F.col("side") == 1, 200.0).otherwise(0.8), "notional": F.lit(90.0), "stop_risk": F.lit(5.0),
    })
    at = lambda f, c: f.withColumn(c, F.col(c).cast("timestamp"))
    beat = b.limit(1).withColumns({"asset": F.lit("heartbeat"), "event_time": F.lit("2024-03-01").cast("timestamp_ntz")})  # a later bar, which lets the last hits through
    live = at(_slices(spark, b.unionByName(beat), scratch(spark, "exit-bars")), "event_time")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = _drain(spark, streams.exits(live, at(p, "opened")), "exits")
    finally:
        spark.conf.set(store, before)
    return out.select("position_id", ts("event_time"), "outcome", r8("price"), r8("pnl"))
