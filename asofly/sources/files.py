"""CSV, JSON and Parquet sources of market data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = ("open", "high", "low", "close", "volume")
#: Names that a column may have.
TIMES = ("timestamp", "open_time", "datetime", "date", "time")
ALIASES = {"open": ("open", "o", "open_price"), "high": ("high", "h", "high_price"), "low": ("low", "l", "low_price"), "close": ("close", "c", "close_price"), "volume": ("volume", "vol", "v")}


def guessed_time(text: Column) -> Column:
    """A time written as seconds (nine digits or more), milliseconds (thirteen), a day of eight digits, or ISO text; else null."""
    epoch = F.when(F.length(text) >= 13, F.timestamp_millis(text.try_cast("long"))).otherwise(F.timestamp_seconds(text.try_cast("long"))).cast("timestamp_ntz")
    day = F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("timestamp_ntz")
    return F.when(text.rlike(r"^\d{9,}$"), epoch).when(text.rlike(r"^\d{8}$"), day).otherwise(text.try_cast("timestamp_ntz"))


def legacy_csv(spark: SparkSession, path: str, *, interval: str, ingested_at: str | None = None) -> DataFrame:
    """OHLCV CSV files, the asset a folder (`asset=<name>`): event time, and availability one interval later.

    Rows that weren't available yet when they were ingested have a reason.
    """
    raw = spark.read.option("header", True).schema("event_time string, open double, high double, low double, close double, volume double, asset string").csv(path)
    at = guessed_time(F.col("event_time"))
    out = raw.select("asset", F.lit(interval).alias("interval"), at.alias("event_time"), (at + F.expr(f"interval {interval}")).alias("available_time"), F.lit(ingested_at).cast("timestamp_ntz").alias("ingested_at"), F.lit("legacy_csv").alias("source"), *NUMBERS)
    return out.withColumn("reason", F.when(F.col("available_time") > F.col("ingested_at"), "INGESTED_BEFORE_AVAILABLE"))


def screening_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with open_time and close_time in milliseconds, close and volume, the asset a folder: available at the close.

    Rows that were available before their event have a reason.
    """
    raw = spark.read.option("header", True).schema("open_time string, close_time string, close double, volume double, asset string").csv(path)
    start, end = (F.timestamp_millis(F.col(c).try_cast("long")).cast("timestamp_ntz") for c in ("open_time", "close_time"))
    out = raw.select("asset", start.alias("event_time"), end.alias("available_time"), "close", "volume")
    return out.withColumn("reason", F.when(F.col("available_time") < F.col("event_time"), "AVAILABLE_BEFORE_EVENT"))


def snapshot_id(spark: SparkSession, path: str, interval: str) -> DataFrame:
    """One row: an id that follows from the names and bytes of all files under a path, each hashed where it's read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path)
    one = f.select(F.concat_ws(":", F.regexp_replace("path", r"^.*/(?=[^/]*=)|^.*/", ""), F.sha2("content", 256)).alias("h"))
    return one.agg(F.concat(F.lit(f"legacy-ohlcv-{interval}-"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256)).alias("snapshot_id"), F.count(F.lit(1)).alias("files"))


def tolerant_csv(spark: SparkSession, path: str) -> DataFrame:
    """OHLCV CSV with unknown column names: time guessed (the first column if none is named so), volume 0 by default.

    Of several rows of a time and asset the first stays, by file and place in it. A price column that's missing is an error.
    """
    raw = spark.read.option("header", True).csv(path)
    time = next((c for c in raw.columns if c.lower() in TIMES), raw.columns[0])
    named = {n: c for c in raw.columns for n, also in ALIASES.items() if c.lower().strip() in also}
    missing = [n for n in NUMBERS[:4] if n not in named]
    if missing:
        raise ValueError(f"CSV_COLUMNS_MISSING: {missing}")
    cols = [(F.col(named[n]).try_cast("double") if n in named else F.lit(0.0)).alias(n) for n in NUMBERS]
    asset = next((F.col(c) for c in raw.columns if c.lower().strip() == "asset"), F.lit(None).cast("string"))
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("_at")
    rows = raw.select(asset.alias("asset"), guessed_time(F.col(time)).alias("event_time"), *cols, place).filter("event_time is not null")
    return rows.groupBy("asset", "event_time").agg(F.min_by(F.struct(*NUMBERS), "_at").alias("r")).select("asset", "event_time", "r.*")


def _observations(payloads: DataFrame, column: Column) -> DataFrame:
    """x of every observation, and an error where a payload holds no list (x and error never both)."""
    r = payloads.select(column.alias("_list"))
    code = F.when(F.col("_list").isNull(), "EXTERNAL_SCHEMA_CHANGED").when(F.size("_list") == 0, "EXTERNAL_EMPTY")
    return r.select(F.explode_outer("_list").alias("x"), code.alias("error"))


def fear_greed(payloads: DataFrame) -> DataFrame:
    """Index values of JSON payloads {data: [{timestamp, value, value_classification}]}, known a day later.

    A payload that isn't such a list, an empty one, and an observation without time or value give a row with an error.
    """
    schema = "data array<struct<timestamp:string,value:string,value_classification:string>>"
    r = _observations(payloads, F.from_json("payload", schema)["data"])
    at, value = F.timestamp_seconds(F.col("x.timestamp").try_cast("long")).cast("timestamp_ntz"), F.col("x.value").try_cast("double")
    error = F.coalesce("error", F.when(at.isNull() | value.isNull(), "EXTERNAL_SCHEMA_CHANGED"))
    return r.select(at.alias("event_time"), value.alias("value"), F.col("x.value_classification").alias("label"), (at + F.expr("interval 24 hours")).alias("available_time"), F.lit("low").alias("revision_risk"), error.alias("error"))


def stablecoin(payloads: DataFrame) -> DataFrame:
    """Supply of JSON payloads [{date, totalCirculating}]: the date epoch or ISO, the supply a number or {peggedUSD}; errors as in fear_greed."""
    r = _observations(payloads, F.from_json("payload", "array<struct<date:string,totalCirculating:string>>"))
    supply = F.coalesce(F.get_json_object("x.totalCirculating", "$.peggedUSD"), F.col("x.totalCirculating")).try_cast("double")
    at = guessed_time(F.col("x.date"))
    return r.select(at.alias("event_time"), supply.alias("supply"), F.coalesce("error", F.when(at.isNull() | supply.isNull(), "EXTERNAL_SCHEMA_CHANGED")).alias("error"))


def fred(rows: DataFrame, series: str, *, observed_at: str | None = None) -> DataFrame:
    """observation_date and value columns as text; blanks are dropped. Known from when it was read, as values are revised."""
    missing = sorted({"observation_date", series} - set(rows.columns))
    if missing:
        raise ValueError(f"EXTERNAL_SCHEMA_CHANGED: {missing}")
    return rows.select(F.col("observation_date").try_cast("date").alias("day"), F.col(series).try_cast("double").alias("value"), F.lit(observed_at).cast("timestamp_ntz").alias("available_time"), F.lit("high").alias("revision_risk")).filter("value is not null")


def klines(payloads: DataFrame, *, now: str | None = None) -> DataFrame:
    """Bars of JSON arrays of arrays; malformed rows are dropped, rows after `now` have a reason. payloads: asset, payload."""
    r = payloads.select("asset", F.explode(F.from_json("payload", "array<array<string>>")).alias("x")).filter(F.size("x") >= 6)
    out = r.select("asset", F.timestamp_millis(F.col("x")[0].try_cast("long")).cast("timestamp_ntz").alias("event_time"), *(F.col("x")[i + 1].try_cast("double").alias(n) for i, n in enumerate(NUMBERS)))
    return out.dropna(subset=["event_time", *NUMBERS]).withColumn("reason", F.when(F.col("event_time") > F.lit(now).cast("timestamp_ntz"), "FUTURE_TIMESTAMP"))


def universe_days(documents: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """artifact_id, asset, selection_time, rank, error of universe documents {artifact_id, selection_time, members: [{asset, rank}]}.

    wanted (artifact_id): only those are read, and each that no readable document holds is a row with an error. Without it,
    a document that can't be read is such a row.
    """
    r = documents.select(F.from_json("payload", "artifact_id string, selection_time string, members array<struct<asset:string,rank:int>>").alias("d"))
    r = r.select("d.artifact_id", F.col("d.selection_time").try_cast("timestamp_ntz").alias("selection_time"), "d.members")
    whole = F.col("artifact_id").isNotNull() & F.col("selection_time").isNotNull() & F.col("members").isNotNull()
    if wanted is None:
        out = r.withColumn("error", F.when(~whole, "POPULAR_UNIVERSE_ARTIFACT_INVALID"))
    else:
        out = wanted.select("artifact_id").distinct().join(r.filter(whole), "artifact_id", "left").withColumn("error", F.when(F.col("members").isNull(), "POPULAR_UNIVERSE_ARTIFACT_MISSING"))
    members = F.when(F.col("error").isNull(), F.col("members"))  # an empty universe has no rows
    kept = out.filter(F.col("error").isNotNull() | (F.size("members") > 0))
    return kept.select("artifact_id", "selection_time", "error", F.explode_outer(members).alias("m")).select("artifact_id", "m.asset", "selection_time", "m.rank", "error")


#: What an exclusion list and its entries must say.
EXCLUSIONS_VERSION = "canonical-input-exclusions-v1"
EXCLUDED_STATUS, EXCLUDED_REASON = "permanently_unavailable", "SOURCE_ARCHIVE_404"
ENTRY = "struct<identity_key:string,status:string,reason_code:string,source_url:string,evidence_ref:string,observed_on:string>"


def exclusions(documents: DataFrame) -> DataFrame:
    """path, identity_key, reason_code, source_url, evidence_ref, observed_on, error of exclusion lists {schema_version, exclusions: [..]}.

    A list is taken or refused as a whole: of another version, without a list, or with an entry that lacks a field or says
    another status or reason, it is one row CANONICAL_INPUT_EXCLUSIONS_INVALID; with an identity twice, one row
    CANONICAL_INPUT_EXCLUSIONS_DUPLICATE. A list without entries excludes nothing. documents: path, payload.
    """
    text = F.from_json("payload", f"schema_version string, exclusions array<{ENTRY}>")
    r = documents.select("path", text.alias("d"), F.get_json_object("payload", "$.exclusions").alias("given"))
    entries = F.coalesce("d.exclusions", F.array().cast(f"array<{ENTRY}>"))
    fields = ("identity_key", "source_url", "evidence_ref")
    bad = F.exists(entries, lambda e: e.isNull() | ~F.coalesce((e["status"] == EXCLUDED_STATUS) & (e["reason_code"] == EXCLUDED_REASON), F.lit(False)) | F.coalesce(*(F.when(e[c].isNull(), True) for c in fields), F.lit(False)) | e["observed_on"].try_cast("date").isNull())
    keys = F.transform(entries, lambda e: e["identity_key"])
    invalid = ~F.coalesce(F.col("d.schema_version") == EXCLUSIONS_VERSION, F.lit(False)) | (F.col("given").isNotNull() & F.col("d.exclusions").isNull()) | bad
    error = F.when(invalid, "CANONICAL_INPUT_EXCLUSIONS_INVALID").when(F.size(keys) > F.size(F.array_distinct(keys)), "CANONICAL_INPUT_EXCLUSIONS_DUPLICATE")
    out = r.select("path", error.alias("error"), entries.alias("entries")).filter("error is not null or size(entries) > 0")
    out = out.select("path", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("entries"))).alias("e"))
    return out.select("path", "e.identity_key", "e.reason_code", "e.source_url", "e.evidence_ref", F.col("e.observed_on").try_cast("date").alias("observed_on"), "error")


def lake(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """Parquet files of a pattern; damaged files are skipped, files of other columns give nulls, the path is kept."""
    raw = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").parquet(pattern)
    have = [c for c in columns if c in raw.columns]
    return raw.select(*have, F.col("_metadata.file_path").alias("file_path")).dropna(subset=have)


def narrow(frame: DataFrame, wanted: list[str], required: list[str]) -> DataFrame:
    """The wanted columns that exist; a missing required one is an error."""
    missing = sorted(set(required) - set(frame.columns))
    if missing:
        raise ValueError(f"SNAPSHOT_COLUMNS_MISSING: {missing}")
    return frame.select(*(c for c in wanted if c in frame.columns))

