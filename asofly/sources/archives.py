"""Exchange archives (ZIP with one CSV member) as tables, parsed in parallel over the files."""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of each kind of archive, and newer names of some.
OHLCV = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")
FUNDING = ("calc_time", "funding_interval_hours", "last_funding_rate")
METRICS = ("create_time", "symbol", "sum_open_interest", "sum_open_interest_value", "count_toptrader_long_short_ratio", "sum_toptrader_long_short_ratio", "count_long_short_ratio", "sum_taker_long_short_vol_ratio")
PIECE = 20_000  # rows that a worker hands on at once
NEWER = {"count": "trades", "taker_buy_volume": "taker_buy_base", "taker_buy_quote_volume": "taker_buy_quote"}


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of every file under a path that Spark can read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


@contextmanager
def only_csv(content: bytes) -> Iterator[io.TextIOWrapper]:
    """The one CSV member of an archive as text that is unpacked while it's read; a byte-order mark isn't part of it.

    What keeps it from being read, at the start or in the middle, is a ValueError with a code.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            members = [m for m in z.infolist() if not m.is_dir() and m.filename[-4:].lower() == ".csv"]
            if len(members) != 1:
                raise ValueError("ARCHIVE_NOT_ONE_CSV")
            if members[0].flag_bits & 1:
                raise ValueError("ARCHIVE_ENCRYPTED")
            with z.open(members[0]) as f:
                yield io.TextIOWrapper(f, encoding="utf-8-sig", newline="")
    except UnicodeDecodeError as e:
        raise ValueError("ARCHIVE_NOT_UTF8") from e
    except NotImplementedError as e:
        raise ValueError("ARCHIVE_COMPRESSION_UNKNOWN") from e
    except csv.Error as e:
        raise ValueError("ARCHIVE_NOT_CSV") from e
    except (zlib.error, EOFError, OSError) as e:
        raise ValueError("ARCHIVE_DAMAGED") from e
    except (zipfile.BadZipFile, RuntimeError) as e:
        raise ValueError("ARCHIVE_DAMAGED" if "CRC" in str(e) else "ARCHIVE_UNREADABLE") from e


def _pieces(rows: Iterable[list], n: int = PIECE) -> Iterator[list[list]]:
    rows = iter(rows)
    while some := list(islice(rows, n)):
        yield some


def zip_lines(files: DataFrame) -> DataFrame:
    """path, line_no, line, error of every archive: a table function from bytes to rows.

    Archives are read twice, so that one that turns out to be damaged gives a single row with an error and no line, and in
    pieces, so that a worker never holds a whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("line_no", pa.int32()), ("line", pa.string()), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                try:
                    with only_csv(content) as text:
                        for _ in text:
                            pass
                    with only_csv(content) as text:
                        for part in _pieces((i, line.rstrip("\r\n")) for i, line in enumerate(text)):
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([i for i, _ in part], pa.int32()), pa.array([x for _, x in part], pa.string()), pa.nulls(len(part), pa.string())], schema=schema)
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "line_no": -1, "line": None, "error": str(e)}], schema)

    return files.select("path", "content").mapInArrow(run, "path string, line_no int, line string, error string")


def parse(files: DataFrame, columns: tuple[str, ...], *, headless: bool = False) -> DataFrame:
    """path, error and the columns as text of every CSV row in the archives.

    A header may name the columns in any order, by newer names too; headless: a first row that starts with digits is data.
    An archive that can't be read to its end, has other columns or no rows gives a single row with an error. Rows with
    another number of fields are counted in a row of their own with an error, beside the good ones; blank lines don't
    count. So nothing is lost unseen. Each archive is read once to check it and once for its rows, in pieces.
    """
    schema = ", ".join(["path string", "error string", *(f"{c} string" for c in columns)])
    fields = pa.schema([(n, pa.string()) for n in ("path", "error", *columns)])

    def opened(text: io.TextIOWrapper) -> tuple[list[str], Iterator[list[str]]]:
        """Names of the columns and the rows after the header; blank lines are left out."""
        rows = (r for r in csv.reader(text) if r)
        first = next(rows, None)
        if first is None:
            raise ValueError("ARCHIVE_EMPTY")
        if headless and len(first) == len(columns) and first[0].isdigit():
            return list(columns), chain([first], rows)
        return [NEWER.get(n, n) for n in first], rows

    def checked(content: bytes) -> tuple[int, int, int]:
        """Good rows, rows of another length, and which row is the first of those (from 1)."""
        with only_csv(content) as text:
            names, rows = opened(text)
            good = bad = first = 0
            for i, r in enumerate(rows, 1):
                if len(r) == len(names):
                    good += 1
                else:
                    bad, first = bad + 1, first or i
            if not good + bad:
                raise ValueError("ARCHIVE_EMPTY")
            if set(names) != set(columns) or len(names) != len(columns):
                raise ValueError(f"SCHEMA_CHANGED: missing={sorted(set(columns) - set(names))} unexpected={sorted(set(names) - set(columns))}")
            return good, bad, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                try:
                    good, bad, first = checked(content)
                    error = f"ROWS_MALFORMED: {bad} of {good + bad}, the first is row {first}" if bad else None
                    with only_csv(content) as text:
                        names, rows = opened(text)
                        place = [names.index(c) for c in columns]
                        for part in _pieces(r for r in rows if len(r) == len(names)):
                            data = [pa.array([r[i] for r in part], pa.string()) for i in place]
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.nulls(len(part), pa.string()), *data], schema=fields)
                except ValueError as e:
                    error = str(e)
                if error:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": error}], fields)

    return files.select("path", "content").mapInArrow(run, schema)


def moment(ms: Column) -> Column:
    return F.timestamp_millis(ms.try_cast("long")).cast("timestamp_ntz")


def number(text: Column) -> Column:
    """A double, null for blanks and what isn't a number."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def asset_of(path: Column) -> Column:
    """Asset from a path `.../<asset>-<interval>-<period>.zip`."""
    return F.regexp_extract(path, r"([^/]+?)-[^/-]+-[^/]+\.zip$", 1)


def interval_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+?-([^/-]+)-[^/]+\.zip$", 1)


def ohlcv(files: DataFrame, *, ingested_at: str | None = None) -> DataFrame:
    """Canonical bars, available at their close; archives that fail give a row with an error and their path as `path`."""
    r = parse(files, OHLCV, headless=True)
    prices = [number(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")]
    opened, closed = moment(F.col("open_time")), moment(F.col("close_time"))
    return r.select(
        asset_of(F.col("path")).alias("asset"), opened.alias("event_time"), closed.alias("available_time"), F.lit(ingested_at).cast("timestamp_ntz").alias("ingested_at"), F.lit("binance_ohlcv_archive").alias("source"), *prices,
        opened.alias("source_open_time"), closed.alias("source_close_time"), number(F.col("quote_volume")).alias("quote_volume"), F.col("trades").try_cast("long").alias("trades"),
        number(F.col("taker_buy_base")).alias("taker_buy_base"), number(F.col("taker_buy_quote")).alias("taker_buy_quote"), interval_of(F.col("path")).alias("interval"), "path", "error",
    )


def funding(files: DataFrame, *, ingested_at: str | None = None) -> DataFrame:
    """Available when settled; errors as in ohlcv."""
    r = parse(files, FUNDING)
    at = moment(F.col("calc_time"))
    return r.select(
        asset_of(F.col("path")).alias("asset"), at.alias("event_time"), at.alias("available_time"), F.lit(ingested_at).cast("timestamp_ntz").alias("ingested_at"), F.lit("binance_funding_archive").alias("source"),
        F.col("funding_interval_hours").try_cast("int").alias("funding_interval_hours"), number(F.col("last_funding_rate")).alias("funding_rate"), F.col("calc_time").alias("source_timestamp"), "path", "error",
    )


def metrics(files: DataFrame, *, delay_minutes: int = 5, ingested_at: str | None = None) -> DataFrame:
    """Open interest and ratios, available after a publication delay; blanks are null; errors as in ohlcv."""
    r = parse(files, METRICS)
    at = F.try_to_timestamp("create_time", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    values = {
        "sum_open_interest": "sum_open_interest", "sum_open_interest_value": "sum_open_interest_value", "count_toptrader_long_short_ratio": "top_trader_account_long_short_ratio",
        "sum_toptrader_long_short_ratio": "top_trader_position_long_short_ratio", "count_long_short_ratio": "global_account_long_short_ratio", "sum_taker_long_short_vol_ratio": "taker_long_short_volume_ratio",
    }
    return r.select(
        F.col("symbol").alias("asset"), at.alias("event_time"), (at + F.make_dt_interval(mins=F.lit(delay_minutes))).alias("available_time"), F.lit(ingested_at).cast("timestamp_ntz").alias("ingested_at"),
        F.lit("binance_metrics_archive").alias("source"), F.lit(f"BINANCE_METRICS_DELAY_{delay_minutes}M").alias("availability_assumption"), *(number(F.col(c)).alias(n) for c, n in values.items()), F.col("create_time").alias("source_timestamp"), "path", "error",
    )


def daily_returns(files: DataFrame, assets: list[str]) -> DataFrame:
    """Open-to-close return per day, one column per asset; of several rows the last file's wins."""
    r = ohlcv(files).filter("error is null").withColumn("day", F.date_format("event_time", "yyyy-MM-dd")).withColumn("ret", F.try_divide(F.col("close"), F.col("open")) - 1)
    return r.groupBy("day").pivot("asset", assets).agg(F.max_by("ret", F.struct("path", "event_time")))


def integrity(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """path and status: OK, BYTES_MISSING, UNREGISTERED, SIZE_MISMATCH or CHECKSUM_MISMATCH. manifests: path, sha256, bytes."""
    f = files.select("path", F.sha2("content", 256).alias("_sha"), F.col("length").alias("_len"))
    j = f.join(manifests, "path", "full")
    status = F.when(F.col("_sha").isNull(), "BYTES_MISSING").when(F.col("sha256").isNull(), "UNREGISTERED").when(F.col("_len") != F.col("bytes"), "SIZE_MISMATCH").when(F.col("_sha") != F.col("sha256"), "CHECKSUM_MISMATCH").otherwise("OK")
    return j.select("path", status.alias("status"))


def earliest_verified(checked: DataFrame) -> DataFrame:
    """Earliest verified period of each asset, dataset and granularity, its first event and the file that shows it.

    checked: status, asset, dataset, granularity, period, first_event, path.
    """
    best = F.min_by(F.struct("path", "first_event"), F.struct("period", "path"))
    out = checked.filter("status = 'OK'").groupBy("asset", "dataset", "granularity").agg(F.min("period").alias("first_period"), best.alias("b"))
    return out.select("asset", "dataset", "granularity", "first_period", "b.first_event", F.col("b.path").alias("evidence"))


def unverified(verified: DataFrame, required: DataFrame) -> DataFrame:
    """Required (asset, dataset, granularity) of which no archive was verified: what keeps a bootstrap from being complete."""
    return required.select("asset", "dataset", "granularity").distinct().join(verified, ["asset", "dataset", "granularity"], "left_anti")


def pack(lines: DataFrame) -> DataFrame:
    """The inverse of zip_lines for writing: rows path, lines (array, in order) become path, length, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, rows in zip(b["path"], b["lines"], strict=True):
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo(path.rsplit("/", 1)[-1].replace(".zip", ".csv")), "\n".join(rows) + "\n")
                out.append(buf.getvalue())
            yield pd.DataFrame({"path": b["path"], "length": [len(x) for x in out], "content": out})

    return lines.mapInPandas(run, "path string, length long, content binary")
