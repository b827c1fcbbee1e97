"""Content-addressed publishing of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.operators.quality import inspect_ohlcv

HALF = "decimal(38,0)"


def row_digest(columns: list[str]):
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def fingerprint(frame: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A digest of the rows as a multiset: order and partitioning don't matter, repeated rows do.

    Each row's sha256 gives two numbers, and their sums with the row count are hashed. (An XOR would lose rows that occur
    twice.) Groups by `by`, or one row for the whole frame.
    """
    d = frame.select(*(by or []), row_digest(frame.columns).alias("_d"))
    part = lambda i: F.sum(F.conv(F.substring("_d", i, 15), 16, 10).cast(HALF))
    out = d.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("row_count"), part(1).alias("_a"), part(16).alias("_b"))
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("|", "row_count", F.coalesce("_a", F.lit(0).cast(HALF)), F.coalesce("_b", F.lit(0).cast(HALF))), 256)).drop("_a", "_b")


def write_gated(frame: DataFrame, path: str, *, step_hours: int) -> None:
    """Write bars as Zstandard Parquet unless a blocking finding stands against them."""
    blocking = inspect_ohlcv(frame, step_hours=step_hours).filter("code <> 'TIME_GAP'").groupBy("code").count().collect()  # a row a code
    if blocking:
        raise ValueError("QUALITY_BLOCKED: " + ", ".join(sorted(r["code"] for r in blocking)))
    frame.write.option("compression", "zstd").parquet(path)


def write_new_partitions(frame: DataFrame, path: str, key: str, known: DataFrame | None = None) -> DataFrame:
    """Append the partitions that aren't known yet; the same content again is a no-op, other content is an error.

    known: key and fingerprint of what's there; a null key is a partition like others. Returns the fingerprints after the write.
    """
    now = fingerprint(frame, [key]).select(key, "fingerprint")
    if known is not None:
        old = known.select(F.col(key).alias("_k"), F.col("fingerprint").alias("_f"))
        there = F.col(key).eqNullSafe(F.col("_k"))
        clash = now.join(old, there).filter("fingerprint <> _f").limit(1).count()
        if clash:
            raise ValueError("PARTITION_CONTENT_CHANGED")
        fresh = now.join(old, there, "left_anti")
        frame = frame.join(old, there, "left_anti")
        now = known.select(key, "fingerprint").unionByName(fresh)
    frame.write.mode("append").partitionBy(key).option("compression", "zstd").parquet(path)
    return now


def manifest(frame: DataFrame, name: str, layer: str, parents: list[str] | None = None) -> DataFrame:
    """One row: id (name and digest), layer, rows, and the span of both times."""
    f = fingerprint(frame).crossJoin(frame.agg(*(g(c).alias(f"{n}_{c}") for c in ("event_time", "available_time") for g, n in ((F.min, "min"), (F.max, "max")))))  # one row each
    return f.select(F.concat(F.lit(name + "-"), F.substring("fingerprint", 1, 16)).alias("snapshot_id"), F.lit(layer).alias("layer"), F.lit(name).alias("name"), "row_count", "fingerprint", "min_event_time", "max_event_time", "min_available_time", "max_available_time", F.array(*(F.lit(p) for p in parents or [])).cast("array<string>").alias("parents"))


def register(catalog: DataFrame | None, entry: DataFrame) -> DataFrame:
    """The catalog with an entry appended; the same entry again is a no-op, the same id with other content an error."""
    if catalog is None:
        return entry
    both = catalog.select("snapshot_id", F.col("fingerprint").alias("_f")).join(entry, "snapshot_id")
    if both.filter("_f <> fingerprint").limit(1).count():
        raise ValueError("MANIFEST_CONFLICT")
    return catalog.unionByName(entry.join(catalog.select("snapshot_id"), "snapshot_id", "left_anti").select(*catalog.columns))
