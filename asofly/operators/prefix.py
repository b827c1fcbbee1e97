"""Statistics of growing prefixes: one value of each block from all blocks up to it, without sending rows to later blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofly.plans.shared import stash

BUCKETS = 256  # ranges of values of a key and column at most
STEP = 16  # edges of ranges that are looked through at once
RANGE = 4096  # values of a range, while there are fewer ranges than that


def prefix_sums(frame: DataFrame, last: DataFrame, sums: list[str], *, key: str, block: str = "block") -> DataFrame:
    """Running sums by block of rows (key, block, ...): one row for each key and block from 0 to the key's last.

    last: key, last. The partial sums of a block are added up first, so what moves is at most the blocks.
    """
    own = frame.groupBy(key, block).agg(*(F.sum(c).alias(c) for c in sums))
    grid = last.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias(block))
    run = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(own.withColumn(block, F.col(block).cast("long")), [key, block], "left")
    return full.select(key, block, *(F.coalesce(F.sum(c).over(run), F.lit(0)).alias(c) for c in sums))


def _select(value: np.ndarray, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each query (a rank, from 0) the value of that rank among the values before it; rows without a rank are values.

    A Fenwick tree over the sorted distinct values: values come in one by one, queries descend the tree.
    """
    asks = ~np.isnan(rank)
    known = np.unique(value[~asks])
    size = 1 << max(len(known) - 1, 0).bit_length()
    tree, out = [0] * (size + 1), np.full(len(rank), np.nan)
    places, counts, ranks = (np.searchsorted(known, value) + 1).tolist(), n.tolist(), rank.tolist()
    for r, ask in enumerate(asks.tolist()):
        if not ask:
            i = places[r]
            while i <= size:
                tree[i] += int(counts[r])
                i += i & -i
        else:
            left, at, step = int(ranks[r]), 0, size
            while step:
                if at + step <= size and tree[at + step] <= left:
                    at += step
                    left -= tree[at]
                step >>= 1
            out[r] = known[at]
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order (key, name, block, value, n, rank, lower, share, first) to the answered queries."""

    def answered(table: pa.Table) -> pa.RecordBatch:
        number = lambda c: table.column(c).to_numpy().astype(float)
        value, n, rank = number("value"), number("n"), number("rank")
        starts = np.flatnonzero(table.column("first").to_numpy())
        for lo, hi in zip(starts, [*starts[1:], table.num_rows], strict=True):
            value[lo:hi] = np.where(np.isnan(rank[lo:hi]), value[lo:hi], _select(value[lo:hi], n[lo:hi], rank[lo:hi]))
        out = table.set_column(table.schema.get_field_index("value"), "value", pa.array(value)).filter(pa.array(~np.isnan(rank)))
        return out.select(["key", "name", "block", "value", "lower", "share"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        starts = np.flatnonzero(b.column(b.schema.get_field_index("first")).to_numpy(zero_copy_only=False))
        if not len(starts):
            held.append(b)
            continue
        done = pa.Table.from_batches([*held, b.slice(0, starts[-1])])
        held = [b.slice(starts[-1])]
        if done.num_rows:
            yield from answered(done).to_batches()
    if held:
        yield from answered(pa.Table.from_batches(held)).to_batches()


def prefix_quantiles(frame: DataFrame, last: DataFrame, quantiles: dict[str, float], *, key: str, prefix: str, buckets: int = BUCKETS, rows: int = RANGE) -> DataFrame:
    """Exact, linearly interpolated quantiles of each column over all rows of a key whose block is at most b, for each b.

    frame: key, block (the first block that counts the row), the columns; last: key, last (blocks 0 to last are given).
    Null and NaN values don't count; a block without values has null.

    Values are counted by block and dealt into ranges. Counts by range and block are merged over the blocks, which tells
    the range that holds the two ranks a quantile lies between; each range then finds its own. So every row moves a fixed
    number of times, however many blocks it serves.
    """
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in quantiles))).alias("s")
    ends = last.select(F.struct(key).alias("k"), F.col("last").cast("long").alias("last"))
    long = frame.withColumn("k", F.struct(key)).join(ends, "k").filter(F.col("block") <= F.col("last")).select("k", F.col("block").cast("long").alias("block"), stacked)
    long = long.select("k", "s.name", "block", "s.value").filter("value is not null and not isnan(value)")
    counts = stash(long.groupBy("k", "name", "value", "block").agg(F.count(F.lit(1)).alias("n")), "counts")  # read several times
    edges = counts.groupBy("k", "name").agg(F.percentile_approx("value", [i / buckets for i in range(1, buckets)]).alias("edges"), F.least(F.ceil(F.count(F.lit(1)) / rows), F.lit(buckets)).alias("ranges"))
    under = lambda some: F.size(F.filter(some, lambda e: e < F.col("value")))
    edges = edges.withColumn("coarse", F.filter("edges", lambda e, i: i % STEP == STEP - 1))  # every STEP-th edge, then the few between two of them
    counts = counts.join(edges, ["k", "name"]).withColumn("at", F.when(F.col("ranges") > 1, under("coarse") * STEP).otherwise(0))
    below = F.when(F.col("ranges") > 1, F.col("at") + under(F.slice("edges", F.col("at") + 1, STEP - 1))).otherwise(0)
    counts = stash(counts.withColumn("bucket", F.floor(below * F.col("ranges") / buckets).cast("int")).drop("edges", "ranges", "coarse", "at"), "ranges")

    grid = last.select(F.struct(key).alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("block"))
    parts = counts.groupBy("k", "name", "bucket", "block").agg(F.sum("n").alias("n"))
    held = parts.select("k", "name", "bucket").distinct()
    run = Window.partitionBy("k", "name", "bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    merged = held.join(grid, "k").join(parts, ["k", "name", "bucket", "block"], "left").withColumn("n", F.coalesce(F.sum("n").over(run), F.lit(0)))
    merged = merged.groupBy("k", "name", "block").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("held"), F.sum("n").alias("total")).filter("total > 0")

    q = F.element_at(F.create_map(*(x for c, v in quantiles.items() for x in (F.lit(c), F.lit(v)))), F.col("name"))
    place = (F.col("total") - 1) * q
    key_type = frame.schema[key].dataType
    asked = merged.withColumn("share", place - F.floor(place)).withColumn("low", F.floor(place)).withColumn("wanted", F.array_distinct(F.array(F.floor(place), F.ceil(place))))
    asked = asked.select("k", "name", "block", "share", "low", "held", F.explode("wanted").alias("want"))
    start = F.struct(F.lit(-1).alias("bucket"), F.col("want").cast("long").alias("left"), F.lit(False).alias("found"))
    found = F.aggregate("held", start, lambda acc, h: F.when(acc["found"], acc).otherwise(F.when(acc["left"] < h["n"], F.struct(h["bucket"].alias("bucket"), acc["left"].alias("left"), F.lit(True).alias("found"))).otherwise(F.struct(acc["bucket"].alias("bucket"), (acc["left"] - h["n"]).alias("left"), F.lit(False).alias("found")))))
    asked = asked.withColumn("f", found)
    queries = asked.select("k", "name", "f.bucket", "block", F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("n"), F.col("f.left").cast("double").alias("rank"), (F.col("want") == F.col("low")).alias("lower"), "share")
    values = counts.select("k", "name", "bucket", "block", "value", "n", F.lit(None).cast("double").alias("rank"), F.lit(None).cast("boolean").alias("lower"), F.lit(None).cast("double").alias("share"))
    both = values.unionByName(queries)
    first = F.row_number().over(Window.partitionBy("k", "name", "bucket").orderBy("block", F.col("rank").isNotNull())) == 1  # at one block, values come before queries
    both = both.withColumn("first", first).select(F.col(f"k.{key}").alias("key"), "name", "block", "value", "n", "rank", "lower", "share", "first")
    fields = [(key_type, "key"), (T.StringType(), "name"), (T.LongType(), "block"), (T.DoubleType(), "value"), (T.BooleanType(), "lower"), (T.DoubleType(), "share")]
    solved = both.mapInArrow(_solve, T.StructType([T.StructField(n, t) for t, n in fields]))
    by_block = solved.groupBy(F.struct(F.col("key").alias(key)).alias("k"), "block", "name").agg(F.max(F.when(F.col("lower"), F.col("value"))).alias("low"), F.max(F.when(~F.col("lower"), F.col("value"))).alias("high"), F.max("share").alias("share"))
    value = F.when(F.col("high").isNull(), F.col("low")).otherwise((1 - F.col("share")) * F.col("low") + F.col("share") * F.col("high"))
    wide = by_block.groupBy("k", "block").agg(*(F.max(F.when(F.col("name") == c, value)).alias(f"{prefix}{c}") for c in quantiles))
    return grid.join(wide, ["k", "block"], "left").select(F.col(f"k.{key}").alias(key), "block", *(f"{prefix}{c}" for c in quantiles))
