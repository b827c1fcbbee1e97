"""Block bootstraps of slices: every draw is a set of multiplicities over one copy of a slice's rows.

Where a draw's blocks start, and to where they jump, is told by a hash of slice, draw and position, so results don't depend
on the partitioning. A slice of at most SLICE rows goes to one task once, encoded as arrays, and all draws are counted there;
a larger one is drawn as rows (`*_rows`), which gives the same figures.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofly.functions.factors import average_rank, corr
from asofly.plans.shared import stash

SLICE = 4_000_000  # rows of a slice that one task takes as arrays: some 200 MB with what's computed from them

#: The primes of the 64-bit xxHash.
PRIMES = tuple(map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * PRIMES[1]
    h = (h ^ (h >> np.uint64(29))) * PRIMES[2]
    return h ^ (h >> np.uint64(32))


def hash_int(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxhash64 of a 32-bit integer, chained to the hash of what comes before it, as Spark's function has it."""
    h = (seed + PRIMES[4] + np.uint64(4)) ^ (x.astype(np.uint64) * PRIMES[0])
    return _mixed(_turned(h, 23) * PRIMES[1] + PRIMES[2])


def hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The same of a 64-bit integer."""
    h = (seed + PRIMES[4] + np.uint64(8)) ^ (_turned(x.astype(np.uint64) * PRIMES[1], 31) * PRIMES[0])
    return _mixed(_turned(h, 27) * PRIMES[0] + PRIMES[3])


def _unit(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << 52) - 1)).astype(float) / float(1 << 52)


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on its parts only, not on the partitioning."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def stationary_picks(n: int, draw: int, starts: int, targets: int, mean_block: float) -> np.ndarray:
    """Positions that a draw takes: at each position a new block starts with probability 1/mean_block, or the last goes on."""
    pos, one = np.arange(n), np.array([draw])
    fresh = _unit(hash_int(pos, hash_int(one, np.array([starts], np.uint64)))) < 1 / mean_block
    fresh[0] = True
    to = np.floor(_unit(hash_int(pos, hash_int(one, np.array([targets], np.uint64)))) * n).astype(np.int64)
    at = np.maximum.accumulate(np.where(fresh, pos, 0))
    return (to[at] + pos - at) % n


def circular_picks(n: int, draw: int, starts: int, block: int) -> np.ndarray:
    """Positions that a draw takes: blocks of fixed length, each from a place of its own, around the end."""
    pos = np.arange(n)
    start = np.floor(_unit(hash_long(pos // block, hash_int(np.array([draw]), np.array([starts], np.uint64)))) * n).astype(np.int64)
    return (start + pos % block) % n


def weighted_rank_correlation(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> float:
    """Spearman correlation of rows that count so many times each; x, y: numbers of their distinct values, from 0 in order.

    The rank of a value is that of the middle of its copies, so counts of the distinct values are all it takes.
    """

    def off_mean(code: np.ndarray) -> np.ndarray:
        n = np.bincount(code, times)
        upto = np.cumsum(n)
        return (upto - (n - 1) / 2 - (upto[-1] + 1) / 2)[code]

    a, b = off_mean(x), off_mean(y)
    spread = (times * a * a).sum() * (times * b * b).sum()
    return float((times * a * b).sum() / np.sqrt(spread)) if spread > 0 else float("nan")


def _bounds(values: np.ndarray) -> list:
    values = values[~np.isnan(values)]
    low, high = np.percentile(values, [2.5, 97.5]) if len(values) else (None, None)
    return [low, high, len(values)]


def _by_slice(frame: DataFrame, by: str, columns: list[str], seeds: list[int], measure: Callable, rows: Callable[[DataFrame], DataFrame], count: str, limit: int) -> DataFrame:
    """Bounds of each slice: measure(arrays in order of time, hashes of the seeds and the slice) where it's small enough."""
    hashes = [F.xxhash64(F.lit(s), by).alias(f"_h{i}") for i, s in enumerate(seeds)]
    known = stash(frame.select(by, "event_time", *columns), "slices")
    sizes = known.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(by)
    schema = T.StructType([frame.schema[by], T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField(count, T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("event_time")
        arrays = [table.column(c).to_numpy() for c in columns]
        values = measure(*arrays, *(int(np.uint64(table.column(f"_h{i}")[0].as_py() & (2**64 - 1))) for i in range(len(seeds))))
        return pa.table([table.column(by).slice(0, 1).combine_chunks(), *(pa.array([v], t) for v, t in zip(_bounds(values), (pa.float64(), pa.float64(), pa.int64()), strict=True))], schema.names)

    large = sizes.limit(1).count() > 0
    small = known.join(sizes, by, "left_anti") if large else known
    out = small.select("*", *hashes).groupBy(by).applyInArrow(run, schema)
    return out.unionByName(rows(known.join(sizes, by, "left_semi"))) if large else out


def stationary_bootstrap(frame: DataFrame, x: str, y: str, *, draws: int = 500, mean_block: int = 5, seed: int = 42, by: str = "asset", limit: int = SLICE) -> DataFrame:
    """2.5 and 97.5 % bounds of the rank correlation of each slice under the stationary block bootstrap; draws that have one.

    Rows without x or y don't count. A position starts a new block with probability 1/mean_block (where, and to what, by a
    hash), goes on from the position before otherwise, and wraps around.
    """
    ok = frame.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def measure(xs: np.ndarray, ys: np.ndarray, starts: int, targets: int) -> np.ndarray:
        a, b = (np.unique(v, return_inverse=True)[1] for v in (xs, ys))
        n = len(a)
        return np.array([weighted_rank_correlation(a, b, np.bincount(stationary_picks(n, d, starts, targets, mean_block), minlength=n).astype(float)) for d in range(draws)])

    return _by_slice(ok, by, [x, y], [seed, seed + 1], measure, lambda f: stationary_rows(f, x, y, draws=draws, mean_block=mean_block, seed=seed, by=by), "draws", limit)


def stationary_rows(ok: DataFrame, x: str, y: str, *, draws: int, mean_block: int, seed: int, by: str) -> DataFrame:
    """stationary_bootstrap with draws and positions as rows: values are joined by position and ranked draw by draw."""
    pos = ok.select(by, x, y, (F.row_number().over(Window.partitionBy(by).orderBy("event_time")) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("n"))
    plan = pos.select(by, "n", "pos", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    fresh = (F.col("pos") == 0) | (uniform(F.lit(seed), by, "draw", "pos") < 1 / mean_block)
    run = Window.partitionBy(by, "draw").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    to = F.floor(uniform(F.lit(seed + 1), by, "draw", "pos") * F.col("n"))
    start = F.last(F.when(fresh, F.struct(F.col("pos").alias("at"), to.alias("to"))), ignorenulls=True).over(run)
    plan = plan.withColumn("_s", start).withColumn("pick", F.pmod(F.col("_s.to") + F.col("pos") - F.col("_s.at"), F.col("n")))
    drawn = plan.select(by, "draw", F.col("pick").alias("pos")).join(pos.select(by, "pos", x, y), [by, "pos"])
    r = drawn.withColumn("_rx", average_rank(x, [by, "draw"])).withColumn("_ry", average_rank(y, [by, "draw"]))
    ic = r.groupBy(by, "draw").agg(corr("_rx", "_ry").alias("ic"))
    return ic.groupBy(by).agg(F.percentile("ic", F.lit(0.025)).alias("low"), F.percentile("ic", F.lit(0.975)).alias("high"), F.count("ic").alias("draws"))


def circular_bootstrap(frame: DataFrame, value: str, statistic: Callable[[np.ndarray], float], *, column: Callable[[str], Column] | None = None, block: int, samples: int, seed: int = 42, by: str = "asset", limit: int = SLICE) -> DataFrame:
    """Bounds of any statistic of each slice's values under fixed-length circular blocks.

    statistic: of an array of drawn values. column: the same as an aggregate expression, which slices of more than `limit`
    rows need; without it they are refused.
    """
    ok = frame.filter(F.col(value).isNotNull())

    def measure(values: np.ndarray, starts: int) -> np.ndarray:
        return np.array([float(statistic(values[circular_picks(len(values), d, starts, block)])) for d in range(samples)])

    def rows(large: DataFrame) -> DataFrame:
        if column is None:
            raise ValueError(f"a slice has more than {limit} rows: give the statistic as an aggregate expression too")
        return circular_rows(large, value, column, block=block, samples=samples, seed=seed, by=by)

    return _by_slice(ok, by, [value], [seed], measure, rows, "samples", limit)


def circular_rows(ok: DataFrame, value: str, column: Callable[[str], Column], *, block: int, samples: int, seed: int, by: str) -> DataFrame:
    """circular_bootstrap with samples and positions as rows."""
    pos = ok.select(by, value, (F.row_number().over(Window.partitionBy(by).orderBy("event_time")) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("n"))
    plan = pos.select(by, "n", "pos", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("draw"))
    start = F.floor(uniform(F.lit(seed), by, "draw", F.floor(F.col("pos") / block)) * F.col("n"))
    drawn = plan.select(by, "draw", F.pmod(start + F.col("pos") % block, F.col("n")).alias("pos")).join(pos.select(by, "pos", value), [by, "pos"])
    stat = drawn.groupBy(by, "draw").agg(column(value).alias("s"))
    return stat.groupBy(by).agg(F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"), F.count("s").alias("samples"))
