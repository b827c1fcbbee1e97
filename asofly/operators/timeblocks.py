"""Windows over long histories, cut into blocks: no task sorts all rows of one key.

Running values (`running`, `numbered`) are scans: each block of time is summed up by itself, the blocks' ends are carried
over the few blocks of a key, and every row takes its block's carry. Bounded frames (`in_blocks`) run over chunks of so many
consecutive rows, each with copies of the rows before and after that a frame can reach.

Keys of a few rows gain nothing by that: where their sizes are known, `by_length` computes the keys that fit into a chunk by
plain windows and only the others in blocks.

A frame that several of these steps work on is numbered once: `numbered(frame, POS)` leaves the positions in a column that
all of them take, as long as no row is dropped or added in between; drop it at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofly.plans.shared import stash

DAYS = 30  # of a key's history that one task sorts
POS = "_pos"  # positions that later steps take
ROWS = 4096  # consecutive rows of a key in a chunk, at least as many as a frame reaches

_KINDS = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}


def _keyed(frame: DataFrame, by: Sequence[str], order: str, days: float) -> DataFrame:
    """Rows with `_b`: the key and the block of time. A struct, so that null keys and times are equal to each other."""
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    return frame.withColumn("_b", F.struct(key.alias("key"), F.floor(F.unix_timestamp(F.col(order).cast("timestamp")) / (days * 86400)).alias("k")))


def running(frame: DataFrame, columns: dict[str, tuple[str, Column]], *, by: Sequence[str] = ("asset",), order: Sequence[str] = ("event_time",), days: float | None = None) -> DataFrame:
    """The frame with running sums, maxima, minima or last values (nulls left out) of a key's rows up to each row.

    columns: name to (kind, expression of the row). order: a time first, by which blocks are cut. Null times come first.
    """
    out = _keyed(frame, by, order[0], days or DAYS).withColumns({f"_v_{n}": c for n, (_, c) in columns.items()})
    at = F.struct(*order)
    ends = {n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)) if kind == "last" else _KINDS[kind](f"_v_{n}") for n, (kind, _) in columns.items()}
    ends = out.groupBy("_b").agg(*(c.alias(f"_e_{n}") for n, c in ends.items()))  # a row for each block
    before = Window.partitionBy("_b.key").orderBy("_b.k").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_b", *(_KINDS[kind](f"_e_{n}").over(before).alias(f"_c_{n}") for n, (kind, _) in columns.items()))
    inside = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"_v_{n}": _KINDS[kind](f"_v_{n}").over(inside) for n, (kind, _) in columns.items()}).join(ends, "_b")

    def merged(n: str, kind: str) -> Column:
        own, carried = F.col(f"_v_{n}"), F.col(f"_c_{n}")
        if kind == "last":
            return F.coalesce(own, carried)
        if kind == "sum":
            return F.coalesce(own + carried, own, carried)
        return (F.greatest if kind == "max" else F.least)(own, carried)

    return out.withColumns({n: merged(n, kind) for n, (kind, _) in columns.items()}).drop("_b", *(f"_{x}_{n}" for x in "vc" for n in columns))


def numbered(frame: DataFrame, name: str = "pos", *, by: Sequence[str] = ("asset",), order: Sequence[str] = ("event_time",), days: int | None = None) -> DataFrame:
    """The frame with each row's position among its key's rows, from 0."""
    if POS in frame.columns:
        return frame.withColumn(name, F.col(POS))
    return running(frame, {name: ("sum", F.lit(1).cast("long"))}, by=by, order=order, days=days).withColumn(name, F.col(name) - 1)


def by_length(frame: DataFrame, sizes: DataFrame | None, short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame], *, by: str = "asset", rows: int | None = None) -> DataFrame:
    """short(rows of keys that fit into a chunk) and long(rows of the others), which give the same columns.

    sizes: the key and n, at least as many as its rows; a key that's not in it is a short one. Without sizes all are long.
    """
    if sizes is None:
        return long(frame)
    large = stash(sizes.filter(F.col("n") > (rows or ROWS)).select(F.col(by).alias("_large")), "large")
    if large.isEmpty():
        return short(frame)
    same = F.col(by).eqNullSafe(F.col("_large"))
    return short(frame.join(large, same, "left_anti")).unionByName(long(frame.join(large, same, "left_semi")))


def in_blocks(frame: DataFrame, compute: Callable[[DataFrame], DataFrame], *, before: int = 0, after: int = 0, by: str = "asset", order: str = "event_time", rows: int | None = None, days: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """compute(frame), whose windows within `by` reach at most so many rows back and ahead, chunk by chunk.

    Within compute the column `by` holds the key and the chunk, so that windows over it see a chunk and the rows copied to
    it. It adds columns (windows over anything else would see the copies, and belong outside). sizes: see by_length.
    """
    size = max(rows or ROWS, before, after)
    if sizes is not None:
        return by_length(frame, sizes, compute, lambda f: in_blocks(f, compute, before=before, after=after, by=by, order=order, rows=rows, days=days), by=by, rows=size)
    out = numbered(frame, "_at", by=[by], order=[order], days=days)
    chunk, place = F.floor(F.col("_at") / size), F.col("_at") % size
    to = [F.struct(chunk.alias("chunk"), F.lit(True).alias("own"))]
    to += [F.when(place >= size - before, F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own")))] if before else []
    to += [F.when((place < after) & (chunk > 0), F.struct((chunk - 1).alias("chunk"), F.lit(False).alias("own")))] if after else []
    out = out.withColumn("_to", F.explode(F.array_compact(F.array(*to))))
    out = out.withColumn("_own", F.col("_to.own")).withColumn(by, F.struct(F.col(by).alias("key"), F.col("_to.chunk").alias("chunk"))).drop("_at", "_to")
    return compute(out).filter("_own").withColumn(by, F.col(f"{by}.key")).drop("_own")


def with_drawdown(frame: DataFrame, equity: str, name: str, **keys) -> DataFrame:
    """equity over its running peak, less one."""
    out = running(frame, {"_peak": ("max", F.col(equity))}, **keys)
    return out.withColumn(name, F.try_divide(F.col(equity), F.col("_peak")) - 1).drop("_peak")


def with_compounded(frame: DataFrame, returns: dict[str, str], initial: float = 1.0, **keys) -> DataFrame:
    """initial times the running product of 1 + r, for each name and return; null from the first r <= -1 on."""
    parts = {}
    for name, r in returns.items():
        parts[f"_ruin_{name}"] = ("max", F.when(F.col(r) <= -1, 1).otherwise(0))
        parts[f"_log_{name}"] = ("sum", F.when(F.col(r) > -1, F.log1p(F.col(r))))
    out = running(frame, parts, **keys)
    return out.withColumns({name: F.when(F.col(f"_ruin_{name}") == 0, initial * F.exp(f"_log_{name}")) for name in returns}).drop(*parts)


def with_episodes(frame: DataFrame, label: str, name: str, *, by: str = "asset", order: str = "event_time") -> DataFrame:
    """Number of the run of equal labels that a row lies in, from 1."""
    w = Window.partitionBy(by).orderBy(order)
    was = F.lag(label, 1).over(w)
    out = in_blocks(frame, lambda f: f.withColumn("_new", F.when(was.isNull() | (was != F.col(label)), 1).otherwise(0)), before=1, by=by, order=order)
    return running(out, {name: ("sum", F.col("_new"))}, by=[by], order=[order]).drop("_new")
