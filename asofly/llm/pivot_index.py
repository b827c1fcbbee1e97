"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, spread out: of a crowd of alike vectors only one becomes a
pivot, else the nearest pivots of its members would all be in the crowd and differ by chance. Every vector is described by its nearest pivots in order;
each of them has an inverted list, by label and dimension, of the vectors that name it. Vectors that share enough pivots
or the nearest one are candidates, and a candidate pair is verified by its cosine in double precision, once: in the list of the lowest pivot
it shares. Lists are worked through as matrix blocks, long ones split into a grid of cells, and a block gives back per
vector how many links it has and one link towards its component, never the pairs. Equal vectors are one class beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.llm.common import bounded_batches, keep_ids, stash
from asofly.llm.components import connected_components

NEAREST = 8  # pivots that describe a vector
SHARED = 2  # pivots that a candidate pair has in common
PIVOTS = (32, 4096)  # fewest and most; the square root of the number of vectors between
DRAWN = 4  # vectors drawn for each pivot
APART = 0.5  # cosine that no two pivots reach
CELL = 1024  # vectors of a list that are compared in one place


def valid_vector(values: list | None) -> np.ndarray | None:
    """The vector as double precision, or None if it can't link: null, empty, zero, or with null or non-finite parts."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    return x if np.isfinite(x).all() and np.any(x) else None


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)  # else squares of tiny or huge values vanish or overflow
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def describe(x: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Numbers of each unit vector's nearest pivots in order of closeness, ties by number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """The first n unit vectors at most that have a cosine under APART with all that stay before them."""
    kept, m = np.zeros((n, x.shape[1])), 0
    for u in x:
        if m == n:
            break
        if not (kept[:m] @ u >= APART).any():
            kept[m] = u
            m += 1
    return kept[:m]


def candidates(near: list[list[int]], shared: int) -> np.ndarray:
    """Which vectors have enough nearest pivots in common, or the nearest one of all."""
    held = np.zeros((len(near), max(max(p) for p in near) + 1), np.float32)
    for i, p in enumerate(near):
        held[i, p] = 1
    home = np.array([p[0] for p in near])
    return (held @ held.T >= min(shared, min(map(len, near)))) | (home[:, None] == home[None, :])


def _prepare(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 2000):
                b = whole.slice(i, 2000)
                out: list[list] = [[], [], [], [], []]
                for values, label in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    x = valid_vector(values) if label is not None else None
                    row = [None, None, None, None, None]
                    if x is not None:
                        h = xxhash.xxh3_128_intdigest(x.tobytes())
                        u = unit(x)
                        own = describe(u[None], pivots[len(x)])[0].tolist() if len(x) in pivots else [0]
                        row = [len(x), h >> 65, h & ((1 << 63) - 1), own, u.tobytes()]
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["row", "vec_id", "label", "dim", "h1", "h2", "near", "unit"])

    return run


def block_links(x: np.ndarray, near: list[list[int]], pivot: int, group: np.ndarray | None, threshold: float, shared: int) -> np.ndarray:
    """Links of a block as a boolean matrix: pairs whose lowest shared pivot is this one, that are candidates and are close.

    group: only pairs of different groups count, if given.
    """
    width = max(max(p) for p in near) + 1
    held = np.zeros((len(near), width), np.float32)
    for i, p in enumerate(near):
        held[i, p] = 1
    enough = candidates(near, shared)
    enough &= held[:, :pivot] @ held[:, :pivot].T == 0
    if group is not None:
        enough &= group[:, None] != group[None, :]
    np.fill_diagonal(enough, False)
    return enough & (x @ x.T >= threshold) if enough.any() else enough


def _links(threshold: float, shared: int):
    """Of rows sorted by list and cell: partial link counts and a link to the smallest vector of the block's component."""

    def block(key: tuple, rows: list[tuple]) -> list[tuple[int, int, int]]:
        ids = np.array([r[0] for r in rows])
        weight = np.array([r[1] for r in rows])
        x = np.frombuffer(b"".join(r[4] for r in rows), np.float64).reshape(len(rows), -1)
        link = block_links(x, [r[3] for r in rows], key[2], np.array([r[2] for r in rows]) if key[4] else None, threshold, shared)
        hit = np.flatnonzero(link.any(axis=1))
        root = ids.copy()
        while len(hit):  # labels sink to the smallest id of each component
            low = np.where(link[hit], root[None, :], np.iinfo(np.int64).max).min(axis=1)
            low = np.minimum(low, root[hit])
            if (low == root[hit]).all():
                break
            root[hit] = low
        return [(int(ids[i]), int(link[i] @ weight), int(root[i])) for i in hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for b in batches:
            for *key, rep, m, own, near, unit_ in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True):
                if tuple(key) != now:
                    if len(rows) > 1:
                        out += block(now, rows)
                    now, rows = tuple(key), []
                rows.append((rep, m, own, near, unit_))
            if len(out) > 20_000:
                yield made(out)
                out = []
        if len(rows) > 1:
            out += block(now, rows)
        yield made(out)

    def made(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "n", "root"])

    return run


def choose_pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """n unit vectors at most, by dimension: spread out among those whose ids hash lowest. A dimension without any has one list for all."""
    rows = vectors.filter("embedding is not null and label is not null").orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(DRAWN * n).collect()
    found: dict[int, list] = {}
    for r in rows:  # DRAWN * PIVOTS[1] rows at most
        x = valid_vector(r["embedding"])
        if x is not None:
            found.setdefault(len(x), []).append(unit(x))
    return {d: spread(np.array(v), n) for d, v in found.items()}


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.93, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; only vectors of one label and dimension link.

    n_links counts the other rows linked directly, component_id is the smallest vec_id reachable; kept: it's that one. Every
    row is a node: rows that repeat a vector link with each other, whatever their ids. Labels of any type need only be equal.
    Vectors that are null, empty, zero, or have null or non-finite parts, and those without a label, link with nothing. Null
    ids link like others; a component without any id has a null component_id. An empty table gives an empty result, other
    columns are ignored.
    """
    source = bounded_batches(vectors).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    count = source.count()
    pivots = choose_pivots(source, int(min(max(count**0.5, PIVOTS[0]), PIVOTS[1])))
    # Rows are numbered once, as they are written: ids may be missing or repeated.
    numbered = source.select(F.monotonically_increasing_id().alias("row"), "*")
    rows = stash(numbered.mapInArrow(_prepare(pivots), "row long, vec_id long, label string, dim int, h1 long, h2 long, near array<int>, unit binary"), "vectors")
    same = ["label", "dim", "h1", "h2"]
    classes = stash(rows.filter("dim is not null").groupBy(*same).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("low")), "classes")
    reps = keep_ids(rows.filter("dim is not null").withColumnRenamed("row", "rep"), classes.select("rep"), "rep").join(classes.select("rep", "m"), "rep")
    listed = reps.select("label", "dim", F.explode("near").alias("pivot"), "rep", "m", "near", "unit")
    sizes = reps.select("label", "dim", F.explode("near").alias("pivot")).groupBy("label", "dim", "pivot").count()
    sizes = sizes.select("label", "dim", "pivot", F.ceil(F.col("count") / CELL).cast("int").alias("g"))
    cells = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct((F.least("own", j) * F.col("g") + F.greatest("own", j)).alias("at"), (F.col("own") != j).alias("cross")))
    grid = listed.join(sizes, ["label", "dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("rep"), "g").cast("int"))
    grid = grid.select("label", "dim", "pivot", F.explode(cells).alias("cell"), "rep", "m", "own", "near", "unit")
    grid = grid.select("label", "dim", "pivot", "cell.at", "cell.cross", "rep", "m", "own", "near", "unit")
    key = ["label", "dim", "pivot", "at", "cross"]
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stash(grid.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_links(threshold, shared), "rep long, n long, root long"), "links")
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "component")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.join(counts, "rep", "left").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("low").alias("least"))
    named = named.join(least, "component").select(*same, (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "least", F.lit(True).alias("known"))
    out = rows.select("vec_id", *same).join(named, same, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("known"), F.col("least")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
