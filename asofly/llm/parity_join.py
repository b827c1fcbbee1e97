"""Jaccard self-join of word n-gram sets by parity sketches.

A set's sketch flips one bit per element, so bits where two sketches differ number at most the symmetric difference of
the sets. That difference is bounded for sets that link, by a size band's largest D. The sketch's (conceptually 2^64) bits
are cut into m blocks, m > D, so linked sets agree in m - D whole blocks at least. A block is kept as the XOR of its flipped
positions scrambled, which is the same for equal parity bits. Band borders overlap so that every pair shares a band.

Linked sets agree in many blocks, so all but D + 1 blocks of every set may be left out, if all sets agree on the order in
which they leave them out: the first block in that order that two linked sets have in common is among the D + 1 that both
keep. The order is by how many sets hold a block, the most frequent ones (passages that many documents share, blocks of few
elements) go first. A set that is alone with more than D of its blocks can't link to any other set, and is done.

Sets that keep a block together are candidates. A folded sketch (twice as many bits as elements, or more) rejects most that
can't link, and what remains is verified on the exact sets. Equal sets are one class from the start, and within a block a
set that comes near an earlier one is tested against that one only; sets of one block that end in different components
are then tested against each other, so no link between components is lost while no group is expanded into all its pairs.
Near sets share many blocks: a pair is named by the first of them only (of two in a lower block, each set's FIRST lowest are
looked at, so a pair that shares none of these may be named again). Blocks that many sets share are split into cells of a grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofly.llm.common import BROADCAST_ROWS, bounded_batches, keep_ids, lean, stash
from asofly.llm.components import connected_components
from asofly.llm.words import WordHasher, mix, shingle_set

RATIO = 1.5  # of one size band's lower end to the one below
CELL = 2048  # sets of a block that are compared in one place
FIRST = 16  # lowest blocks of a set that go with it
SLICE = 500  # documents handled at once
FLUSH = 20_000  # pairs held by a task before they are handed on
LONGEST_RUN = 1 << 18  # sets that hold a block, counted no further


class Bands:
    """Size bands for a threshold num/den: how many blocks the sets of a size are cut into."""

    def __init__(self, num: int, den: int):
        self.t = Fraction(num, den)
        self.lows, self.blocks, self.agree = [], [], []
        low = 1
        while low < 1 << 40:
            high = max(low + 1, int(low * RATIO))  # the smaller set of a pair has low <= size < high
            least = self.most(high - 1) + 1
            m = least if least == 1 else int(least * (1.25 if self.t < Fraction(5, 6) else 1.15)) + 1
            self.lows.append(low)
            self.blocks.append(m)
            self.agree.append(m - least + 1)  # blocks in which linked sets agree, at least
            low = high

    def most(self, smaller: int) -> int:
        """Largest symmetric difference of linked sets whose smaller one has so many elements."""
        return int((1 - self.t) * smaller / self.t)

    def of(self, n: int) -> list[int]:
        """Bands in which a set of n elements takes part: its own, and those below of sets that may link to it."""
        own = int(np.searchsorted(self.lows, n, side="right")) - 1
        out = [own]
        while own > 0 and self.lows[own] - 1 >= self.t * n:
            own -= 1
            out.append(own)
        return out


def block_keys(elements: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[int], list[int]]:
    """Keys of a sorted set's parity blocks in all its bands; the bands; and how many blocks of each the set may leave out.

    The lowest byte of a key is its band and whether the block is empty. Empty blocks come last in the order, so a set that
    has fewer than linked sets agree in doesn't name them. Sets of a band with one block link only if equal: no keys.
    """
    keys, named, spare, value = [], [], [], mix(elements)
    for band in bands.of(len(elements)):
        m = bands.blocks[band]
        if m < 2:
            continue
        at = (((elements >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)  # by the bit's place, so in order
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        content = np.zeros(m, np.uint64)
        content[at[first]] = np.bitwise_xor.reduceat(value, first)
        full = np.zeros(m, bool)
        full[at[first]] = True
        use = at[first] if m - len(first) < bands.agree[band] else np.arange(m)
        tail = np.uint64(2 * band) + (~full[use]).astype(np.uint64)
        keys.append(mix(content[use] + mix(use.astype(np.uint64) + np.uint64(band << 40))) & ~np.uint64(255) | tail)
        named.append(band)
        spare.append(len(use) - (m - bands.agree[band] + 1))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), named, spare


def folded(elements: np.ndarray) -> bytes:
    """The sketch folded to the power of two of at least 2 bits an element (64 at least)."""
    bits = max(64, 1 << int(2 * len(elements) - 1).bit_length())
    where = (elements & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(where, minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(sketch: bytes, length: int) -> bytes:
    """The sketch folded to so many bytes."""
    while len(sketch) > length:
        x = np.frombuffer(sketch, np.uint64 if len(sketch) > 8 else np.uint8)
        sketch = (x[: len(x) // 2] ^ x[len(x) // 2 :]).tobytes()
    return sketch


def differ(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer folded to the shorter's length: at most the symmetric difference."""
    least = min(len(a), len(b))
    x, y = np.frombuffer(fold(a, least), np.uint64), np.frombuffer(fold(b, least), np.uint64)
    return int(np.bitwise_count(x ^ y).sum())


class Cell:
    """Sets of one cell: which may link, by sizes, by sketches folded to the shortest's length, then by the sketches themselves."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes], num: int, den: int):
        self.sizes, self.num, self.den, self.sketches = sizes, num, den, sketches
        least = min(map(len, sketches))
        self.bits = np.frombuffer(b"".join(fold(x, least) for x in sketches), np.uint64).reshape(len(sketches), -1)
        self.whole = 8 * least

    def near(self, i: int, pool: np.ndarray) -> np.ndarray:
        """Members of pool that set i may link to."""
        n, m = self.sizes[i], self.sizes[pool]
        pool = pool[np.minimum(m, n) * self.den >= self.num * np.maximum(m, n)]
        if not len(pool):
            return pool
        most = (self.den - self.num) * (self.sizes[pool] + n) // (self.den + self.num)
        gap = np.bitwise_count(self.bits[pool] ^ self.bits[i]).sum(axis=1, dtype=np.int64)
        pool, most = pool[gap <= most], most[gap <= most]
        if 8 * len(self.sketches[i]) == self.whole or not len(pool):
            return pool
        return pool[[differ(self.sketches[j], self.sketches[i]) <= k for j, k in zip(pool.tolist(), most.tolist(), strict=True)]]


def _features(n_words: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for whole in batches:
            for i in range(0, len(whole), SLICE):
                b = whole.slice(i, SLICE)
                n, h1, h2, keys, named, spare, sketch = [], [], [], [], [], [], []
                for raw in b.column(3).cast(pa.binary()).to_pylist():
                    s = shingle_set(hasher(raw), n_words)
                    n.append(len(s))
                    h1.append(int(np.add.reduce(mix(s + np.uint64(1)), dtype=np.uint64).view(np.int64)))
                    h2.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5DEECE66D))).view(np.int64)) if len(s) else 0)
                    own = block_keys(s, bands) if len(s) else (s, [], [])
                    keys.append(own[0].tobytes())
                    named.append(own[1])
                    spare.append(own[2])
                    sketch.append(folded(s) if len(s) else b"")
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                cols = [pa.array(c, t) for c, t in zip((n, h1, h2, keys, named, spare, sketch), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], [x.split()[0] for x in FEATURES.split(", ")])

    return run


FEATURES = "row long, doc_id long, th long, n long, h1 long, h2 long, keys binary, bands array<int>, spare array<int>, sketch binary"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.asarray(b.column(0))
        for i in range(0, len(b), SLICE):
            raws = b.column(1).slice(i, SLICE).to_pylist()
            flat = np.frombuffer(b"".join(raws), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(rows[i : i + SLICE], [len(r) // 8 for r in raws]))], ["key", "row"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key another row has too, with how many have it (LONGEST_RUN at most)."""

    def made(keys: np.ndarray, rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.int64()), pa.array(n, pa.int32())], ["key", "row", "n"])

    held_k, held_r, flowing = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # a run that may go on; a run already longer than is counted
    for b in batches:
        k, r = np.concatenate([held_k, np.asarray(b.column(0))]), np.concatenate([held_r, np.asarray(b.column(1))])
        if not len(k):
            continue
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        size = np.minimum(np.diff(cut), LONGEST_RUN)
        if flowing is not None and k[0] == flowing:
            size[0] = LONGEST_RUN
        flowing = k[-1] if size[-1] == LONGEST_RUN else None
        ends = len(k) if flowing is not None else cut[-2]
        n = np.repeat(size, np.diff(cut))[:ends]
        held_k, held_r = k[ends:], r[ends:]
        yield made(k[:ends][n > 1], r[:ends][n > 1], n[n > 1])
    n = np.full(len(held_k), len(held_k))
    yield made(held_k[n > 1], held_r[n > 1], n[n > 1])


def _candidates(num: int, den: int, *, across: bool):
    """Pairs (a, b) to verify among rows sorted by cell: key, cell, row, n, sketch, comp, side, lows.

    First look (across false): a set near earlier leaders of its cell is paired with the first; one near none leads itself.
    Second look: pairs of near sets in different components. Whether two sets are near and in different components is the
    same in all their cells, so a pair is left to a lower block that both sets are known to have, and two sets of the same
    side of a grid to the cell of that side alone.
    """

    def pairs(key: int, rows: np.ndarray, sizes: np.ndarray, sketches: list[bytes], comp: np.ndarray, side: np.ndarray, lows: np.ndarray) -> Iterator[tuple[int, int]]:
        own, lead, two = Cell(sizes, sketches, num, den), np.zeros(0, np.int64), bool((side != side[0]).any())
        for i in range(len(rows)):
            got = own.near(i, np.flatnonzero((comp[:i] != comp[i]) & ~(two & (side[:i] == side[i]))) if across else lead)
            named = got if across else got[:1]
            for j in named[~np.isin(lows[named], lows[i][lows[i] < key]).any(axis=1)].tolist():
                yield min(int(rows[i]), int(rows[j])), max(int(rows[i]), int(rows[j]))
            if not across and not len(got):
                lead = np.append(lead, i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, set()
        for b in chain(batches, [None]):
            whole = held if b is None else pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]) if len(b) else held
            if whole is None or not len(whole):
                continue
            key, cell, row, n, comp, side = (whole.column(c).to_numpy() for c in ("key", "cell", "row", "n", "comp", "side"))
            lows = whole.column("lows").combine_chunks().flatten().to_numpy().reshape(-1, FIRST)
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]), [True]])).tolist()
            if b is not None:  # the last cell may go on
                held, cut = whole.slice(cut[-2]), cut[:-1]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                if y - x > 1:
                    for pair in pairs(key[x], row[x:y], n[x:y], whole.column("sketch").slice(x, y - x).to_pylist(), comp[x:y], side[x:y], lows[x:y]):
                        out.add(pair)
                        if len(out) >= FLUSH:
                            yield made(out)
                            out = set()
        yield made(out)

    def made(out: set[tuple[int, int]]) -> pa.RecordBatch:
        a, c = zip(*sorted(out), strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def _exact_sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for whole in batches:
            for i in range(0, len(whole), SLICE):
                b = whole.slice(i, SLICE)
                sets = [shingle_set(hasher(raw), n_words).view(np.int64) for raw in b.column(1).cast(pa.binary()).to_pylist()]
                edges = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(edges, np.concatenate(sets))], ["row", "elements"])

    return run


def jaccard_classes(docs: DataFrame, *, n_words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, th (hash of the text), n, h1, h2 of every row; and per distinct set n, h1, h2, component, best.

    A component is the number of one of its rows; best is the class's first row by (has no id, doc_id, th). Sets without
    elements are in no class.
    """
    bands = Bands(num, den)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    # Rows are numbered once, as they are written: ids may be missing or repeated.
    feats = stash(source.select(F.monotonically_increasing_id().alias("row"), "*").mapInArrow(lean(_features(n_words, bands)), FEATURES), "parity")
    classes = stash(feats.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("row").alias("row"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best")), "classes")
    wide = keep_ids(feats.filter("n > 0"), classes.select("row"), "row")
    keyed = wide.filter(F.length("keys") > 0).select("row", "keys").mapInArrow(lean(_keys), "key long, row long")
    shared = keyed.repartition(parts, "key").sortWithinPartitions("key", "row").mapInArrow(lean(_shared), "key long, row long, n int")
    band = F.shiftright(F.col("key").bitwiseAND(255), 1).cast("int")
    spare = wide.select("row", F.explode(F.arrays_zip("bands", "spare")).alias("x")).select("row", F.col("x.bands").alias("band"), F.col("x.spare").alias("spare"))
    last = Window.partitionBy("row", "band").orderBy(F.col("key").bitwiseAND(1).desc(), F.desc("n"), F.desc("key"))
    kept = shared.withColumn("band", band).withColumn("turn", F.row_number().over(last)).join(spare, ["row", "band"]).filter("turn > spare")
    kept = stash(kept.select("key", "row"), "kept")
    # Blocks kept by just the same sets give the same pairs: one of them is enough.
    blocks = kept.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("r"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("s")).filter("m > 1")
    blocks = blocks.groupBy("m", "r", "s").agg(F.min("key").alias("key")).select("key", F.when(F.col("m") > CELL, F.ceil(F.col("m") / CELL).cast("int")).alias("g"))
    own = F.pmod(F.xxhash64("row"), F.col("g")).cast("int")
    grid = kept.join(blocks, "key").withColumn(
        "cell",
        F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.least(own, j) * F.col("g") + F.greatest(own, j)))),
    )
    cells = stash(grid.select("key", "cell", "row", F.coalesce(own, F.lit(0)).alias("side")), "cells")
    lows = cells.groupBy("row").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST).alias("k"))
    lows = lows.select("row", F.concat("k", F.array_repeat(F.lit((1 << 63) - 1), FIRST - F.size("k"))).alias("lows"))
    sketches = stash(wide.select("row", "n", "sketch").join(lows, "row"), "sketches")

    def pairs(frame: DataFrame, across: bool) -> DataFrame:
        frame = frame.join(sketches, "row").select("key", "cell", "row", "n", "sketch", "comp", "side", "lows")
        frame = frame.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell", "row")
        return stash(frame.mapInArrow(lean(_candidates(num, den, across=across)), "a long, b long").distinct(), "pairs")

    def linked(found: DataFrame) -> DataFrame:
        ids = found.select(F.col("a").alias("row")).union(found.select("b")).distinct()
        named = stash(feats.select("row", "doc_id", "th").join(ids, "row"), "named").withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
        few = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        met = source.join(F.broadcast(named) if few else named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("row", "text").dropDuplicates(["row"])
        sets = stash(met.mapInArrow(lean(_exact_sets(n_words)), "row long, elements array<long>"), "sets")
        left, right = (sets.select(F.col("row").alias(k), F.col("elements").alias(f"{k}_set")) for k in "ab")
        both = F.size(F.array_intersect("a_set", "b_set")).cast("long")
        alike = F.lit(den) * both >= F.lit(num) * (F.size("a_set") + F.size("b_set") - both)
        return stash(found.join(left, "a").join(right, "b").filter(alike).select("a", "b"), "links")

    first = pairs(cells.withColumn("comp", F.lit(0).cast("long")), False)
    links = linked(first)
    comps = stash(connected_components(links), "components").withColumnRenamed("node", "row")
    labelled = cells.join(comps, "row", "left").withColumn("comp", F.coalesce("component", "row"))
    mixed = labelled.groupBy("key", "cell").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("m")).filter("c1 < c2 and m > 2").select("key", "cell")
    more = pairs(labelled.join(mixed, ["key", "cell"], "left_semi"), True).join(first, ["a", "b"], "left_anti")
    links = links.unionByName(linked(more))
    comps = stash(connected_components(links), "components").withColumnRenamed("node", "row")
    named = classes.join(comps, "row", "left").select("n", "h1", "h2", F.coalesce("component", "row").alias("component"), "best")
    return feats.select("doc_id", "th", "n", "h1", "h2"), stash(named, "class-components")


def jaccard_components(docs: DataFrame, *, n_words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link from a Jaccard similarity of num/den on.

    component_id is the smallest doc_id reachable by links. Null, empty and wordless texts have no shingles and link with
    nothing; a text of fewer than n_words words is one shingle. Every row is a node by its text: rows that repeat a doc_id
    with another text keep their own links and sizes. Null ids link like others; a component without any id has a null
    component_id. An empty table gives an empty result, other columns are ignored.
    """
    rows, classes = jaccard_classes(docs, n_words=n_words, num=num, den=den)
    same = ["n", "h1", "h2"]
    least = classes.groupBy("component").agg(F.min("best.doc_id").alias("least"))
    named = classes.join(least, "component").select(*same, "least", F.lit(True).alias("known"))
    out = rows.join(named, same, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, n_words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, all columns as they are, but one document only of each group linked as in jaccard_components.

    The lowest id stays, a row without an id only where none of its group has one; ties in the id are broken by a hash of the text.
    Texts without words link with nothing and all stay. Rows that repeat id and text count once.
    """
    rows, classes = jaccard_classes(docs, n_words=n_words, num=num, den=den)
    kept = classes.groupBy("component").agg(F.min("best").alias("best")).select("best.doc_id", "best.th").unionByName(rows.filter("n = 0").select("doc_id", "th"))
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_i"), F.xxhash64("text").alias("_h")]
    kept = kept.select(key[0], F.col("th").alias("_h")).distinct()
    return docs.select("*", *key).join(kept, ["_i", "_h"], "left_semi").dropDuplicates(["_i", "_h"]).select(*docs.columns)
