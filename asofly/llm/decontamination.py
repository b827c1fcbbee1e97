"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every training document is scanned once for the word n-grams of the test items. However frequent an n-gram is, around the
seeds that a document shares with an item, the item's words are aligned locally with the document's (match, mismatch,
gap), which also scores copies with words changed, left out or put in. A pair is left unaligned only where the words that
both have in common can't reach the threshold in any order, which settles most runs of everyday words. Items come in
blocks of a fixed size, so what each task holds doesn't grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.llm.common import BROADCAST_ROWS, bounded_batches, lean, stash
from asofly.llm.words import WordHasher, ngrams

SEED = 4  # words of a seed
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_CHARS = 20_000_000  # of test items held by a task at once
SLICE = 500  # documents handled at once
SCHEMA = "doc_id long, th long, item_id long, score double, seeds int, start_word int, end_word int"


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: the best local score of two hashed word sequences and the end (exclusive) of its match in window."""
    before, best, end = np.zeros(len(window) + 1), 0.0, 0
    step = -GAP * np.arange(len(window) + 1)
    for w in item:
        row = before + GAP
        row[1:] = np.maximum(row[1:], before[:-1] + np.where(window == w, MATCH, MISMATCH))
        row[0] = 0
        row = np.maximum.accumulate(np.maximum(row, 0) + step) - step
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
        before = row
    return int(best), end


def bound(own: np.ndarray, other: np.ndarray) -> int:
    """What no local score of the two can exceed: the best run of own, its words that other lacks as mismatches."""
    total = np.concatenate(([0], np.cumsum(np.where(np.isin(own, other), MATCH, max(MISMATCH, GAP)))))
    return int((total - np.minimum.accumulate(total)).max())


def locate(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Share of the perfect score (0 to 1), and the aligned span of window; an empty item scores 0."""
    if not len(item) or not len(window):
        return 0.0, 0, 0
    best, end = align(item, window)
    _, back = align(item[::-1], window[:end][::-1])
    return best / (MATCH * len(item)), end - back, end


def _windows(hits: list[tuple[int, int]], length: int, words: int) -> list[tuple[int, int]]:
    """Spans of a document around seeds (position, offset in the item) where the item may lie; overlapping ones joined."""
    slack = length // 2 + 2
    out: list[list[int]] = []
    for start in sorted(p - o for p, o in hits):
        a, b = max(0, start - slack), min(words, start + length + slack)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Items:
    """A block of test items: hashed words by item, and sorted seed n-grams with the places where they occur."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int):
        hasher = WordHasher(strip=True)
        self.ids = [r[0] for r in rows]
        self.words = [hasher((r[1] or "").encode()) for r in rows]
        grams = [ngrams(w, min(seed, len(w))) if len(w) else np.zeros(0, np.uint64) for w in self.words]
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.owner, self.place = flat[order], owner[order], place[order]
        self.lengths = sorted({min(seed, len(w)) for w in self.words if len(w)})

    def found(self, words: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a document of n-grams that are seeds, and those n-grams."""
        at, what = [], []
        for n in self.lengths:
            g = ngrams(words, n)
            near = np.flatnonzero(bitmap[g & np.uint64(len(bitmap) - 1)])
            i = np.minimum(np.searchsorted(self.grams, g[near]), max(len(self.grams) - 1, 0))
            near = near[self.grams[i] == g[near]] if len(self.grams) else near[:0]
            at.append(near)
            what.append(g[near])
        return (np.concatenate(at), np.concatenate(what)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def bitmap(self) -> np.ndarray:
        bits = np.zeros(1 << max(16, int(len(self.grams) * 16).bit_length()), bool)
        bits[self.grams & np.uint64(len(bits) - 1)] = True
        return bits


def _block(docs: DataFrame, rows: list[tuple[int, str | None]], seed: int, threshold: float) -> DataFrame:
    items = Items(rows, seed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = WordHasher(strip=True), items.bitmap()
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, max(len(whole), 1), SLICE)):
            out: list[tuple] = []
            for doc, th, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                words = hasher(raw)
                at, what = items.found(words, bits)
                if len(at):
                    out.append((doc, th, at.tolist(), what.view(np.int64).tolist(), words.tobytes()))
            cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "th", "at", "what", "words"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    hits = stash(rows.mapInArrow(lean(scan), "doc_id long, th long, at array<int>, what array<long>, words binary"), "seed-hits")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, max(len(whole), 1), SLICE)):
            out: list[tuple] = []
            for doc, th, at, what, raw in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                words = np.frombuffer(raw, np.uint64)
                by_item: dict[int, list[tuple[int, int]]] = {}
                grams = np.array(what, np.int64).view(np.uint64)
                low, high = np.searchsorted(items.grams, grams, "left"), np.searchsorted(items.grams, grams, "right")
                for pos, i, j in zip(at, low.tolist(), high.tolist(), strict=True):
                    for k in range(i, j):
                        by_item.setdefault(int(items.owner[k]), []).append((pos, int(items.place[k])))
                for i, own in by_item.items():
                    item, best = items.words[i], (0.0, 0, 0)
                    for a, z in _windows(own, len(item), len(words)):
                        if min(bound(item, words[a:z]), bound(words[a:z], item)) < threshold * MATCH * len(item):
                            continue
                        s, x, y = locate(item, words[a:z])
                        best = max(best, (s, a + x, a + y), key=lambda t: (t[0], -t[1]))
                    if best[0] >= threshold:
                        out.append((doc, th, items.ids[i], best[0], len({o for _, o in own}), best[1], best[2]))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return hits.mapInArrow(lean(score), SCHEMA)


def _aligned(docs: DataFrame, benchmark: DataFrame, threshold: float, seed: int) -> DataFrame:
    items = benchmark.select("item_id", "text").filter("item_id is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    parts = []
    for i in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else items
        parts.append(_block(docs, [(r["item_id"], r["text"]) for r in own.collect()], seed, threshold))  # one block's texts
    return reduce(DataFrame.unionByName, parts)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5, seed: int = SEED) -> DataFrame:
    """One row per document and test item that align: doc_id, item_id, score, seeds, start_word, end_word.

    score is the alignment's share of the item's perfect score, at least threshold; the span counts words of the document
    (those with a letter or digit). Null and empty texts and items without words match nothing. Items shorter than a seed
    are sought whole. Equal items each get their rows; a repeated document row gets rows of its own. Empty tables give no
    rows; other columns are ignored.
    """
    return _aligned(docs, benchmark, threshold, seed).drop("th")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns as they are, in which no test item is found.

    Rows go by id and text together: a contaminated row without an id goes, and a clean row stays even if another row has
    its id and is contaminated.
    """
    leaks = _aligned(docs, benchmark, threshold, seed).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    leaks = stash(leaks, "leaks")
    few = leaks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_th"))
    return docs.join(F.broadcast(leaks) if few else leaks, same, "left_anti")
