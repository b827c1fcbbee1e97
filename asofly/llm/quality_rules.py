"""Quality rules: counted rules first, then a calibrated logistic regression on hashed word and character n-grams.

The features of a text are averages over it: its words, its pairs of words in a row, and its runs of three characters, each
hashed into buckets of their own. The regression is fitted on a bounded sample of labelled documents and calibrated by
scores that each half of the sample gets from a model of the other half (Platt's method); all documents are then scored
whole, in Arrow batches, against fixed thresholds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofly.llm.common import bounded_batches, held_out

BITS = 15  # buckets of words, of pairs and of characters each: 2^15
MAX_TRAIN = 6_000  # labelled documents at most, those whose ids hash lowest
MAX_TRAIN_CHARS = 40_000_000  # characters of them at most, in the same order, one document at least

# Fixed values of the rules
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEATED = 30  # per cent of the words
SYMBOLS = b"#*$%&|<>"
KEEP = 0.5  # calibrated probability of good quality from which a document is kept

_SYMBOL = np.zeros(128, bool)
_SYMBOL[list(SYMBOLS)] = True
SAME = np.uint32(0x5A5A5A5A)  # stands for a pair of equal words
_K = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _bucket(h: np.ndarray) -> np.ndarray:
    """A scramble of 32-bit numbers, cut to a bucket."""
    h = (h ^ (h >> np.uint32(15))) * _K[1]
    return ((h ^ (h >> np.uint32(13))) * _K[2]) >> np.uint32(32 - BITS)


def repeated_words(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Which words lie in a run of width words that its document holds twice or more; width is a power of two.

    Runs are numbered exactly: a run of 2k words by the numbers of its two halves.
    """
    hit = np.zeros(len(ids) + 1, np.int64)
    run, k = ids, 1
    while k < width:
        if len(run) <= k:
            return np.zeros(len(ids), bool)
        run = np.unique(run[:-k] * (len(ids) + 1) + run[k:], return_inverse=True)[1]
        k *= 2
    at = np.flatnonzero(np.arange(len(run)) + width <= ends[: len(run)])
    _, number, count = np.unique(run[at] * (int(doc[-1]) + 1) + doc[at], return_inverse=True, return_counts=True)
    at = at[count[number] > 1]
    np.add.at(hit, at, 1)
    np.add.at(hit, at + width, -1)
    return np.cumsum(hit)[:-1] > 0


class Texts:
    """Words, characters and hashed features of a batch of UTF-8 texts."""

    def __init__(self, raws: list[bytes]):
        self.raws, self.n = raws, len(raws)
        words = [r.split() for r in raws]  # bytes.split cuts at exactly space and \t to \r
        self.n_words = np.array([len(w) for w in words], np.int64)
        flat = [w for ws in words for w in ws]
        known = dict.fromkeys(flat)
        for i, w in enumerate(known):
            known[w] = i
        self.ids = np.array(list(map(known.__getitem__, flat)), np.int64)
        self.word_doc = np.repeat(np.arange(self.n), self.n_words)
        self.hashes = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))[self.ids]
        decoded = [r.decode("utf-8", "replace") for r in raws]
        self.n_chars = np.array([len(t) for t in decoded], np.int64)
        self.chars = np.frombuffer("".join(decoded).encode("utf-32-le", "replace"), np.uint32)
        self.char_doc = np.repeat(np.arange(self.n), self.n_chars)

    def sums(self, doc: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """Sum of values (or count) per document, in the order of the text, so that it doesn't depend on the batch."""
        return np.bincount(doc, values, minlength=self.n)

    def measures(self) -> list[np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
        blank = (self.chars == 32) | ((self.chars >= 9) & (self.chars <= 13))
        symbol = _SYMBOL[np.minimum(self.chars, 127)]
        lines = [[x for x in r.split(b"\n") if x.strip()] for r in self.raws]
        repeat = repeated_words(self.ids, self.word_doc, np.repeat(np.cumsum(self.n_words), self.n_words))
        return [self.n_words, self.sums(self.char_doc[~blank]), self.sums(self.char_doc[symbol]), np.array([len(x) - len(set(x)) for x in lines], np.int64), self.sums(self.word_doc[repeat])]

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(document, bucket) of words, pairs of words and runs of three characters, buckets of each kind after the last's.

        A word that follows itself is one feature, whatever the word.
        """
        h, c = self.hashes, self.chars
        pair = self.word_doc[1:] == self.word_doc[:-1]
        same = (self.ids[1:] == self.ids[:-1])[pair]
        run = self.char_doc[2:] == self.char_doc[:-2]
        found = [
            (self.word_doc, _bucket(h)),
            (self.word_doc[1:][pair], _bucket(np.where(same, SAME, h[:-1][pair] * _K[0] + h[1:][pair]))),
            (self.char_doc[2:][run], _bucket((c[:-2][run] * _K[0] + c[1:-1][run]) * _K[0] + c[2:][run])),
        ]
        return [(doc, bucket.astype(np.int64) + (kind << BITS)) for kind, (doc, bucket) in enumerate(found)]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum over the kinds of the mean weight of a text's features; without any: 0."""
        return sum(self.sums(doc, weights[b]) / np.maximum(self.sums(doc), 1) for doc, b in self.features())


@dataclass
class Model:
    """Weights of the features, the intercept, and the calibration: P(good) = sigmoid(slope * score + offset)."""

    weights: np.ndarray
    intercept: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, texts: Texts) -> np.ndarray:
        return sigmoid(self.slope * (texts.scores(self.weights) + self.intercept) + self.offset)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(indptr: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, *, l2: float = 1e-5, steps: int = 80, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on rows of sparse features; both classes weigh the same."""
    dim, m = 3 << BITS, len(y)
    rows = np.repeat(np.arange(m), np.diff(indptr))
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    w, moments = np.zeros(dim + 1), np.zeros((2, dim + 1))
    for t in range(1, steps + 1):
        p = sigmoid(np.bincount(rows, values * w[cols], minlength=m) + w[dim])
        g = weight * (p - y)
        grad = np.append(np.bincount(cols, values * g[rows], minlength=dim) + l2 * w[:dim], g.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
        w -= rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-9)
    return w[:dim], float(w[dim])


def calibrate(scores: np.ndarray, y: np.ndarray, *, rounds: int = 50) -> tuple[float, float]:
    """Platt's slope and offset by damped Newton steps towards smoothed targets; the slope is never negative."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(scores).max()), 1e-9)
    x, ab = scores / scale, np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(v: np.ndarray) -> float:
        z = v[0] * x + v[1]
        return float(np.sum(np.logaddexp(0, z) - target * z))

    for _ in range(rounds):
        p = sigmoid(ab[0] * x + ab[1])
        r, h = p - target, p * (1 - p)
        hess = np.array([[(h * x * x).sum(), (h * x).sum()], [(h * x).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step, size = np.linalg.solve(hess, [(r * x).sum(), r.sum()]), 1.0
        while size > 1e-4 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(ab[0]), 0.0) / scale, float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1; others are left out, of several the highest counts).

    At most max_train labelled documents of at most max_chars characters in all are used, those whose ids hash lowest; equal
    texts of one label count once. With one label only, or none, every document has the smoothed share of good ones.
    """
    sample = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # both windows run over max_train rows at most
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    lengths = known.select("doc_id", F.length("text").alias("size")).groupBy("doc_id").agg(F.max("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    by = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id")
    within = lengths.withColumn("place", F.row_number().over(by)).withColumn("upto", F.sum("size").over(by)).filter((F.col("place") == 1) | (F.col("upto") <= max_chars)).select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for raw in b.column(0).to_pylist():
                one = [np.unique(bucket, return_counts=True) for _, bucket in Texts([raw]).features()]
                got.append((np.concatenate([u for u, _ in one]).tolist(), np.concatenate([c / max(c.sum(), 1) for _, c in one]).tolist(), xxhash.xxh64_intdigest(raw) >> 1))
            cols = [pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32())), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, b.column(1)], ["cols", "vals", "h", "quality"])

    found = known.join(F.broadcast(within), "doc_id").select(F.col("text").cast("binary").alias("text"), "quality")
    found = bounded_batches(found).mapInArrow(run, "cols array<int>, vals array<float>, h long, quality int").dropDuplicates(["h", "quality"]).orderBy("h", "quality").toArrow()
    y = found.column("quality").to_numpy().astype(np.int64) if len(found) else np.zeros(0, np.int64)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(3 << BITS), offset=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    columns = found.column("cols").combine_chunks()
    cols, vals = columns.flatten().to_numpy(zero_copy_only=False).astype(np.int64), found.column("vals").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = columns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(y)), sizes)

    def part(of: np.ndarray) -> tuple:
        inside = of[row]
        return np.concatenate([[0], np.cumsum(sizes[of])]), cols[inside], vals[inside], y[of]

    half, score = np.arange(len(y)) % 2 == 0, np.zeros(len(y))  # rows are in the order of a hash
    for of in (half, ~half):
        if len(np.unique(y[of])) < 2:
            continue  # too few to cross-fit: these keep the score 0
        w, intercept = fit_logistic(*part(of))
        score += np.where(of, 0.0, np.bincount(row, vals * w[cols], minlength=len(y)) + intercept)
    w, intercept = fit_logistic(*part(np.ones(len(y), bool)))
    return Model(w, intercept, *calibrate(score, y))


def judge(docs: DataFrame, model: Model, *, threshold: float = KEEP) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the calibrated probability of every row of docs (doc_id, text).

    base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows that the text holds twice or more. kept:
    not base_failed, and the probability reaches the threshold. Null texts count as empty; they fail.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in counts), *(T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")), T.StructField("probability", T.DoubleType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            texts = Texts(b.column(1).to_pylist())
            found, p = texts.measures(), model.probability(texts)
            failed = (found[0] < MIN_WORDS) | (100 * found[4] > MAX_REPEATED * found[0])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64)) for x in found), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], schema.names)

    return bounded_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))).mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels outside the held-out fold and judge every document.

    Null texts count as empty. Repeated rows are judged each by itself, alike. Without labels of both kinds the model's
    verdict is that of their smoothed share, kept if there are none. An empty table gives an empty result; other columns
    are not read. Labels, lang, source and doc_id are no features.
    """
    out = judge(docs, fit(docs, labels.filter(~held_out(F.col("doc_id")))))
    return out.withColumn("held_out", held_out(F.col("doc_id")))
