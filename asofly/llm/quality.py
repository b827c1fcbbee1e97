"""Text quality by ordinal cumulative-link regression.

Grades 0 < 1 < ... < K-1 share one weight vector over hashed text features; ordered thresholds cut the score into grades:
P(grade <= k) = sigmoid(threshold_k - score). The features are averages over a document's words: each word hashed, the
shape of each word hashed (letters, capitals, digits and signs in runs), and how often a word repeats the one before. The
model is fitted on a bounded sample of rated documents; scoring then reads every whole text once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofly.llm.common import held_out

BUCKETS = 1 << 15
MAX_TRAIN = 8_000  # rated documents at most, taken by a hash of their ids
CACHE = 150_000  # words a task remembers at most
EXTRA = 3  # features after the hashed ones: repeats of the word before, distinct share, log of the number of words

_SHAPE = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0")]


def shape(word: str) -> str:
    """A word's run-length-free outline: 'Don't!!' is 'Aa'a!'."""
    for rx, by in _SHAPE:
        word = rx.sub(by, word)
    return re.sub(r"(.)\1+", r"\1", word)


def slots(word: str) -> tuple[int, int]:
    """Hash buckets of a word and of its shape."""
    return zlib.crc32(word.lower().encode()) % BUCKETS, BUCKETS + zlib.crc32(shape(word).encode()) % BUCKETS


def extras(words: list[str]) -> list[float]:
    n = len(words)
    if not n:
        return [0.0, 0.0, 0.0]
    return [sum(map(str.__eq__, words, words[1:])) / n, len(set(words)) / n, np.log1p(n) / 10]


def sparse(text: str) -> tuple[list[int], list[float]]:
    """Feature indices and values of a text; no words: none but the constant extras."""
    words = text.split()
    total: dict[int, float] = {}
    for w in words:
        for s in slots(w):
            total[s] = total.get(s, 0.0) + 1.0 / len(words)
    more = extras(words)
    return [*total, *(2 * BUCKETS + i for i in range(EXTRA))], [*total.values(), *more]


class OrdinalModel:
    """weights, and thresholds in rising order (one fewer than grades)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, one column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int, *, l2: float = 1e-4, steps: int = 250, rate: float = 0.3) -> OrdinalModel:
    """Maximise the penalised likelihood by Adam; the features come as (row, column, value) triples.

    Thresholds stay ordered because their gaps are exponentials. Without rows, or with one grade only, the weights are
    zero and the thresholds follow the smoothed shares of the grades.
    """
    dim, m = 2 * BUCKETS + EXTRA, len(grades)
    share = np.cumsum(np.bincount(grades, minlength=n_grades)[: n_grades - 1] + 0.5) / (m + 0.5 * n_grades)
    cut = np.log(share / (1 - share))
    free = np.concatenate([[cut[0]], np.log(np.maximum(np.diff(cut), 1e-3))])
    w = np.zeros(dim)
    if len(np.unique(grades)) < 2:
        return OrdinalModel(w, cut)
    moments = [np.zeros(dim + len(free)) for _ in range(2)]
    for t in range(1, steps + 1):
        theta = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        score = np.bincount(rows, values * w[cols], minlength=m)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(over="ignore"):
            hi, lo = 1 / (1 + np.exp(-(edge[grades + 1] - score))), 1 / (1 + np.exp(-(edge[grades] - score)))
        p = np.maximum(hi - lo, 1e-12)
        up, down = hi * (1 - hi) / p, lo * (1 - lo) / p  # of log p by the upper and lower threshold
        g_score = (down - up) / m
        g_theta = (np.bincount(grades, up, minlength=n_grades)[:-1] - np.bincount(grades, down, minlength=n_grades)[1:]) / m
        g_w = np.bincount(cols, values * g_score[rows], minlength=dim) - l2 * w
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(free[1:])])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        step = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
        w += step[:dim]
        free += step[dim:]
    return OrdinalModel(w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))]))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, *, max_train: int = MAX_TRAIN) -> OrdinalModel:
    """docs: doc_id, text; ratings: doc_id, grade (0 .. n_grades-1; null or other grades are left out).

    At most max_train rated documents are used, those whose ids hash lowest; a document rated twice has its highest grade.
    """
    sample = ratings.filter(F.col("grade").between(0, n_grades - 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sparse(t or "") for t in b.column(0).to_pylist()]
            cols = [pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*cols, b.column(1)], ["cols", "vals", "grade"])

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "grade").mapInArrow(run, "cols array<int>, vals array<float>, grade int").toArrow()
    sizes = found.column("cols").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(found) else np.zeros(0, np.int64)
    flat = [found.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(found) else np.zeros(0) for c in ("cols", "vals")]
    grades = found.column("grade").to_numpy().astype(np.int64) if len(found) else np.zeros(0, np.int64)
    return fit_ordinal(np.repeat(np.arange(len(grades)), sizes), flat[0].astype(np.int64), flat[1].astype(float), grades, n_grades)


def grade_documents(docs: DataFrame, model: OrdinalModel, *, select_at: int = 1, threshold: float = 0.5, keep: bool = False) -> DataFrame:
    """doc_id, score, expected_grade, p_ge_1 .. p_ge_{K-1} and selected (P(grade >= select_at) >= threshold) of every row.

    Null texts count as empty; an empty text is graded by the thresholds alone. keep: the other columns of docs as well.
    """
    weights, thresholds = model.weights, model.thresholds
    tails = [f"p_ge_{k + 1}" for k in range(len(thresholds))]
    fields = [T.StructField(c, T.DoubleType()) for c in ("score", "expected_grade", *tails)]
    docs = docs.drop("selected", *(f.name for f in fields))
    schema = T.StructType([*docs.select("*" if keep else "doc_id").schema, *fields, T.StructField("selected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches:
            scores = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                words = (text or "").split()
                total = 0.0
                for w in words:
                    v = known.get(w)
                    if v is None:
                        if len(known) >= CACHE:
                            known.clear()
                        i, j = slots(w)
                        v = known[w] = float(weights[i] + weights[j])
                    total += v
                scores.append((total / len(words) if words else 0.0) + float(np.dot(weights[2 * BUCKETS :], extras(words))))
            p = OrdinalModel(weights, thresholds).tails(np.array(scores, float))
            cols = b.columns if keep else [b.column(b.schema.get_field_index("doc_id"))]
            more = [np.array(scores, float), p.sum(axis=1), *p.T, p[:, select_at - 1] >= threshold]
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, more)], names=schema.names)

    return (docs if keep else docs.select("doc_id", "text")).mapInArrow(run, schema)


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from the label columns: 0 poor, 1 readable but toxic, 2 good; null where a label is missing.

    The given labels rate quality in two steps only; what a training set would take is a third one between them, a text
    that reads well and yet isn't wanted. Other ratings go to fit() as they are.
    """
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels outside the held-out fold and grade every document; selected: likelier than not above poor.

    Without labels every document has the same grades, repeated rows are graded each by itself, of several labels of an id
    the highest counts. An empty table gives an empty result.
    """
    model = fit(docs, ratings(labels).filter(~held_out(F.col("doc_id"))), 3)
    out = grade_documents(docs, model, select_at=1)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *out.columns[1:])
