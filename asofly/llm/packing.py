"""Lexical retrieval packing of documents into training windows.

All documents are encoded once; how many documents hold a token is counted over the whole corpus. A document goes to others
with the same weightiest token (by count and rarity): tokens in order, cut into shards of a bounded number of ids, one token's documents
over as many shards as they fill. Each shard builds a BM25 inverted index over its documents' tokens. A window starts with a
seed document; the unused documents that the index ranks highest for the seed's weightiest tokens fill it, the last one
cut where the window is full. What is cut off opens the next window and is its seed. So windows hold no padding; a shard's
last, short window is cut into sequences whose lengths are powers of two, which need none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofly.llm.common import bounded_batches, give_back, lean, stash
from asofly.llm.word_bpe import word_bpe

WINDOW = 4096
END = 2  # the id after each document
SHARD_TOKENS = 2_000_000
QUERY_TERMS = 24  # of a seed, by BM25 weight: more make a seed's neighbours no different (see README), but the ranking slower
K1, B = 1.2, 0.75
CHUNK = 400  # documents encoded at once
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def encode_documents(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """row (a number of its own), doc_id, n, key (its weightiest token), ids (binary, little-endian unsigned 16 or 32 bits, `end`
    included); null text counts as empty.

    Each task adds a row with n = -1 whose ids hold, as 64-bit numbers, how many of its documents have each token.
    """
    names = ["row", "doc_id", "n", "key", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        df, rarity = np.zeros(bpe.size, np.int64), np.log1p(np.arange(bpe.size))
        for b in batches:
            for i in range(0, len(b), CHUNK):
                got, keys = bpe.encode(b.column(2).slice(i, CHUNK).to_pylist()), []
                for x in got:
                    u, c = np.unique(x, return_counts=True)
                    df[u] += 1
                    keys.append(weightiest(u, c, rarity) if len(u) else end)
                df[end] += len(got)
                got = [np.append(x, bpe.kind(end)) for x in got]
                cols = [pa.array([len(x) for x in got], pa.int64()), pa.array(keys, pa.int32()), pa.array([x.tobytes() for x in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, CHUNK), b.column(1).slice(i, CHUNK), *cols], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([end], pa.int32()), pa.array([df.tobytes()], pa.binary())], names)

    # Rows are numbered once, as they are written: ids may be missing or repeated.
    rows = bounded_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lean(run), "row long, doc_id long, n long, key int, ids binary")


def weightiest(tokens: np.ndarray, counts: np.ndarray, rarity: np.ndarray) -> int:
    """The token that says most about a text: its count, saturated as in BM25, times its rarity (ties: the smallest).

    Rarity is by the vocabulary's own order, in which frequent pieces come first, so no pass over the corpus comes before.
    """
    return int(tokens[np.argmax(rarity[tokens] * counts / (counts + K1))])


class Index:
    """BM25 postings of a shard: for each token the documents that hold it and the score it adds."""

    def __init__(self, texts: list[np.ndarray], df: np.ndarray, n_docs: int):
        size, lengths = len(df), np.array([len(t) for t in texts], float)
        found = [np.unique(t, return_counts=True) for t in texts]
        term = np.concatenate([u for u, _ in found]).astype(np.int32)
        tf = np.concatenate([c.astype(np.int32) for _, c in found])
        starts = np.cumsum([0, *(len(u) for u, _ in found)])
        del found
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        weight = np.empty(len(term))
        for i, (a, z) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            weight[a:z] = idf[term[a:z]] * tf[a:z] * (K1 + 1) / (tf[a:z] + norm[i])
        del tf
        self.n = len(texts)
        self.queries = [term[a:z][np.argsort(-weight[a:z], kind="stable")[:QUERY_TERMS]] for a, z in zip(starts[:-1], starts[1:], strict=True)]
        order = np.argsort(term, kind="stable").astype(np.int32)
        self.edges = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))])
        del term
        self.weights = weight[order]
        del weight
        self.docs = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(starts))[order]

    def ranked(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a query token with the seed, best first, ties by position."""
        spans = [(self.edges[t], self.edges[t + 1]) for t in self.queries[seed]]
        docs = np.concatenate([self.docs[a:z] for a, z in spans])
        score = np.bincount(docs, np.concatenate([self.weights[a:z] for a, z in spans]), minlength=self.n)
        score[used] = 0
        hit = np.flatnonzero(score > 0)
        return hit[np.argsort(-score[hit], kind="stable")]


def pack(texts: list[np.ndarray], df: np.ndarray, n_docs: int, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; each id of each document lies in exactly one."""
    if not texts:
        return
    index, used, fresh = Index(texts, df, n_docs), np.zeros(len(texts), bool), 0
    left, sequence = sum(map(len, texts)), 0
    room = window if left >= window else 1 << (left.bit_length() - 1)
    size, carry = room, None  # carry: a document cut at the end of the window before, and where
    queue, at = np.zeros(0, np.int64), 0
    while left:
        if carry is not None:
            d, start = carry
        else:
            while at < len(queue) and used[queue[at]]:
                at += 1
            if at < len(queue):
                d = int(queue[at])
            else:
                while used[fresh]:
                    fresh += 1
                d = fresh
            used[d], start = True, 0
        if room == size:  # it opens the window: its neighbours follow
            queue, at = index.ranked(d, used), 0
        n = min(room, len(texts[d]) - start)
        yield d, start, n, sequence, size - room
        carry = (d, start + n) if start + n < len(texts[d]) else None
        room, left = room - n, left - n
        if not room and left:
            sequence += 1
            size = room = window if left >= window else 1 << (left.bit_length() - 1)


def pack_documents(docs: DataFrame, vocabulary: str, *, window: int = WINDOW, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and the piece's ids (unsigned 32 bits).

    Null and empty texts are the single id `end`. Repeated rows are packed each by itself. An empty table gives no rows. The
    result depends on the encoded rows alone, not on how tasks run: they are numbered as they are written.
    """
    coded = stash(encode_documents(docs, vocabulary, end), "encoded")
    size, kind = word_bpe(vocabulary).size, word_bpe(vocabulary).kind
    df = np.zeros(size, np.int64)
    n_docs = coded.filter("n >= 0").count()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += np.frombuffer(raw, np.int64)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], ["token", "n"])

    counted = coded.filter("n < 0").select("ids").mapInArrow(unpack, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # a row for each token of the vocabulary at most
        df[r["token"]] = r["n"]
    routed = coded.filter("n >= 0")
    spans, at = [], 0
    for r in sorted(routed.groupBy("key").agg(F.sum("n").alias("n")).collect()):  # a row for each token at most
        spans.append((r["key"], at // shard_tokens, (at + r["n"] - 1) // shard_tokens - at // shard_tokens + 1))
        at += r["n"]
    shards = max(1, -(-at // shard_tokens))
    # By Arrow: rows of Python objects would start a second daemon and further workers on the executors, only to hand them on.
    cols = zip(*spans, strict=True) if spans else ([], [], [])
    where = docs.sparkSession.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "first", "many"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_bpe.cache_clear()  # a worker that has encoded remembers its words, of which packing needs none
        give_back()
        now, ids, texts = None, [], []
        for b in batches:
            for shard, d, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if shard != now:
                    yield from packed(now, ids, texts)
                    now, ids, texts = shard, [], []
                ids.append(d)
                texts.append(np.frombuffer(raw, kind))
        yield from packed(now, ids, texts)

    def packed(shard: int | None, ids: list, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for d, start, n, sequence, offset in pack(texts, df, n_docs, window):
            rows.append((ids[d], start, n, len(texts[d]), (shard << 32) + sequence, offset, texts[d][start : start + n].astype("<u4").tobytes()))
            if len(rows) == 2000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    dealt = routed.join(F.broadcast(where), "key").select((F.col("first") + F.pmod(F.xxhash64("row"), "many")).alias("shard"), "row", "doc_id", "ids")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "row").mapInArrow(lean(run), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(cols)], [x.split()[0] for x in SCHEMA.split(", ")])
