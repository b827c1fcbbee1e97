"""Toxicity by noisy-channel deobfuscation.

A disguised word (leetspeak, separators between letters, letters repeated) is a lattice of characters: every written sign
may stand for some letters, or for none. A Viterbi search finds the likeliest letters under a character trigram model whose
counts come from every document. The restored words are then scored with evidence learned from labelled documents: whole
words and word beginnings that occur in toxic documents significantly more often than elsewhere.

Words of letters without equal ones in a row have a single path through their lattice, so they're looked up as they are.
Any other word is decoded only if its skeleton (signs that may stand for each other made equal, runs shortened) is that of
known evidence: nothing else could be restored to it. Short fragments in a row are joined and treated in the same way if
one of them is a single sign or there are three at least; two longer ones ('los er') are taken for two words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofly.llm.common import bounded_batches, held_out, lean
from asofly.llm.words import WordHasher, mix, shingle_set

#: What a sign may stand for besides itself.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
}
#: One letter for all that share a sign.
SAME = {"l": "i", "g": "9"}
#: Signs that may stand between letters without meaning.
BETWEEN = set(".-_*~^'`,:;/\\ #&%")
#: Signs that stand for no letter, so they don't count at the ends of a word.
SILENT = "".join(sorted((BETWEEN | set(map(chr, range(33, 127))) | set("“”‘’„«»…–—¿")) - set(SIGNS) - set(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123))))))
#: Natural logarithms of the channel: a sign read as a letter, a sign between letters left out, another left out, a repeat left out.
READ, SKIP, DROP, FOLD = math.log(0.6), math.log(0.3), math.log(0.0005), math.log(0.1)

LETTERS = "abcdefghijklmnopqrstuvwxyz"
N = len(LETTERS) + 1
PREFIXES = (4, 5, 6)
PRECISION = 0.98  # share of toxic documents among those with a piece of evidence
MAX_TRAIN = 40_000  # labelled documents at most, taken by a hash of their ids
MAX_EVIDENCE = 20_000  # words and beginnings that the model keeps at most
CACHE = 50_000  # words whose score a task remembers in each of two generations
REMEMBERED = 40  # characters of a word that is remembered
SKETCH, BAND, COPY = 64, 4, 0.8  # hashes of a training text's five-word runs, hashes of a band, share of equal ones of near copies
LONGEST = 64  # signs of a piece that is decoded at once, after repeats and separators are shortened; longer ones piece by piece
FRAGMENT = 4  # signs of a fragment of a spaced word


def _classes() -> np.ndarray:
    """Class of each byte of UTF-8 text: 1 to 26 a letter, 0 a boundary, 255 nothing (first byte of a Latin letter)."""
    out = np.zeros(256, np.uint8)
    for i, c in enumerate(LETTERS, 1):
        out[ord(c)] = out[ord(c.upper())] = i
    for b in range(0x80, 0xC0):
        base = unicodedata.normalize("NFKD", chr(b + 0x40))[0].lower()
        out[b] = LETTERS.find(base) + 1 if base in LETTERS else 0
    out[0xC3] = 255
    return out


CLASSES = _classes()


def trigram_counts(raw: bytes) -> np.ndarray:
    """Counts of the N*N*N trigrams of letter classes in a text."""
    x = CLASSES[np.frombuffer(raw, np.uint8)]
    x = x[x != 255].astype(np.int32)
    if len(x) < 3:
        return np.zeros(N**3, np.int64)
    return np.bincount(x[:-2] * N * N + x[1:-1] * N + x[2:], minlength=N**3)


class CharModel:
    """Log probabilities of a letter after two others, add-half smoothed."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(N, N, N) + 0.5
        self.logp = np.log(c / c.sum(axis=2, keepdims=True)).tolist()

    def decode(self, token: str) -> str:
        """The likeliest restored word of a token, in lower case; a token without letters gives ''."""
        best = {(0, 0, ""): (0.0, "")}  # the last two letters and the last sign read: log probability, restored word
        for c in token.lower():
            after: dict = {}
            base = unicodedata.normalize("NFKD", c)[0]
            reads = [(x, READ) for x in SIGNS.get(c, "")]
            if base in LETTERS:
                reads = [(c, 0.0)]
            for (a, b, last), (p, word) in best.items():
                options = [(word + x, q, x) for x, q in reads]
                if not reads or c in SIGNS or c in BETWEEN:
                    options.append((word, SKIP if c in BETWEEN else DROP, None))
                if last == c and reads:
                    options.append((word, FOLD, None))
                for w, q, x in options:
                    if x is None:
                        key, r = (a, b, last), p + q
                    else:
                        k = LETTERS.find(unicodedata.normalize("NFKD", x)[0]) + 1
                        key, r = (b, k, c), p + q + self.logp[a][b][k]
                    if key not in after or r > after[key][0]:
                        after[key] = (r, w)
            best = after or best
        return max(best.items(), key=lambda kv: (kv[1][0] + self.logp[kv[0][0]][kv[0][1]][0], kv[1][1]))[1][1]


def _fold() -> dict[int, str | None]:
    """For each ASCII character and each sign: the letter of its class, or nothing."""
    out: dict[int, str | None] = {}
    for c in {*map(chr, range(128)), *SIGNS}:
        x = SIGNS.get(c.lower(), c.lower())[0]
        x = SAME.get(x, x)
        out[ord(c)] = x if x.isalpha() or x == "9" else None
    return out


FOLDED = _fold()
LETTERS_ONLY = {ord(c): None for c in BETWEEN}


def skeleton(token: str) -> str:
    """What all words that a token may be restored to have in common with it."""
    out = token.lower().translate(FOLDED)
    if not out.isascii():
        out = "".join(c for c in out if c.isalpha() or c == "9")
    return _RUNS.sub(r"\1", out)


_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_EDGE_LEFT = re.compile(r"^[\W_]+")
_RUN2 = re.compile(r"(.)\1")
_RUNS = re.compile(r"(.)\1+")
_RUN3 = re.compile(r"(.)\1\1")
_LONG_RUN = re.compile(r"(.)\1{3,}")
_GAP = re.compile("([" + re.escape("".join(sorted(BETWEEN))) + "])[" + re.escape("".join(sorted(BETWEEN))) + "]+")
_PIECES = re.compile("[" + re.escape("".join(sorted(BETWEEN))) + "]")


def shorten(token: str) -> str:
    """The token with runs of equal signs cut to three and runs of separators to one."""
    return _GAP.sub(r"\1", _LONG_RUN.sub(r"\1\1\1", token))


def features(word: str) -> list[str]:
    """Whole word and its beginnings, as evidence is kept."""
    return [f"={word}", *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def words_of(text: str) -> set[str]:
    """Distinct white-space words in lower case; of single characters in a row, all joined runs of 4 to 12 count too."""
    parts = text.lower().split()
    found = set(parts)
    if sum(map((1).__eq__, map(len, parts))) >= 4:
        row: list[str] = []
        for p in [*parts, "  "]:
            if len(p) == 1:
                row.append(p)
            else:
                found.update("".join(row[i:j]) for i in range(len(row) - 3) for j in range(i + 4, min(i + 13, len(row) + 1)))
                row = []
    return found


def plain(token: str) -> str | None:
    """The token without signs at its ends if it is a word of letters with no run of three, else None."""
    w = _EDGE.sub("", token)
    return w if w.isalpha() and not _RUN3.search(w) else None


class Scorer:
    """Scores texts: 1 - product of (1 - precision) over the strongest evidence in each distinct word."""

    def __init__(self, evidence: dict[str, float], counts: np.ndarray, base: float):
        self.evidence, self.base, self.model, self.known, self.older = evidence, base, CharModel(counts), {}, {}
        self.bones = {skeleton(f[1:]) for f in evidence if f[0] == "="}
        self.starts = {skeleton(f[:-1]) for f in evidence if f[-1] == "*"}
        self.lengths = sorted({len(s) for s in self.starts})
        self.first = {(f[1:] if f[0] == "=" else f)[:3] for f in evidence}
        self.heads = {s[:2] for s in self.bones | self.starts}
        self.most = max(map(len, self.bones | self.starts), default=0)
        self.onsets, self.opens, self.fragments = {s[:4] for s in self.bones | self.starts}, {}, {}

    def _lookup(self, word: str) -> float:
        return max((self.evidence.get(f, 0.0) for f in features(word)), default=0.0) if word[:3] in self.first else 0.0

    def _named(self, bone: str) -> bool:
        return bone[:2] in self.heads and (bone in self.bones or any(bone[:k] in self.starts for k in self.lengths))

    def _disguised(self, token: str) -> float:
        """The evidence in a token's likeliest reading, also without a sign that stands in it again and again."""
        token = token if len(token) <= LONGEST else shorten(token)
        best = 0.0
        for x in {token, *(token.replace(c, "") for c in set(token) if not c.isalpha() and c in SIGNS and token.count(c) > 1)}:
            bone = skeleton(x)
            if not self._named(bone):
                continue
            if len(x) <= LONGEST:
                best = max(best, self._lookup(self.model.decode(x)))
            elif bone in self.bones:  # one word, however stretched: letter by letter it's shorter than what it's written with
                best = max(best, self._lookup(self.model.decode(_RUNS.sub(r"\1", x.translate(LETTERS_ONLY)))))
            else:
                best = max(best, max((self.evidence.get(f, 0.0) for f in features(self.model.decode(x[:LONGEST]))[1:]), default=0.0))
        return best

    def _opens(self, token: str) -> bool:
        """Whether the skeleton of some evidence begins as the token does."""
        known = self.opens.get(token)
        if known is None:
            if len(self.opens) >= CACHE:
                self.opens.clear()
            bone = skeleton(token)[:4]
            known = self.opens[token] = any(o[: len(bone)] == bone[: len(o)] for o in self.onsets)
        return known

    def spaced(self, parts: list[str]) -> set[str]:
        """Joined fragments that may be a disguised word: at most FRAGMENT signs each besides those at their ends."""
        found, known = set(), self.fragments
        if len(known) >= CACHE:
            known.clear()
        for p in set(parts).difference(known):
            short = len(p) <= FRAGMENT or len(p) <= FRAGMENT + 3 and len(_EDGE.sub("", p)) <= FRAGMENT
            known[p] = tuple(w for w in {p, _EDGE_LEFT.sub("", p)} if self._opens(w)) if short else None
        first = [known[p] for p in parts]
        for i in [i for i, w in enumerate(first[:-1]) if w]:
            for word in first[i]:
                single, letters = len(word) == 1, len(word)
                for j in range(i + 1, len(parts)):
                    if first[j] is None:
                        break
                    word += parts[j]
                    letters += len(parts[j])
                    if not self._opens(word[:8]) or len(skeleton(word)) > self.most + FRAGMENT:
                        break
                    single = single or len(parts[j]) == 1
                    if letters >= 4 and (single or j > i + 1):
                        found.add(word)
        return found

    def word(self, token: str) -> float:
        p = self.known.get(token)
        if p is None:
            p = self.older.get(token)
            if p is not None:
                self._keep(token, p)
                return p
            w = token if token.isalpha() else _EDGE.sub("", token)
            p = self._lookup(w)
            core = token.strip(SILENT)
            if not p and (not core.isalpha() or _RUN2.search(core)):
                p = max(self._disguised(x) for x in {core, w})
            if not p and len(token) > LONGEST:
                parts = {*re.findall(r"[^\W\d_]+", token), *_PIECES.split(token)} - {token, ""}
                p = max((self.word(x) for x in parts), default=0.0)
            if len(token) <= REMEMBERED:
                self._keep(token, p)
        return p

    def _keep(self, token: str, p: float) -> None:
        if len(self.known) >= CACHE:
            self.known, self.older = {}, self.known
        self.known[token] = p

    def score(self, text: str | None) -> float:
        rest, parts = 1.0, (text or "").lower().split()
        for w in set(parts) | self.spaced(parts):
            p = self.word(w)
            if p:
                rest *= 1.0 - p
        return 1.0 - rest * (1.0 - self.base)

    def restore(self, text: str) -> str:
        """The text with every disguised word decoded; plain words and white space between words stay."""
        return "".join(t if not t.strip() or len(t) > LONGEST or plain(t) is not None or not any(c.isalpha() for c in t) else self.model.decode(t) for t in re.split(r"(\s+)", text))


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N**3, np.int64)
    for b in batches:
        for i in range(0, len(b), 200):  # two ends of text between two texts
            total += trigram_counts(b"\0\0".join(x for x in b.column(0).slice(i, 200).cast(pa.binary()).to_pylist() if x))
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["code", "n"])


def sketch(raw: bytes, hasher: WordHasher) -> np.ndarray:
    """The smallest value of each of SKETCH hashes over the five-word runs of a text; a text without words gives none."""
    runs, seeds = shingle_set(hasher(raw), 5), mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    parts = [mix(runs[i : i + 4096, None] ^ seeds).min(axis=0) for i in range(0, len(runs), 4096)]
    return np.min(parts, axis=0) if parts else runs


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(strip=True)
    for b in batches:
        got = [sketch(raw, hasher).tobytes() for raw in b.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary())], ["signature", "toxic", "sketch"])


def near_copies(rows: list[tuple[int, int, bytes]]) -> set[tuple[int, int]]:
    """Of (signature, toxic, sketch), those whose sketch agrees with that of an earlier one that stays, of the same label."""
    found, heads, stay = set(), [], {}
    for signature, toxic, raw in sorted(rows):
        x = np.frombuffer(raw, np.uint64)
        if not len(x):
            continue
        keys = [(toxic, i, raw[8 * i : 8 * (i + BAND)]) for i in range(0, SKETCH, BAND)]
        met = list({h for k in keys for h in stay.get(k, ())})
        if met and ((np.array([heads[h] for h in met]) == x).mean(axis=1) >= COPY).any():
            found.add((signature, toxic))
            continue
        for k in keys:
            stay.setdefault(k, []).append(len(heads))
        heads.append(x)
    return found


def _feature_counts(name: str, copies: set[int], keep: set[str] | None = None):
    """A task that counts the documents with each feature (of keep only, if given), those of copies left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text, signature in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if signature in copies:
                    continue
                seen.update({f for w in words_of(text or "") if (p := plain(w)) for f in features(p) if keep is None or f in keep})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", name])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> dict:
    """Evidence and character model. docs: doc_id, text; labels: doc_id, toxic (1 or 0; null rows are left out).

    At most max_train labelled documents are used, those whose ids hash lowest. Equal texts among them (case and white
    space apart) and near copies, told by the sketches of their five-word runs, count once a label. No labels: no evidence, and every document gets the base score.
    """
    letters = bounded_batches(docs).select("text").mapInArrow(lean(_letter_counts), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = np.zeros(N**3, np.int64)
    for r in letters.collect():  # N*N*N rows at most
        counts[r["code"]] = r["n"]
    sample = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    signature = F.xxhash64(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    one = (
        docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id").withColumn("signature", signature)
        .groupBy("signature", (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"))
        .select("signature", "toxic", "text").persist()
    )
    rows = [(r["signature"], r["toxic"], bytes(r["sketch"])) for r in one.mapInArrow(lean(_sketches), "signature long, toxic int, sketch binary").collect()]  # of max_train documents
    copies = near_copies(rows)
    n1, n0 = (sum(r[1] == t for r in rows) - sum(c[1] == t for c in copies) for t in (1, 0))
    texts = lambda toxic: one.filter(F.col("toxic") == toxic).select("text", "signature")
    found = texts(1).mapInArrow(lean(_feature_counts("a", {c for c, t in copies if t})), "feature string, a long").groupBy("feature").agg(F.sum("a").alias("a")).filter("a >= 3")
    base = n1 / (n1 + n0) if n1 + n0 else 0.0
    keep = {r["feature"]: r["a"] for r in found.orderBy(F.desc("a"), "feature").limit(10 * MAX_EVIDENCE).collect()}
    clean = texts(0).mapInArrow(lean(_feature_counts("b", {c for c, t in copies if not t}, set(keep))), "feature string, b long").groupBy("feature").agg(F.sum("b").alias("b"))
    lows = {r["feature"]: r["b"] for r in clean.collect()}  # no more than the names above
    one.unpersist()
    bar, scored = 2 * math.log(len(keep) + 1) + 1, []  # about one feature passes by chance
    for f, a in keep.items():
        b = lows.get(f, 0)
        p = (a + 0.5) / (a + b + 1)
        if b <= (1 - PRECISION) * a and 0 < base < 1:
            gain = 2 * (a * math.log(a / (a + b) / base) + (b * math.log(b / (a + b) / (1 - base)) if b else 0))
            if gain > bar:
                scored.append((gain, f, p))
    return {"evidence": {f: p for _, f, p in sorted(scored, reverse=True)[:MAX_EVIDENCE]}, "counts": counts, "base": min(0.05, base / 2)}


def score_documents(docs: DataFrame, model: dict, *, threshold: float = 0.7, keep: bool = False) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) of every row; keep: the other columns of docs as well.

    Null and empty texts get the model's base score. Repeated rows are scored each by itself.
    """
    evidence, counts, base = model["evidence"], model["counts"], model["base"]
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.select("*" if keep else "doc_id").schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(evidence, counts, base)
        for b in batches:
            got = [scorer.score(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            cols = b.columns if keep else [b.column(b.schema.get_field_index("doc_id"))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())], names=schema.names)

    return bounded_batches(docs if keep else docs.select("doc_id", "text")).mapInArrow(lean(run), schema)


def drop_toxic(docs: DataFrame, model: dict, *, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, that score under the threshold."""
    evidence, counts, base = model["evidence"], model["counts"], model["base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(evidence, counts, base)
        for whole in batches:
            for i in range(0, len(whole), 1000):
                b = whole.slice(i, 1000)
                yield b.filter(pa.array([scorer.score(t) < threshold for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

    return bounded_batches(docs).mapInArrow(lean(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Learn from the labels outside the held-out fold, then score every document."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score_documents(docs, model, threshold=threshold).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
