"""Token counts of sections, from one encoding of each whole document.

Every document is encoded once with a byte-level vocabulary. A token's character span follows from the bytes it covers,
and an interval join (binary search of both spans' edges) attributes tokens to the sections of the document. A token that
crosses a boundary is allocated by an explicit rule:

- "start": to the section that holds its first character;
- "majority": to the section that holds most of its characters, the earlier one at a tie;
- "share": to each section in proportion to its characters.

Sections are half-open character spans in rising order without overlap; by default the lines or the sentences of a text,
each with the white space that ends it. Characters that no section holds belong to section -1, which gets a row only if it gets tokens.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, section int, start int, end int, n_tokens double, n_crossing long, doc_tokens long"
RULES = ("start", "majority", "share")
PIECE = 20_000  # output rows of a batch, about


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """A vocabulary of ranks, and the number of bytes of each of its tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("spans", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


ENDS = {"lines": re.compile(r"\n"), "sentences": re.compile(r"[.!?]+\s+|\n+")}


def cut(text: str, unit: str) -> list[tuple[int, int]]:
    """Character spans of a text's lines or sentences, ends included; a text without characters is one empty span."""
    edges = [m.end() for m in ENDS[unit].finditer(text)]
    if not edges or edges[-1] < len(text):
        edges.append(len(text))
    return list(zip([0, *edges], edges))


def token_chars(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open character spans of consecutive tokens of `sizes` bytes.

    A token that begins inside a character starts at the next one; a token with no first byte of a character has an empty
    span there.
    """
    firsts = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    ends = np.cumsum(sizes)
    edges = firsts[np.concatenate([[0], ends])]
    return edges[:-1], edges[1:]


def allocate(start: np.ndarray, end: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section (the last entry: outside all), and how many tokens of each section cross its boundary.

    start, end: token spans; spans: sections as rows of (start, end).
    """
    k = len(spans)
    low = np.searchsorted(spans[:, 1], start, side="right")  # first section that ends after the token starts
    inside = low < k
    inside[inside] &= spans[low[inside], 0] <= start[inside]
    home = np.where(inside, low, k)
    whole = (inside & (end <= spans[np.minimum(low, k - 1), 1])) | (end <= start)
    total = np.bincount(home[whole], minlength=k + 1).astype(float)
    crossing = np.zeros(k + 1, np.int64)
    over = np.flatnonzero(~whole)  # tokens over a boundary; each meets the sections from low on that start before it ends
    if len(over):
        met = np.maximum(np.searchsorted(spans[:, 0], end[over], side="left") - low[over], 0)
        tok = np.repeat(over, met)
        sec = np.arange(len(tok)) - np.repeat(np.cumsum(met) - met, met) + low[tok]
        n = np.minimum(end[tok], spans[sec, 1]) - np.maximum(start[tok], spans[sec, 0])
        rest = (end - start)[over] - np.bincount(np.searchsorted(over, tok), n, minlength=len(over)).astype(np.int64)
        tok, sec, n = np.concatenate([tok, over]), np.concatenate([sec, np.full(len(over), k)]), np.concatenate([n, rest])
        tok, sec, n = tok[n > 0], sec[n > 0], n[n > 0]
        shared = np.bincount(np.searchsorted(over, tok), minlength=len(over)) > 1
        crossing += np.bincount(sec[shared[np.searchsorted(over, tok)]], minlength=k + 1)
        if rule == "share":
            total += np.bincount(sec, n / (end - start)[tok], minlength=k + 1)
        elif rule == "start":
            total += np.bincount(home[over], minlength=k + 1)
        else:
            order = np.lexsort((sec, -n, tok))
            total += np.bincount(sec[order][np.unique(tok[order], return_index=True)[1]], minlength=k + 1)
    return total, crossing


def attribute_tokens(docs: DataFrame, vocabulary: str, pattern: str, *, rule: str = "majority", unit: str = "lines", id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """One row per document and section: its span, the tokens allocated to it, how many cross its boundary.

    sections_col: a column of array<struct<start int, end int>>; null or no column: the text's
    lines or sentences, as unit says. Null and empty texts
    have one empty section with no tokens. Repeated rows are counted each by itself.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    cols = [id_col, text_col, *([sections_col] if sections_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoding(vocabulary, pattern)
        out: list[tuple] = []
        pending = 0

        def made() -> pa.RecordBatch:
            ids, parts, total, cross, n = zip(*out, strict=True)
            reps = [len(p) for p in parts]
            flat = np.concatenate(parts)
            arrays = [np.repeat(np.array(n), reps), flat[:, 0], flat[:, 1], flat[:, 2], np.concatenate(total), np.concatenate(cross)]
            who = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), reps)))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([who, *(pa.array(x, t) for x, t in zip(arrays[1:], kinds, strict=True)), pa.array(arrays[0], pa.int64())], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

        for b in batches:
            given = b.column(2).to_pylist() if sections_col else [None] * len(b)
            for doc, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), given, strict=True):
                text = text or ""
                spans = np.array(cut(text, unit) if own is None else [(s["start"], s["end"]) for s in own], np.int64).reshape(-1, 2)
                ids = sizes[np.array(enc.encode_ordinary(text), np.int64)]
                if len(spans):
                    total, cross = allocate(*token_chars(text.encode(), ids), spans, rule)
                else:
                    total, cross = np.array([float(len(ids))]), np.zeros(1, np.int64)
                k = len(spans)
                named = np.column_stack([np.arange(k), spans])
                if total[k] or not k:
                    named = np.vstack([named, [[-1, 0, len(text)]]])
                out.append((doc, named, total[: len(named)], cross[: len(named)], len(ids)))
                pending += len(named)
                if pending >= PIECE:
                    yield made()
                    out.clear()
                    pending = 0
            if out:
                yield made()
                out.clear()

    return docs.select(*cols).mapInArrow(run, SCHEMA)
