"""Fast encoding with a word-end BPE vocabulary (lower case, white space dropped).

No token crosses white space, so a text's ids are those of its white-space words one after another, and a word's ids are
remembered. Unknown words are encoded many at a time: tiktoken merges them by the same ranks, each word end spelled as a
zero byte, which the texts taken this way never hold. Texts with characters beyond a plain Latin set, or that may hold a
special token, go through the tokenizers library whole.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

KNOWN = 100_000  # words remembered by a task in each of two generations
#: Characters whose class, case and composition need no Unicode tables beyond the standard library's.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-©«¬®-±´-¸»¿À-įı-ž‐-‧‰-⁞€]*")
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def _bytes_of_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: visible Latin-1 signs are themselves."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        signs, ranks = _bytes_of_signs(), {}
        specials = {t for t in vocab if t.startswith("<|")}
        for token, i in vocab.items():
            if token not in specials:
                end = token.endswith("</w>") and token != "</w>"
                ranks[bytes(signs[c] for c in (token[:-4] if end else token)) + b"\0" * end] = i
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.words = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        found = [_PIECES.findall(w) for w in words]
        flat = [p for f in found for p in f]
        ids = np.array(self.words.encode_ordinary("\0".join(flat) + "\0"), np.int64)
        stop = np.flatnonzero(self.ends[ids])[np.cumsum([len(f) for f in found]) - 1] + 1
        raw, size, at = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize, 0
        for w, z in zip(words, stop.tolist(), strict=True):
            self.known[w] = raw[at * size : z * size]
            at = z

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without special tokens; null and empty texts have none."""
        plain = [bool(t) and "<|" not in t and PLAIN.fullmatch(t) is not None for t in texts]
        parts = [t.lower().split() if ok else None for t, ok in zip(texts, plain, strict=True)]
        if len(self.known) > KNOWN:  # what is met again soon comes back from the older generation
            self.known, self.older = {}, self.known
        new = set().union(*(p for p in parts if p)).difference(self.known)
        if new and self.older:
            self.known.update((w, self.older[w]) for w in new.intersection(self.older))
            new.difference_update(self.older)
        if new:
            self._learn(list(new))
        known, out = self.known.__getitem__, []
        for t, p in zip(texts, parts, strict=True):
            if p is not None:
                out.append(np.frombuffer(b"".join(map(known, p)), self.kind))
            else:
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids if t else [], self.kind))
        return out


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
