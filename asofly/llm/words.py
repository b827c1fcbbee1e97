"""Hashed words and word n-grams of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE = 50_000  # words whose hash a task remembers in each of two generations
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
EDGES = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())


class WordHasher:
    """64-bit hashes of the ASCII-white-space words of UTF-8 texts, A-Z lower-cased; equal words hash equally everywhere."""

    def __init__(self, strip: bool = False):
        self.strip, self.known, self.older = strip, {}, {}

    def __call__(self, raw: bytes | None) -> np.ndarray:
        """strip: signs at the ends of a word don't count, and words of signs alone are left out."""
        known = self.known
        words = (raw or b"").lower().split()
        try:
            got = [known[w] for w in words]
        except KeyError:
            if len(known) > CACHE:  # what is met again soon comes back from the older generation
                known, self.older = {}, known
                self.known = known
            for w in set(words).difference(known):
                h = self.older.get(w)
                if h is None:
                    core = w.strip(EDGES) if self.strip else w
                    h = xxhash.xxh64_intdigest(core) if core or not self.strip else 0
                known[w] = h
            got = [known[w] for w in words]
        out = np.array(got, np.uint64)
        return out[out != 0] if self.strip else out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order; fewer words: none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = total * _MIX[0] + words[i : len(words) - n + 1 + i]
        total ^= total >> np.uint64(29)
    return mix(total)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; with fewer words the whole sequence is the only one, without words there's none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(ngrams(words, min(n, len(words))))
