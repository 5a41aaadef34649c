"""Words and word n-grams as 64-bit numbers, vectorised over whole Arrow batches."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

#: A maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str) -> list[str]:
    """Lower-cased words; split first, so that lower-casing cannot split a word."""
    found = WORD.findall(text)
    return " ".join(found).lower().split(" ") if found else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX[1]
    x ^= x >> np.uint64(27)
    x *= _MIX[2]
    x ^= x >> np.uint64(31)
    return x


def hash_text(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


class WordHashes(dict):
    """Word -> 64-bit hash, computed once per worker; emptied when it has grown past its bound."""

    BOUND = 2_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = hash_text(word)
        return h


def gram_sets(texts: list[list[str]], seeds: list[int], n: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word n-grams of each text: (hashes sorted within a text, offsets).

    The seed of a text enters its hashes, so only texts of one seed share any.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(sizes.sum())
    flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(texts)), np.uint64, total)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            g = mix(g * _MIX[0] + flat[k : total - n + 1 + k])
        g = mix(g ^ np.array(seeds, np.uint64)[owner[: total - n + 1]])
    inside = owner[: total - n + 1] == owner[n - 1 :]
    g, owner = g[inside], owner[: total - n + 1][inside]
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    if len(g):
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, owner = g[first], owner[first]
    return g, np.searchsorted(owner, np.arange(len(texts) + 1))
