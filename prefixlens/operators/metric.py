"""Similarity of two unit sequences of one domain.

Units are bagged by (collection, kind, key, tool). Inside a bag equal contents cancel out, the rest is
paired in sorted order and scored by the Dice overlap of sampled 4-byte shingles, weighted by bytes.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from prefixlens.operators.projection import COLLECTIONS, KINDS
from prefixlens.options import EPSILON, AnalysisOptions

SHINGLE, SAMPLE = 4, 256
#: Texts whose shingles are kept as sets, of about 25 KB each.
SETS = 4096
#: FNV-1a, 64 bits (fixed values).
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv_shingles(data: bytes) -> np.ndarray:
    """FNV-1a of every window of four bytes; single bytes where there are fewer."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(b) < SHINGLE:
        return b
    n = len(b) - SHINGLE + 1
    h = np.full(n, FNV_OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            h = (h ^ b[i : i + n]) * np.uint64(FNV_PRIME)
    return h


def sampled(data: bytes, mode: str = "compat") -> np.ndarray:
    """At most 256 shingles, sorted.

    ``compat``: the first 256, of which the smallest gives way to the smallest of all. ``bottom_k``: the 256
    smallest, wherever they stand.
    """
    h = fnv_shingles(data)
    if len(h) <= SAMPLE:
        return np.sort(h)
    if mode == "bottom_k":
        return np.sort(np.partition(h, SAMPLE - 1)[:SAMPLE])
    head = np.sort(h[:SAMPLE])
    head[0] = h.min()
    return head


def repeats(ordered: np.ndarray) -> np.ndarray:
    """The number of each element among equal ones, from 0, in a sorted array."""
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return np.arange(len(ordered)) - np.repeat(starts, np.diff(np.append(starts, len(ordered))))


NONE: Counter = Counter()


@dataclass
class Profile:
    """What the metric needs of one distinct unit sequence."""

    bags: dict[tuple, Counter] = field(default_factory=dict)
    tools: frozenset[str] = frozenset()

    @classmethod
    def of(cls, units: list[dict]) -> Profile:
        bags: dict[tuple, Counter] = {}
        for u in units:
            key = (COLLECTIONS.index(u["collection"]), KINDS.index(u["kind"]), u["alignment_key"], u["tool_identity"] is not None, u["tool_identity"] or "")
            bags.setdefault(key, Counter())[u["content"]] += 1
        return cls(bags, frozenset(u["tool_identity"] for u in units if u["tool_identity"] is not None))


class PairMetric:
    """Pair metrics with what they share between pairs kept: shingles per content, results per pair."""

    def __init__(self, mode: str = "compat"):
        self.mode = mode
        self.shingles: dict[str, np.ndarray] = {}
        self.sets: dict[str, frozenset] = {}
        self.sizes: dict[str, int] = {}

    def clear(self) -> None:
        for kept in (self.shingles, self.sets, self.sizes):
            kept.clear()

    def _size(self, text: str) -> int:
        if text not in self.sizes:
            self.sizes[text] = len(text.encode())
        return self.sizes[text]

    def sampled(self, text: str) -> np.ndarray:
        if text not in self.shingles:
            self.shingles[text] = sampled(text.encode(), self.mode)
        return self.shingles[text]

    def _set(self, text: str) -> frozenset:
        """The sampled shingles, each with its number among equal ones."""
        if text not in self.sets:
            if len(self.sets) >= SETS:
                self.sets.clear()
            h = self.sampled(text)
            again = h[1:] == h[:-1]
            if again.any():
                self.sets[text] = frozenset((v, k) if k else v for v, k in zip(h.tolist(), repeats(h).tolist()))
            else:
                self.sets[text] = frozenset(h.tolist())
        return self.sets[text]

    def dice(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        x, y = self._set(a), self._set(b)
        return 2.0 * len(x & y) / max(len(x) + len(y), 1)

    def content_and_structure(self, a: Profile, b: Profile) -> tuple[float, float]:
        similar, weight, matched, units = 0.0, 0, 0, 0
        for key in sorted(a.bags.keys() | b.bags.keys()):
            x, y = a.bags.get(key, NONE), b.bags.get(key, NONE)
            units += max(sum(x.values()), sum(y.values()))
            for text, n in x.items():
                if n := min(n, y.get(text, 0)):
                    w = n * max(self._size(text), 1)
                    similar += w
                    weight += w
                    matched += n
            left, right = (sorted(t for t, n in p.items() for _ in range(n - q.get(t, 0))) for p, q in ((x, y), (y, x)))
            paired = min(len(left), len(right))
            matched += paired
            for s, t in zip(left, right):
                w = max(self._size(s), self._size(t), 1)
                weight += w
                similar += self.dice(s, t) * w
            weight += sum(max(self._size(t), 1) for t in left[paired:] + right[paired:])
        return similar / max(weight, 1), matched / max(units, 1)

    def __call__(self, a: Profile, b: Profile) -> tuple[float, float]:
        """(compatibility, dynamic coverage) of two sequences of one domain."""
        content, structure = self.content_and_structure(a, b)
        if union := len(a.tools | b.tools):
            return 0.20 * structure + 0.15 * len(a.tools & b.tools) / union + 0.65 * content, 1.0 - content
        return 0.25 * structure + 0.75 * content, 1.0 - content


def accepts(pair: tuple[float, float], options: AnalysisOptions) -> bool:
    return pair[0] + EPSILON >= options.template_compatibility_threshold and pair[1] <= options.max_dynamic_coverage_ratio + EPSILON


class Bound:
    """Which pairs of a domain's variants may be accepted; all others surely are not.

    A pair is accepted only if its content is at least ``least``: the sum of w * (least - dice) over its paired units
    must not be positive. Each unit of one side adds at least the smallest such term over all units of its bag on the
    other side, or least * size where it stays alone; dice is bounded from above by shingles hashed to few columns.
    The terms of a bag come from one matrix product, so that most pairs are told apart without being scored.
    """

    COLUMNS, TEXTS, SLACK = 2048, 128, 1e-3

    def __init__(self, profiles: list[Profile], metric: PairMetric, options: AnalysisOptions):
        self.metric, self.n = metric, len(profiles)
        self.least = max(1 - options.max_dynamic_coverage_ratio, (options.template_compatibility_threshold - 0.35) / 0.65)
        self.bags: dict[tuple, list[tuple[int, str, int]]] = {}
        self.total = np.zeros(self.n)
        for v, p in enumerate(profiles):
            for key, texts in p.bags.items():
                rows = self.bags.setdefault(key, [])
                for t, k in texts.items():
                    rows.append((v, t, k))
                    self.total[v] += k * max(metric._size(t), 1)

    def _columns(self, texts: list[str]) -> np.ndarray:
        """A row of counts per text: its shingles, numbered among equal ones, by hashed column."""
        out = np.empty((len(texts), self.COLUMNS), np.float32)
        for at in range(0, len(texts), 1024):
            found = [self.metric.sampled(t) for t in texts[at : at + 1024]]
            sizes = [len(h) for h in found]
            row, h = np.repeat(np.arange(len(found)), sizes), np.concatenate(found)
            starts = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])).nonzero()[0] if len(h) else row
            apart = (np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))).astype(np.uint64)
            with np.errstate(over="ignore"):
                mixed = (h ^ (apart * np.uint64(0xD1B54A32D192ED03))) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            column = (mixed >> np.uint64(53)).astype(np.int64)
            out[at : at + len(found)] = np.bincount(row * self.COLUMNS + column, minlength=len(found) * self.COLUMNS).reshape(len(found), -1)
        return out

    def rows(self, wanted: list[int]) -> np.ndarray:
        """(wanted, variants): may the pair be accepted?"""
        place = {v: i for i, v in enumerate(wanted)}
        terms = np.zeros((len(wanted), self.n), np.float32)
        apart = np.tile(self.total, (len(wanted), 1))
        for units in self.bags.values():
            mine = [(place[v], t, k) for v, t, k in units if v in place]
            if not mine:
                continue
            # units come in order of their variants
            variant = np.array([u[0] for u in units])
            number: dict[str, int] = {}
            text = np.array([number.setdefault(u[1], len(number)) for u in units])
            sizes = np.array([max(self.metric._size(t), 1) for t in number], np.float32)
            count = np.array([u[2] for u in units])
            starts = np.flatnonzero(np.append(True, variant[1:] != variant[:-1]))
            has = variant[starts]
            weight = np.zeros(self.n)
            weight[has] = np.add.reduceat(sizes[text] * count, starts)
            apart[sorted({i for i, _, _ in mine})] -= weight
            x = self._columns(list(number))
            length = np.array([len(self.metric.sampled(t)) for t in number], np.float32)
            asked = sorted({number[t] for _, t, _ in mine})
            for at in range(0, len(asked), self.TEXTS):
                s = np.array(asked[at : at + self.TEXTS])
                both = length[s][:, None] + length
                dice = 2 * np.minimum(x[s] @ x.T, np.minimum(length[s][:, None], length)) / np.maximum(both, 1)
                dice[np.arange(len(s)), s] = 1
                term = np.maximum(sizes[s][:, None], sizes) * (np.float32(self.least) - dice)
                alone = np.float32(self.least) * sizes[s]
                best = np.repeat(alone[:, None], self.n, 1)
                best[:, has] = np.minimum(best[:, has], np.minimum.reduceat(term[:, text], starts, axis=1))
                at_text = {t: i for i, t in enumerate(s.tolist())}
                times = np.zeros((len(wanted), len(s)), np.float32)
                for i, t, k in mine:
                    if (j := at_text.get(number[t])) is not None:
                        times[i, j] += k
                terms += times @ best
        slack = self.SLACK * (self.total + self.total[wanted][:, None])
        may = terms + self.least * apart <= slack
        # a pair of which both sides are wanted is bounded from either
        may[:, wanted] &= may[:, wanted].T
        return may
