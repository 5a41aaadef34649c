"""Templates: what the members of a cohort share, as an ordered partition of the centre's text.

A cohort's members are aligned to its centre. Each position of the centre's units becomes part of a stable
span or of a slot; together these coordinates form the template, and every member binds each coordinate to a
fragment of its own or to a gap. Units a member has besides are kept as runs between coordinates.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np

from prefixlens.operators.align import Cells, align_units, match_text
from prefixlens.operators.cohort import COLLECTION_NAMES
from prefixlens.options import EPSILON, AnalysisOptions

STABLE, SLOT = "stable", "slot"
EXAMPLES = 16
#: Names of kinds inside digests and shapes (fixed values).
KIND_NAMES = {
    "structural": "Structural", "role": "Role", "visible_text": "VisibleText", "tool_definition": "ToolDefinition", "tool_call": "ToolCall", "tool_result": "ToolResult",
}


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def digest_parts(*parts: str) -> str:
    return digest(b"".join(p.encode() + b"\0" for p in parts))


@dataclass
class Span:
    """A stretch of one unit of the centre: characters and bytes, half-open."""

    unit: int
    chars: tuple[int, int]
    bytes: tuple[int, int]
    support: int


@dataclass
class Slot(Span):
    values: list[str] = field(default_factory=list)
    distinct: int = 0


@dataclass
class Coordinate:
    id: str
    ordinal: int
    kind: str
    unit: int
    chars: tuple[int, int]
    bytes: tuple[int, int]
    digest: str
    size: int
    support: int


@dataclass
class Fragment:
    """A piece of a member's unit."""

    unit: int
    chars: tuple[int, int]
    bytes: tuple[int, int]
    digest: str


@dataclass
class Run:
    """Consecutive units of a member that match none of the centre's; coordinates around it by position."""

    units: list[int]
    left: int | None
    right: int | None


@dataclass
class Member:
    request_id: str
    units: list[dict]
    bindings: list[Fragment | None] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)


@dataclass
class Template:
    id: str
    cohort_id: str
    domain: dict
    medoid: str
    cohesion: float
    units: list[dict]
    spans: list[Span]
    slots: list[Slot]
    coordinates: list[Coordinate]
    members: list[Member]


def supported(n: int, total: int, options: AnalysisOptions) -> bool:
    return n >= options.min_stable_support and n / max(total, 1) + EPSILON >= options.stable_span_support_ratio


class _Text:
    """A text with the byte offset of every character."""

    _kept: dict[str, np.ndarray] = {}

    @classmethod
    def offsets(cls, text: str) -> np.ndarray | range:
        if text.isascii():
            return range(len(text) + 1)
        if text not in cls._kept:
            if len(cls._kept) > 10_000:
                cls._kept.clear()
            sizes = [1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4 for c in text]
            cls._kept[text] = np.concatenate(([0], np.cumsum(sizes)))
        return cls._kept[text]


def _bytes(text: str, start: int, end: int) -> tuple[int, int]:
    at = _Text.offsets(text)
    return int(at[start]), int(at[end])


def _stable_runs(maps: np.ndarray, weights: np.ndarray, text: str, total: int, options: AnalysisOptions) -> list[tuple[int, int, int]]:
    """(start, end, support) of the accepted spans of a text.

    ``maps``: distinct partner text x character, the matched character or -1; ``weights``: members with that
    partner. A run starts at a supported character and goes on while the members that have followed without
    a break remain supported. Runs of too few bytes are dropped and the search goes on one character later.
    """
    n = maps.shape[1]
    if not n:
        return []
    mapped = maps >= 0
    counts = weights @ mapped
    # end of the unbroken stretch that each partner is in at each character
    follows = np.zeros(maps.shape, bool)
    follows[:, 1:] = mapped[:, 1:] & mapped[:, :-1] & (maps[:, 1:] == maps[:, :-1] + 1)
    last = np.full(maps.shape, n, np.int64)
    breaks = np.where(~follows, np.arange(n), n)
    last[:, :-1] = np.minimum.accumulate(breaks[:, ::-1], axis=1)[:, ::-1][:, 1:]
    least = next((s for s in range(1, total + 1) if supported(s, total, options)), total + 1)
    at, out, pos = _Text.offsets(text), [], 0
    while pos < n:
        if counts[pos] < least:
            pos += 1
            continue
        ends, w = last[mapped[:, pos], pos], weights[mapped[:, pos]]
        order = np.argsort(-ends)
        reach = int(ends[order][np.searchsorted(np.cumsum(w[order]), least)])
        if at[reach] - at[pos] >= options.min_exact_anchor_bytes:
            out.append((pos, reach, int(w[ends >= reach].sum())))
            pos = reach
        else:
            pos += 1
    return out


def _slot_value(text: str, chars: tuple[int, int], n: int, match: list[int]) -> tuple[int, int] | None:
    """The member's characters between the matches that border a stretch of the centre."""
    start = 0 if chars[0] == 0 else match[chars[0] - 1] + 1
    if chars[0] and match[chars[0] - 1] < 0:
        return None
    if chars[1] == n:
        end = len(text)
    elif (end := match[chars[1]]) < 0:
        return None
    return (start, end) if start <= end else None


def _make_slot(unit: int, chars: tuple[int, int], span: tuple[int, int], values: list[str]) -> Slot:
    seen = list(dict.fromkeys(values))
    return Slot(unit, chars, span, len(values), seen[:EXAMPLES], len(seen))


def _logical(unit: dict) -> tuple[str, ...]:
    return COLLECTION_NAMES[unit["collection"]], KIND_NAMES[unit["kind"]], unit["alignment_key"], unit["role"] or "", unit["tool_identity"] or ""


def _coordinates(units: list[dict], pieces: list[tuple[int, tuple, tuple, str, int]]) -> list[Coordinate]:
    """Ordered coordinates with ids made of content (stable) or of the nearest stable neighbours (slot)."""
    pieces = sorted(pieces, key=lambda p: (p[0], p[2][0], p[3] == SLOT, p[2][1]))
    stable: dict[int, list[tuple[tuple, str]]] = {}
    for unit, chars, span, kind, _ in pieces:
        if kind == STABLE:
            stable.setdefault(unit, []).append((span, digest(units[unit]["content"][slice(*chars)])))
    out: list[Coordinate] = []
    seen: dict[str, int] = {}
    for unit, chars, span, kind, support in pieces:
        content = digest(units[unit]["content"][slice(*chars)])
        identity = content
        if kind == SLOT:
            around = stable.get(unit, [])
            left = max((s for s in around if s[0][1] <= span[0]), key=lambda s: s[0][1], default=(None, "start"))[1]
            right = min((s for s in around if s[0][0] >= span[1]), key=lambda s: s[0][0], default=(None, "end"))[1]
            identity = digest_parts(left, right)
        base = digest_parts(*_logical(units[unit]), kind, identity)
        repeat = seen.get(base, 0)
        seen[base] = repeat + 1
        name = digest_parts(base, str(repeat)) if repeat else base
        out.append(Coordinate(name, len(out), kind, unit, chars, span, content, span[1] - span[0], support))
    return out


def build(cohort_id: str, domain: dict, medoid: str, cohesion: float, members: list[tuple[str, list[dict]]], options: AnalysisOptions) -> Template:
    """The template of a cohort; BudgetError where an alignment would cost too much. Members come in id order."""
    cells = Cells(options.max_alignment_cells, options.max_total_alignment_cells)
    units = next(u for i, u in members if i == medoid)
    total = len(members)
    slim = lambda us: [((u["alignment_key"], u["kind"], u["collection"]), u["content"]) for u in us]
    centre = slim(units)
    aligned: list[list[int | None]] = []
    kept: dict[tuple, list[int | None]] = {}
    for _, us in members:
        need = (len(units) + 1) * (len(us) + 1)
        cells.charge(need)
        cells.check(need, "unit")
        key = tuple(u["fp"] for u in us)
        if key not in kept:
            kept[key] = align_units(centre, slim(us))
        aligned.append(kept[key])

    spans: list[Span] = []
    slots: list[Slot] = []
    matches: dict[int, list[list[int] | None]] = {}
    memo: dict = {}
    for i, unit in enumerate(units):
        text = unit["content"]
        partners = [us[a[i]] if a[i] is not None else None for (_, us), a in zip(members, aligned)]
        whole = (0, len(text)), (0, unit["bytes"])
        if unit["kind"] != "visible_text":
            same = sum(p is not None and p["content"] == text for p in partners)
            if supported(same, total, options) and unit["bytes"] >= options.min_exact_anchor_bytes:
                spans.append(Span(i, *whole, same))
            elif any(p is not None and p["content"] != text for p in partners):
                slots.append(_make_slot(i, *whole, [p["content"] for p in partners if p is not None]))
            continue
        matches[i] = found = [match_text(text, p["content"], cells, memo) if p is not None else None for p in partners]
        weight: dict[str, int] = {}
        rows: dict[str, list[int]] = {}
        for p, m in zip(partners, found):
            if p is not None:
                weight[p["content"]] = weight.get(p["content"], 0) + 1
                rows[p["content"]] = m
        maps = np.array(list(rows.values()), np.int64).reshape(len(rows), len(text))
        accepted = _stable_runs(maps, np.array([weight[t] for t in rows], np.int64), text, total, options)
        spans += [Span(i, (a, b), _bytes(text, a, b), s) for a, b, s in accepted]
        edges = [0, *(x for a, b, _ in accepted for x in (a, b)), len(text)]
        for a, b in zip(edges[::2], edges[1::2]):
            if a < b:
                values = [_slot_value(p["content"], (a, b), len(text), m) for p, m in zip(partners, found) if p is not None]
                texts = [p["content"] for p in partners if p is not None]
                slots.append(_make_slot(i, (a, b), _bytes(text, a, b), [t[slice(*v)] for t, v in zip(texts, values) if v]))
        if not text and any(p is not None and p["content"] for p in partners):
            slots.append(_make_slot(i, *whole, [p["content"] for p in partners if p is not None]))

    pieces = [(s.unit, s.chars, s.bytes, STABLE, s.support) for s in spans] + [(s.unit, s.chars, s.bytes, SLOT, s.support) for s in slots]
    covered = {p[0] for p in pieces}
    for i, unit in enumerate(units):
        if i not in covered:
            same = sum(a[i] is not None and us[a[i]]["content"] == unit["content"] for (_, us), a in zip(members, aligned))
            pieces.append((i, (0, len(unit["content"])), (0, unit["bytes"]), STABLE if same == total else SLOT, same))
    coordinates = _coordinates(units, pieces)
    first = {}
    final = {}
    for c in coordinates:
        first.setdefault(c.unit, c.ordinal)
        final[c.unit] = c.ordinal

    out = []
    for n, ((request, us), a) in enumerate(zip(members, aligned)):
        member = Member(request, us)
        for c in coordinates:
            member.bindings.append(_bind(c, us, a, units[c.unit], matches[c.unit][n] if c.unit in matches else None))
        free = sorted(set(range(len(us))) - {j for j in a if j is not None})
        runs: list[list[int]] = []
        for j in free:
            if runs and runs[-1][-1] == j - 1:
                runs[-1].append(j)
            else:
                runs.append([j])
        for run in runs:
            left = max((i for i, j in enumerate(a) if j is not None and j < run[0]), default=None)
            right = min((i for i, j in enumerate(a) if j is not None and j > run[-1]), default=None)
            member.runs.append(Run(run, final.get(left), first.get(right)))
        out.append(member)
    return Template(digest(cohort_id.encode() + b"\0" + medoid.encode()), cohort_id, domain, medoid, cohesion, units, spans, slots, coordinates, out)


def _bind(c: Coordinate, us: list[dict], a: list[int | None], unit: dict, match: list[int] | None) -> Fragment | None:
    j = a[c.unit]
    if j is None:
        return None
    text = us[j]["content"]
    if unit["kind"] != "visible_text":
        chars: tuple[int, int] | None = (0, len(text))
    elif match is None:
        return None
    elif c.kind == STABLE and c.chars[0] < c.chars[1]:
        start = match[c.chars[0]]
        unbroken = start >= 0 and match[c.chars[0] : c.chars[1]] == list(range(start, start + c.chars[1] - c.chars[0]))
        chars = (start, start + c.chars[1] - c.chars[0]) if unbroken else None
    else:
        chars = _slot_value(text, c.chars, len(unit["content"]), match)
    if chars is None:
        return None
    return Fragment(j, chars, _bytes(text, *chars), digest(text[slice(*chars)]))
