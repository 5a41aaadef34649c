"""Defects: places where content that differs between members stands in front of content they share.

Along a template's coordinates, X is where members first part, P2 the next stable stretch that enough of
them have again, P1 what stands before X. Members with P2 are grouped by what they have in X; the largest
group counts as unaffected, P2 of the others is blocked. Wording is left to the reports: facts and insights
are codes with parameters.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

from prefixlens.functions import canonical as C
from prefixlens.operators.projection import SCHEMA
from prefixlens.operators.template import KIND_NAMES, SLOT, STABLE, Coordinate, Member, Template, digest, supported
from prefixlens.options import AnalysisOptions

EXCERPT = 160
GAP = "<gap>"
#: Order of fact kinds: by the name they have in digests and sorts (fixed values).
FACT_ORDER = ("content_variation", "fixed_variants", "insertion_deletion", "reorder", "scope", "structured_data_equivalent")


@dataclass
class Part:
    """One piece of a member's X."""

    kind: str
    coordinate: Coordinate | None
    digest: str
    content: str
    source: dict
    size: int
    identity: str | None


@dataclass
class Variant:
    """A member's X as a whole."""

    member: Member
    parts: list[Part]
    fingerprint: str
    prefix: int

    @property
    def text(self) -> str:
        return "".join(p.content for p in self.parts)

    @property
    def shape(self) -> tuple:
        return tuple((p.kind, p.coordinate.id if p.coordinate else "-") for p in self.parts)


def _zero_joined(parts: list[str]) -> str:
    return digest(b"".join(p.encode() + b"\0" for p in parts))


def shape_of(c: Coordinate, unit: dict) -> str:
    return ":".join((unit["collection"], KIND_NAMES[unit["kind"]], unit["alignment_key"], unit["role"] or "-", unit["tool_identity"] or "-"))


def source_of(unit: dict, unit_index: int, span: tuple[int, int], coordinate_unit: dict | None) -> dict:
    u = coordinate_unit or unit
    scope = [u["collection"], u["alignment_key"]]
    if coordinate_unit is not None and (coordinate_unit["role"] is not None):
        scope.append(coordinate_unit["role"])
    return {"json_path": unit["json_path"], "logical_scope": scope, "unit_index": unit_index, "byte_start": span[0], "byte_end": span[1], "role": unit["role"]}


class Diagnosis:
    """The scan of one template."""

    def __init__(self, template: Template, options: AnalysisOptions):
        self.t, self.options = template, options
        self.coords = template.coordinates
        self.opens: set[int] = {r.right for m in template.members for r in m.runs if r.right is not None}
        self.differs = [len({b.digest if b else GAP for b in bindings}) > 1 for bindings in zip(*(m.bindings for m in template.members))] if template.members else []
        # members with a run between coordinates k-1 and k
        self.between: dict[int, set[str]] = defaultdict(set)
        for m in template.members:
            for r in m.runs:
                if r.left is not None and r.right == r.left + 1:
                    self.between[r.right].add(m.request_id)

    def _exact(self, m: Member, k: int) -> int | None:
        b = m.bindings[k]
        return b.bytes[1] - b.bytes[0] if b is not None and b.digest == self.coords[k].digest else None

    def mismatch(self, start: int) -> tuple[int, int] | None:
        """(begin of X, where P2 may begin) at or after ``start``."""
        for k in range(start, len(self.coords)):
            if k in self.opens:
                return k, k
            if self.differs[k] or self.coords[k].kind == SLOT:
                return k, k + 1
        return None

    def recovery(self, search: int) -> tuple[int, int, dict[str, int]] | None:
        """(start, end, bytes per supporter) of the shortest stable chain that qualifies, earliest start first."""
        least = max(self.options.min_blocked_stable_bytes, self.options.min_exact_anchor_bytes)
        for start in range(search, len(self.coords)):
            if self.coords[start].kind != STABLE:
                continue
            have = {m.request_id: n for m in self.t.members if (n := self._exact(m, start)) is not None}
            end = start + 1
            while True:
                if supported(len(have), len(self.t.members), self.options) and min(have.values(), default=0) >= least:
                    return start, end, have
                if end == len(self.coords) or self.coords[end].kind != STABLE or not have:
                    break
                have = {m.request_id: have[m.request_id] + n for m in self.t.members if m.request_id in have and m.request_id not in self.between[end] and (n := self._exact(m, end)) is not None}
                end += 1
        return None

    def variant(self, m: Member, start: int, end: int) -> Variant:
        ordered: list[tuple[int, int, Part]] = []
        for r in m.runs:
            right = len(self.coords) if r.right is None else r.right
            if start <= right <= end and (r.left is None or r.left < end):
                for j in r.units:
                    u = m.units[j]
                    ordered.append((right, 0, Part("unmatched", None, digest(u["content"]), u["content"], source_of(u, j, (0, u["bytes"]), None), u["bytes"], u["tool_identity"])))
        for k in range(start, end):
            c, b = self.coords[k], m.bindings[k]
            cu = self.t.units[c.unit]
            if b is None:
                ordered.append((k, 1, Part("gap", c, GAP, "", source_of(cu, c.unit, c.bytes, cu), 0, cu["tool_identity"])))
            else:
                u = m.units[b.unit]
                identity = u["tool_identity"] if u["tool_identity"] is not None else cu["tool_identity"]
                ordered.append((k, 1, Part("binding", c, b.digest, u["content"][slice(*b.chars)], source_of(u, b.unit, b.bytes, cu), b.bytes[1] - b.bytes[0], identity)))
        parts = [p for _, _, p in sorted(ordered, key=lambda x: x[:2])]
        mark = _zero_joined([x for p in parts for x in (p.kind, p.coordinate.id if p.coordinate else "-", p.digest)])
        return Variant(m, parts, mark, sum(b.bytes[1] - b.bytes[0] for b in m.bindings[:start] if b is not None))

    def candidates(self) -> list[dict]:
        if len(self.t.members) < self.options.min_stable_support:
            return []
        out, cursor = [], 0
        while cursor < len(self.coords) and (at := self.mismatch(cursor)) is not None:
            begin, search = at
            found = self.recovery(max(search, cursor))
            if found is None:
                cursor += 1
                continue
            start, end, have = found
            if (one := self.candidate(begin, start, end, have)) is not None:
                out.append(one)
            cursor = max(end, begin + 1)
        return out

    def candidate(self, begin: int, start: int, end: int, have: dict[str, int]) -> dict | None:
        located = sorted((self.variant(m, begin, start) for m in self.t.members if m.request_id in have), key=lambda v: v.member.request_id)
        groups: dict[str, list[Variant]] = {}
        for v in located:
            groups.setdefault(v.fingerprint, []).append(v)
        if len(located) < self.options.min_stable_support or len(groups) < 2:
            return None
        largest = min(groups, key=lambda f: (-len(groups[f]), f))
        others = [v for v in located if v.fingerprint != largest]
        worst = min(others, key=lambda v: (v.prefix, v.member.request_id))
        blocked = min(have[v.member.request_id] for v in others)
        if blocked < self.options.min_blocked_stable_bytes:
            return None
        pattern, facts, insights, certainty = analyse_facts(located, self.options.fixed_variant_max)
        shape = "/".join(shape_of(c, self.t.units[c.unit]) for c in self.coords[begin : max(start, begin + 1)])
        facts = sorted([*facts, {"kind": "scope", "detail": shape}], key=lambda f: FACT_ORDER.index(f["kind"]))
        anchor = _zero_joined([c.digest for c in self.coords[start:] if c.kind == STABLE])
        local = "/".join(shape_of(c, self.t.units[c.unit]) for c in self.coords[start:end])
        confidence = min(max(self.t.cohesion * 1.0 * (len(located) / len(self.t.members)) * certainty, 0.0), 1.0)
        sources, text = [], ""
        for k in range(start, end):
            b = worst.member.bindings[k]
            if b is not None:
                u = worst.member.units[b.unit]
                sources.append(source_of(u, b.unit, b.bytes, self.t.units[self.coords[k].unit]))
                text += u["content"][slice(*b.chars)]
        return {
            "id": defect_id(self.t.domain, shape, anchor, local),
            "template_id": self.t.id,
            "pattern": pattern,
            "variants": [_grouped(f, groups[f]) for f in sorted(groups)],
            "facts": facts,
            "recovered_stable": {"sources": sources, "utf8_bytes": have[worst.member.request_id], "support_count": len(have), "excerpt": text[:EXCERPT]},
            "representative_member_id": worst.member.request_id,
            "actual_prefix_bytes": worst.prefix,
            "potential_prefix_bytes": worst.prefix + blocked,
            "blocked_stable_bytes": blocked,
            "comparable_count": len(located),
            "affected_count": len(others),
            "confidence": confidence,
            "insights": insights,
        }


def _grouped(fingerprint: str, members: list[Variant]) -> dict:
    first = members[0]
    sources = [p.source for p in first.parts if p.kind != "gap"]
    sources = sorted(sources, key=lambda s: (s["json_path"], s["byte_start"]))
    return {
        "fingerprint": fingerprint,
        "member_request_ids": [v.member.request_id for v in members],
        "representative": {
            "request_id": first.member.request_id,
            "sources": [s for i, s in enumerate(sources) if not i or s != sources[i - 1]],
            "utf8_bytes": sum(p.size for p in first.parts),
            "excerpt": first.text[:EXCERPT] or None,
        },
    }


def _debug(v: str | None) -> str:
    """An optional key as the id's material spells it."""
    if v is None:
        return "None"
    return 'Some("' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '")'


def defect_id(domain: dict, shape: str, anchor: str, local: str) -> str:
    """Names the place, not the values: domain, shapes and the chain of shared content behind it."""
    material = "\0".join(
        ("region-fp-v2", str(domain["time_window_key"]), domain["endpoint_key"], domain["model"], _debug(domain["model_deployment_key"]), _debug(domain["agent_key"]), _debug(domain["kv_namespace"]), SCHEMA, shape, anchor, local)
    )
    return "defect-" + hashlib.sha256(material.encode()).hexdigest()[:24]


# Facts


def analyse_facts(located: list[Variant], fixed_max: int) -> tuple[str, list[dict], list[dict], float]:
    """(pattern, facts, insights, certainty) of the members' X."""
    sequence = any(p.kind != "binding" for v in located for p in v.parts)
    reorder = reordered([[p.identity for p in v.parts if p.identity is not None] for v in located])
    bound = [v for v in located if v.parts and all(p.kind == "binding" for p in v.parts)]
    kinds = {v.fingerprint for v in bound}
    content = not reorder and len(bound) >= 2 and len({v.shape for v in bound}) == 1 and len(kinds) > 1
    facts, insights = [], []
    if content:
        fixed = len(kinds) <= fixed_max and len(kinds) < len(bound)
        facts.append({"kind": "fixed_variants" if fixed else "content_variation", "detail": str(len(kinds))})
        insights.append({"summary": "unify_versions" if fixed else "move_volatile_back", "detail": "blocks_later_prefix"})
    if sequence or reorder:
        facts.append({"kind": "reorder" if reorder else "insertion_deletion", "detail": None})
        insights.append({"summary": "fix_element_order" if reorder else "append_at_end", "detail": None})
    if equal_json([v.text for v in located if v.text]):
        facts.append({"kind": "structured_data_equivalent", "detail": None})
        insights.append({"summary": "fix_serialisation", "detail": "fix_key_order_and_space"})
    pattern = "mixed" if content and (sequence or reorder) else "reorder" if reorder else "insertion_deletion" if sequence else "value_mismatch"
    return pattern, facts, sorted(insights, key=lambda i: (i["summary"], i["detail"] or "")), 0.9 if sequence and not reorder else 1.0


def reordered(orders: list[list[str]]) -> bool:
    """Whether the same unique identities come in different orders."""
    if len(orders) < 2 or any(not o or len(set(o)) < len(o) for o in orders):
        return False
    return all(set(o) == set(orders[0]) for o in orders) and any(o != orders[0] for o in orders)


def loose_json(text: str) -> tuple[str, str] | None:
    """(label, canonical JSON) of a text that is JSON, or a non-blank label followed by JSON."""
    try:
        return "", C.canonical(C.parse(text))
    except ValueError:
        pass
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0 or not text[:start].strip():
        return None
    try:
        return text[:start], C.canonical(C.parse(text[start:]))
    except ValueError:
        return None


def equal_json(texts: list[str]) -> bool:
    """At least two texts, all the same JSON under the same label, not all written alike."""
    if len(texts) < 2 or len(set(texts)) < 2:
        return False
    values = [loose_json(t) for t in texts]
    return None not in values and len(set(values)) == 1
