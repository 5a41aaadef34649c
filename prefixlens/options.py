"""The analysis knobs with their limits, and the two JSON config formats."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass

#: Slack of all threshold comparisons on ratios: the spacing of doubles at 1.
EPSILON = 2.220446049250313e-16


class OptionError(ValueError):
    """An option or config is out of its limits."""


@dataclass(frozen=True)
class AnalysisOptions:
    top_k: int = 20
    comparison_window_seconds: int = 3600
    min_template_members: int = 3
    stable_span_support_ratio: float = 0.80
    min_stable_support: int = 3
    fixed_variant_max: int = 3
    min_blocked_stable_bytes: int = 64
    min_exact_anchor_bytes: int = 24
    #: Accepted and echoed, used by no computation.
    text_similarity_threshold: float = 0.80
    template_compatibility_threshold: float = 0.68
    max_dynamic_coverage_ratio: float = 0.35
    max_candidates_per_request: int = 128
    max_projection_units: int = 512
    max_text_unit_bytes: int = 1_048_576
    max_payload_bytes: int = 8_388_608
    max_alignment_cells: int = 2_000_000
    max_total_alignment_cells: int = 64_000_000
    max_records: int = 1_000_000
    prefix_view_max_nodes: int = 5000
    prefix_view_excerpt_bytes: int = 96

    def __post_init__(self) -> None:
        ratios = {"stable_span_support_ratio", "text_similarity_threshold", "template_compatibility_threshold", "max_dynamic_coverage_ratio"}
        for f in dataclasses.fields(self):
            v = getattr(self, f.name)
            if f.name in ratios:
                if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or not 0 <= v <= 1:
                    raise OptionError(f"{f.name} must lie between 0 and 1")
                continue
            least = {"min_template_members": 2, "min_stable_support": 2, "prefix_view_max_nodes": 0}.get(f.name, 1)
            if isinstance(v, bool) or not isinstance(v, int) or v < least:
                raise OptionError(f"{f.name} must be a whole number of at least {least}")

    #: Fields that a config file may leave out.
    OPTIONAL = ("fixed_variant_max", "prefix_view_max_nodes", "prefix_view_excerpt_bytes")

    @classmethod
    def from_json(cls, text: str) -> AnalysisOptions:
        """A config file: every field but the optional ones is mandatory, unknown fields are refused."""
        given = _object(text)
        names = [f.name for f in dataclasses.fields(cls)]
        if unknown := sorted(set(given) - set(names)):
            raise OptionError(f"unknown fields: {', '.join(unknown)}")
        if missing := [n for n in names if n not in given and n not in cls.OPTIONAL]:
            raise OptionError(f"missing fields: {', '.join(missing)}")
        return cls(**given)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    def overridden(self, **given: object) -> AnalysisOptions:
        """Command line over config over defaults: fields that are not None replace."""
        return dataclasses.replace(self, **{k: v for k, v in given.items() if v is not None})


@dataclass(frozen=True)
class ReceiverOptions:
    listen: str = "127.0.0.1:8787"
    max_payload_bytes: int = 8_388_608

    def __post_init__(self) -> None:
        host, _, port = self.listen.rpartition(":") if isinstance(self.listen, str) else ("", "", "")
        if not host or not port.isdigit() or int(port) > 65535:
            raise OptionError("listen must be HOST:PORT")
        if isinstance(self.max_payload_bytes, bool) or not isinstance(self.max_payload_bytes, int) or self.max_payload_bytes < 1:
            raise OptionError("max_payload_bytes must be a whole number of at least 1")

    @classmethod
    def from_json(cls, text: str) -> ReceiverOptions:
        given = _object(text)
        if unknown := sorted(set(given) - {f.name for f in dataclasses.fields(cls)}):
            raise OptionError(f"unknown fields: {', '.join(unknown)}")
        return cls(**given)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)


def _object(text: str) -> dict:
    try:
        value = json.loads(text)
    except ValueError as e:
        raise OptionError(f"config is no JSON: {e}") from None
    if not isinstance(value, dict):
        raise OptionError("config must be a JSON object")
    return value
