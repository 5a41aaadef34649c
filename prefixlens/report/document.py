"""The result as one JSON document: assembled, written atomically, read back strictly."""

from __future__ import annotations

import dataclasses
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from prefixlens import schema as S
from prefixlens.operators.validate import SCHEMA_VERSION, violations
from prefixlens.options import AnalysisOptions
from prefixlens.plans.pipeline import Analysis


class DocumentError(ValueError):
    """A result document contradicts its format or itself."""


def _plain(v: object) -> object:
    """Rows as objects; absent values are left out."""
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items() if x is not None}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v


def _all(df: DataFrame) -> list[dict]:
    # a document is read whole by people; larger results stay tables
    return [_plain(r) for r in df.toLocalIterator()]


def to_document(a: Analysis) -> dict:
    nodes: dict[str, list[dict]] = {}
    for n in _all(a.prefix_nodes.orderBy("template_id", "ordinal")):
        nodes.setdefault(n.pop("template_id"), []).append(n)
    templates = []
    for t in _all(a.templates.drop("candidates", "coordinates", "coordinate_count", "cohort_id").orderBy("id")):
        if chain := nodes.get(t["id"]):
            cut = chain[0]["truncated"]
            for n in chain:
                n.pop("truncated")
                n.pop("ordinal")
                for v in n.get("variants", ()):
                    v.setdefault("is_missing", False)
            t["prefix_view"] = {"node_count": len(chain), "truncated": cut, "nodes": chain}
        templates.append(t)
    defects = []
    for d in _all(a.defects):
        d.pop("representative_member_id")
        d["mismatch"] = {k: d.pop(k) for k in ("pattern", "variants", "facts")}
        d["score"] = {**{k: d[k] for k in ("blocked_stable_bytes", "affected_count", "confidence")}, "score": d.pop("score")}
        defects.append(d)
    events: dict[str, list[dict]] = {}
    for e in _all(a.session_events.orderBy("session_key", "next_sequence")):
        events.setdefault(e.pop("session_key"), []).append(e)
    document = {
        "run": {
            "schema_version": SCHEMA_VERSION, "input_records": a.records.count(), "analyzed_records": a.sequences.count(),
            "skipped_records": _all(a.skips.select("record_index", "reason")), "options": dataclasses.asdict(a.options), "limitations": [r.limitation for r in a.limitations.toLocalIterator()],
        },
        "templates": templates, "defects": defects, "top_k": [r.defect_id for r in a.top_k.orderBy("rank").toLocalIterator()],
        "session_reports": [{**r, "events": events.get(r["session_key"], [])} for r in _all(a.session_reports)],
        "cache_metrics": _all(a.cache_metrics.orderBy("session_key", "sequence")),
    }
    if (total := a.prefix_reuse.first()) is not None:
        order = {r["session_key"]: i for i, r in enumerate(document["session_reports"])}
        document["prefix_reuse"] = {
            **_plain(total), "by_session": sorted(_all(a.prefix_reuse_by_session), key=lambda r: order[r["session_key"]]), "requests": _all(a.prefix_reuse_requests),
        }
    return document


def _sync_folder(path: Path) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def write_atomic(files: dict[Path, str]) -> None:
    """All texts are staged beside their targets and synced before any of them is put in place."""
    staged: list[tuple[str, Path]] = []
    try:
        for path, text in files.items():
            path = Path(path)
            fd, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
            staged.append((temporary, path))
            with os.fdopen(fd, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
        while staged:
            temporary, path = staged[0]
            os.replace(temporary, path)
            staged.pop(0)
            _sync_folder(path.parent)
    finally:
        for temporary, _ in staged:
            os.unlink(temporary)


def ensure_distinct(source: str | Path, *targets: str | Path) -> None:
    """Refuse to write over the input, also through links, or twice to one place."""
    known = [Path(source)]
    for t in map(Path, targets):
        for k in known:
            if (t.exists() and k.exists() and os.path.samefile(t, k)) or t.resolve() == k.resolve():
                raise DocumentError(f"{t} and {k} are the same file")
        known.append(t)


def write_document(path: str | Path, document: dict) -> None:
    write_atomic({Path(path): json.dumps(document, indent=2, ensure_ascii=False) + "\n"})


#: Fields of each object: mandatory, optional.
_FORMAT = {
    "document": ({"run", "templates", "defects", "top_k"}, {"session_reports", "cache_metrics", "prefix_reuse"}),
    "run": ({"schema_version", "input_records", "analyzed_records", "skipped_records", "options"}, {"limitations"}),
    "template": ({"id", "comparison_group", "member_request_ids", "medoid_request_id", "cohesion", "stable_spans", "slots"}, {"prefix_view"}),
    "defect": ({"id", "comparison_group", "template_id", "mismatch", "recovered_stable", "actual_prefix_bytes", "potential_prefix_bytes", "blocked_stable_bytes", "comparable_count", "affected_count", "confidence", "score", "insights"}, set()),
    "mismatch": ({"pattern", "variants", "facts"}, set()),
    "prefix_view": ({"node_count", "truncated", "nodes"}, set()),
}
#: Event fields that older files lack.
LATE_EVENT_FIELDS = {"previous_sequence": 0, "next_sequence": 0, "previous_pair_lcp_bytes": 0, "prefix_cut_bytes": 0, "previous_total_bytes": 0, "retained_prefix_bytes": 0, "abandoned_prefix_bytes": 0, "prefix_reuse_outlier": False, "prefix_reuse_ratio": None, "next_block_runs": ""}


def _fields(what: str, value: object) -> dict:
    need, may = _FORMAT[what]
    if not isinstance(value, dict):
        raise DocumentError(f"{what} is no object")
    if missing := need - value.keys():
        raise DocumentError(f"{what} lacks {', '.join(sorted(missing))}")
    if unknown := value.keys() - need - may:
        raise DocumentError(f"{what} has unknown {', '.join(sorted(unknown))}")
    return value


def read_document(path: str | Path) -> dict:
    """Parse strictly: unknown or missing fields are errors, sections and fields added later default."""
    try:
        document = json.loads(Path(path).read_text(encoding="utf-8"))
    except ValueError as e:
        raise DocumentError(f"{path} is no JSON: {e}") from None
    _fields("document", document)
    run = _fields("run", document["run"])
    if run["schema_version"] != SCHEMA_VERSION:
        raise DocumentError(f"schema version {run['schema_version']} is not {SCHEMA_VERSION}")
    try:
        AnalysisOptions(**run["options"])
    except TypeError as e:
        raise DocumentError(f"options: {e}") from None
    for t in document["templates"]:
        _fields("template", t)
        if "prefix_view" in t:
            view = _fields("prefix_view", t["prefix_view"])
            if view["node_count"] != len(view["nodes"]):
                raise DocumentError(f"template {t['id']}: node_count is not the number of nodes")
    for d in document["defects"]:
        _fields("defect", d)
        _fields("mismatch", d["mismatch"])
        for k in ("blocked_stable_bytes", "affected_count", "confidence"):
            if d["score"].get(k) != d[k]:
                raise DocumentError(f"defect {d['id']}: score and {k} disagree")
    for r in document.setdefault("session_reports", []):
        r["modern"] = any(e.get("prefix_reuse_ratio") is not None for e in r["events"])
        for e in r["events"]:
            for k, v in LATE_EVENT_FIELDS.items():
                e.setdefault(k, v)
    document.setdefault("cache_metrics", [])
    document.setdefault("prefix_reuse", None)
    run.setdefault("limitations", [])
    return document


_EVENT_DDL = (
    "session_key string, event_type string, previous_sequence bigint, next_sequence bigint, prev_request_id string, next_request_id string, lcp_units bigint, lcp_bytes bigint, previous_pair_lcp_bytes bigint, prefix_cut_bytes bigint, "
    "previous_total_bytes bigint, retained_prefix_bytes bigint, prefix_reuse_ratio double, abandoned_prefix_bytes bigint, prefix_reuse_outlier boolean, domain_changed boolean, next_total_bytes bigint, recomputed_bytes bigint, stable_after_switch_bytes bigint, next_block_runs string"
)
_REPORT_DDL = (
    "session_key string, endpoint_key string, model string, request_count bigint, append_count bigint, fork_count bigint, reorder_count bigint, reset_count bigint, context_refresh_count bigint, total_recomputed_bytes bigint, "
    "total_stable_after_switch_bytes bigint, total_prefix_cut_bytes bigint, avg_prefix_cut_bytes bigint, total_abandoned_prefix_bytes bigint, domain_change_count bigint, modern boolean"
)
_NODE_DDL = (
    f"template_id string, id string, kind string, source {S.LOC}, utf8_bytes bigint, support_count bigint, support_ratio double, excerpt string, member_request_ids array<string>, content_sample string, sequence_child string, "
    f"internal_children array<string>, variants array<{S.VARIANT_COUNT}>, defect_ids array<string>"
)
_TEMPLATE_DDL = f"id string, comparison_group {S.GROUP}, member_request_ids array<string>, medoid_request_id string, cohesion double, stable_spans array<{S.SPAN}>, slots array<{S.SLOT}>"
_METRIC_DDL = (
    "request_id string, session_key string, sequence bigint, captured_at string, source string, prompt_tokens bigint, cached_tokens bigint, miss_tokens bigint, output_tokens bigint, hit_rate double, hit_rate_delta double, basis string, "
    "estimated_lcp_bytes bigint, payload_bytes bigint, ttft_ms bigint, total_ms bigint"
)
_DEFECT_DDL = ", ".join(p.replace(": ", " ", 1) for p in [
    "rank: bigint", "id: string", f"comparison_group: {S.GROUP}", "template_id: string", "pattern: string", f"variants: array<{S.VARIANT}>", f"facts: array<{S.FACT}>", f"recovered_stable: {S.RECOVERED}",
    "actual_prefix_bytes: bigint", "potential_prefix_bytes: bigint", "blocked_stable_bytes: bigint", "comparable_count: bigint", "affected_count: bigint", "confidence: double", f"insights: array<{S.INSIGHT}>", "score: double",
])


def relations(spark: SparkSession, document: dict) -> dict[str, DataFrame]:
    """The document's parts as DataFrames."""

    def frame(rows: list[dict], ddl: str) -> DataFrame:
        return spark.read.schema(ddl).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 1)) if rows else spark.createDataFrame([], ddl)

    defects = [{**d, **d["mismatch"], "score": d["score"]["score"], "rank": i} for i, d in enumerate(document["defects"], 1)]
    return {
        "templates": frame(document["templates"], _TEMPLATE_DDL),
        "defects": frame(defects, _DEFECT_DDL),
        "top_k": frame([{"rank": i, "defect_id": d} for i, d in enumerate(document["top_k"], 1)], "rank int, defect_id string"),
        "prefix_nodes": frame([{"template_id": t["id"], **n} for t in document["templates"] if "prefix_view" in t for n in t["prefix_view"]["nodes"]], _NODE_DDL),
        "session_reports": frame([{k: v for k, v in r.items() if k != "events"} for r in document["session_reports"]], _REPORT_DDL),
        "session_events": frame([{"session_key": r["session_key"], **e} for r in document["session_reports"] for e in r["events"]], _EVENT_DDL),
        "cache_metrics": frame(document["cache_metrics"], _METRIC_DDL),
    }


def check_document(spark: SparkSession, document: dict) -> None:
    """DocumentError naming the first violated rule."""
    parts = relations(spark, document)
    modern = parts["session_reports"].where("modern").select("session_key")
    # files from before the measures existed have none to check
    checked = parts | {"session_events": parts["session_events"].join(modern, "session_key", "left_semi"), "session_reports": parts["session_reports"].join(modern, "session_key", "left_semi")}
    found = violations(checked, document["run"]["options"]["top_k"]).orderBy("rule", "subject").first()
    if found is not None:
        raise DocumentError(f"{found.rule}: {found.subject}")
    short = parts["session_reports"].join(parts["session_events"].groupBy("session_key").agg(F.count(F.lit(1)).alias("_n")), "session_key", "left").where(F.col("request_count") != F.coalesce("_n", F.lit(0)) + 1).first()
    if short is not None:
        raise DocumentError(f"a session has one request more than events: {short.session_key}")
