"""The distributed template stage: cohorts in, one row per template with its spans, slots and candidates.

A cohort's members meet in one task. That is bounded: a cohort whose unit alignments alone pass the total
cell budget is turned away natively, before its members move, and every member costs cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from prefixlens import schema as S
from prefixlens.operators.align import BudgetError
from prefixlens.operators.diagnose import Diagnosis
from prefixlens.operators.projection import DOMAIN, SCHEMA
from prefixlens.operators.template import SLOT, Template, build
from prefixlens.options import AnalysisOptions

EXCERPT, SAMPLE = 160, 512
#: Members up to which a list of their ids' hashes goes to all executors.
LISTED = 1_000_000


def _source(unit: dict, index: int, span: tuple[int, int]) -> dict:
    return {"json_path": unit["json_path"], "logical_scope": [unit["role"]] if unit["role"] is not None else [], "unit_index": index, "byte_start": span[0], "byte_end": span[1], "role": unit["role"]}


def _counts(t: Template, c, slot, mode: str) -> tuple[dict[str, int], bool]:
    """How many members have each value of a slot.

    ``compat`` reads the centre's byte range in the member's unit of the same index; ``bindings`` follows
    the alignment.
    """
    counts: dict[str, int] = {}
    known = True
    for m in t.members:
        if mode == "bindings":
            b = m.bindings[c.ordinal]
            value = m.units[b.unit]["content"][slice(*b.chars)] if b is not None else None
        else:
            value = None
            if c.unit < len(m.units):
                raw = m.units[c.unit]["content"].encode()
                try:
                    value = raw[slice(*c.bytes)].decode() if c.bytes[1] <= len(raw) else None
                except UnicodeDecodeError:
                    value = None
            known = known and value is not None
        if value is not None:
            counts[value] = counts.get(value, 0) + 1
    return counts, known


def template_row(t: Template, options: AnalysisOptions, count_mode: str) -> dict:
    total = len(t.members)
    coordinates = []
    slot_at = {(s.unit, s.bytes): s for s in t.slots}
    slot_from = {}
    for s in t.slots:
        slot_from.setdefault((s.unit, s.bytes[0]), s)
    for c in t.coordinates[: options.prefix_view_max_nodes]:
        text = t.units[c.unit]["content"][slice(*c.chars)]
        variants = None
        slot = slot_at.get((c.unit, c.bytes)) or slot_from.get((c.unit, c.bytes[0]))
        if c.kind == SLOT and slot is not None:
            counts, known = _counts(t, c, slot, count_mode)
            variants = [{"excerpt": v[: options.prefix_view_excerpt_bytes], "count": counts.get(v, 0), "count_known": known, "is_missing": False} for v in slot.values]
            if total > c.support:
                variants.append({"excerpt": "", "count": total - c.support, "count_known": True, "is_missing": True})
        coordinates.append({
            "id": c.id, "ordinal": c.ordinal, "kind": "dynamic" if c.kind == SLOT else "stable", "source": _source(t.units[c.unit], c.unit, c.bytes), "utf8_bytes": c.size,
            "support_count": c.support, "support_ratio": c.support / max(total, 1), "excerpt": text[: options.prefix_view_excerpt_bytes], "content_sample": None if c.kind == SLOT else text[:SAMPLE],
            "member_request_ids": sorted(m.request_id for m in t.members if m.bindings[c.ordinal] is not None), "variants": variants,
        })
    group = {"time_window_key": str(t.domain["time_window_key"]), "context_schema_key": SCHEMA} | {k: t.domain[k] for k in DOMAIN[1:]}
    return {
        "id": t.id, "cohort_id": t.cohort_id, "comparison_group": group, "medoid_request_id": t.medoid, "cohesion": t.cohesion,
        "member_request_ids": sorted(m.request_id for m in t.members),
        "stable_spans": [{"source": _source(t.units[s.unit], s.unit, s.bytes), "utf8_bytes": s.bytes[1] - s.bytes[0], "support_count": s.support, "excerpt": t.units[s.unit]["content"][slice(*s.chars)][:EXCERPT]} for s in t.spans],
        "slots": [{"source": _source(t.units[s.unit], s.unit, s.bytes), "member_count": s.support, "distinct_variant_count": s.distinct, "confidence": t.cohesion} for s in t.slots],
        "coordinates": coordinates, "coordinate_count": len(t.coordinates), "candidates": Diagnosis(t, options).candidates(), "limitation": None,
    }


_KEYS = ("cohort_id", "medoid_request_id", "cohesion", "request_id", *DOMAIN)


def _cohort_rows(cohorts: DataFrame, seqs: DataFrame, options: AnalysisOptions) -> tuple[DataFrame, DataFrame]:
    """(members with units, placed by cohort; cohorts whose unit alignments pass the budget)."""
    members = cohorts.where(F.col("cohort_id").isNotNull())
    listed = members.select(F.xxhash64("request_id").alias("_h")).distinct()
    if members.count() <= LISTED:
        # units of other requests stay where they are
        seqs = seqs.join(F.broadcast(listed), F.xxhash64(seqs["request_id"]) == listed["_h"], "left_semi")
    joined = members.select("cohort_id", "medoid_request_id", "cohesion", "request_id", *DOMAIN).join(seqs.select("request_id", "units"), "request_id")
    centre = joined.where(F.col("request_id") == F.col("medoid_request_id")).select("cohort_id", F.size("units").alias("n"))
    cost = joined.select("cohort_id", F.size("units").alias("m")).join(centre, "cohort_id").groupBy("cohort_id").agg(F.sum((F.col("m") + 1).cast("bigint") * (F.col("n") + 1)).alias("cells"))
    over = cost.where(F.col("cells") > options.max_total_alignment_cells)
    fits = joined.join(over.select("cohort_id"), "cohort_id", "left_anti").select(*_KEYS, "units")
    return fits.repartition("cohort_id").sortWithinPartitions("cohort_id", "request_id"), over


def _by_cohort(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[str, list[dict]]]]]:
    """Consecutive rows of one cohort, over batch borders."""
    head, members = None, []
    for b in batches:
        for row in b.to_pylist():
            if head is not None and row["cohort_id"] != head["cohort_id"]:
                yield head, members
                members = []
            head = {k: row[k] for k in _KEYS}
            members.append((row["request_id"], row["units"]))
    if head is not None:
        yield head, members


def extract_templates(cohorts: DataFrame, seqs: DataFrame, options: AnalysisOptions = AnalysisOptions(), count_mode: str = "compat") -> DataFrame:
    """schema.TEMPLATE rows; a cohort over budget has its id and a limitation only."""
    placed, over = _cohort_rows(cohorts, seqs, options)
    arrow = to_arrow_schema(T._parse_datatype_string(S.TEMPLATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, members in _by_cohort(batches):
            try:
                t = build(head["cohort_id"], {k: head[k] for k in DOMAIN}, head["medoid_request_id"], head["cohesion"], members, options)
                row = template_row(t, options, count_mode)
            except BudgetError as e:
                row = {"cohort_id": head["cohort_id"], "limitation": f"template {head['cohort_id']}: {e}"}
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    done = placed.mapInArrow(run, S.TEMPLATE)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in done.schema.fields if f.name not in ("cohort_id", "limitation")]
    cut = over.select("cohort_id", F.format_string("template %s: total alignment cell budget exhausted: required %d, limit %d", "cohort_id", "cells", F.lit(options.max_total_alignment_cells)).alias("limitation"), *nothing)
    return done.unionByName(cut)


def extract_bindings(cohorts: DataFrame, seqs: DataFrame, options: AnalysisOptions = AnalysisOptions()) -> DataFrame:
    """The sparse matrix member x coordinate in long form: schema.BINDING rows; a gap has no digest."""
    placed, _ = _cohort_rows(cohorts, seqs, options)
    names = [c.split()[0] for c in S.BINDING.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in S.BINDING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, members in _by_cohort(batches):
            try:
                t = build(head["cohort_id"], {k: head[k] for k in DOMAIN}, head["medoid_request_id"], head["cohesion"], members, options)
            except BudgetError:
                continue
            rows = [
                (t.id, m.request_id, c.ordinal, c.id, *((b.digest, *b.bytes, b.unit) if b is not None else (None,) * 4))
                for m in t.members for c, b in zip(t.coordinates, m.bindings)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return placed.mapInArrow(run, S.BINDING)
