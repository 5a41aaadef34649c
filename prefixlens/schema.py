"""Schemas of the result relations, as Spark DDL."""

LOC = "struct<json_path: string, logical_scope: array<string>, unit_index: bigint, byte_start: bigint, byte_end: bigint, role: string>"
GROUP = "struct<time_window_key: string, endpoint_key: string, model: string, context_schema_key: string, agent_key: string, model_deployment_key: string, kv_namespace: string>"
SPAN = f"struct<source: {LOC}, utf8_bytes: bigint, support_count: bigint, excerpt: string>"
SLOT = f"struct<source: {LOC}, member_count: bigint, distinct_variant_count: bigint, confidence: double>"
VARIANT_COUNT = "struct<excerpt: string, count: bigint, count_known: boolean, is_missing: boolean>"
COORDINATE = (
    f"struct<id: string, ordinal: bigint, kind: string, source: {LOC}, utf8_bytes: bigint, support_count: bigint, support_ratio: double, excerpt: string, "
    f"content_sample: string, member_request_ids: array<string>, variants: array<{VARIANT_COUNT}>>"
)
EVIDENCE = f"struct<request_id: string, sources: array<{LOC}>, utf8_bytes: bigint, excerpt: string>"
VARIANT = f"struct<fingerprint: string, member_request_ids: array<string>, representative: {EVIDENCE}>"
FACT = "struct<kind: string, detail: string>"
INSIGHT = "struct<summary: string, detail: string>"
RECOVERED = f"struct<sources: array<{LOC}>, utf8_bytes: bigint, support_count: bigint, excerpt: string>"
CANDIDATE = (
    f"id: string, template_id: string, pattern: string, variants: array<{VARIANT}>, facts: array<{FACT}>, recovered_stable: {RECOVERED}, representative_member_id: string, "
    "actual_prefix_bytes: bigint, potential_prefix_bytes: bigint, blocked_stable_bytes: bigint, comparable_count: bigint, affected_count: bigint, confidence: double, "
    f"insights: array<{INSIGHT}>"
)
TEMPLATE = (
    f"id string, cohort_id string, comparison_group {GROUP}, medoid_request_id string, cohesion double, member_request_ids array<string>, stable_spans array<{SPAN}>, "
    f"slots array<{SLOT}>, coordinates array<{COORDINATE}>, coordinate_count bigint, candidates array<struct<{CANDIDATE}>>, limitation string"
)
BINDING = "template_id string, request_id string, ordinal bigint, coordinate_id string, digest string, byte_start bigint, byte_end bigint, member_unit bigint"
