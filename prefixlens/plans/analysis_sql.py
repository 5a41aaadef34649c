"""SQL of the analysis queries, written from their definitions for another engine."""

from __future__ import annotations

import re

from prefixlens.options import AnalysisOptions
from prefixlens.plans.problems import SOUND_SQL, _trim

LIMITS = AnalysisOptions()
_RFC = r"(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):([0-5]\d):([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)"
_INSTANT = f"CASE WHEN regexp_full_match(captured_at, '{_RFC}') THEN try_cast(captured_at AS TIMESTAMPTZ) END"
_NANOS = (
    f"CASE WHEN regexp_full_match(captured_at, '{_RFC}') THEN epoch_us(try_cast(regexp_replace(captured_at, '\\.\\d+', '') AS TIMESTAMPTZ))::HUGEINT * 1000 "
    "+ coalesce(rpad(substr(regexp_extract(captured_at, '\\.(\\d+)', 1), 1, 9), 9, '0')::BIGINT, 0) END"
)


def _bad(path: str, column: str) -> str:
    """Whether an optional key is present but no string, and whether it is blank."""
    return f"json_type(j, '{path}') NOT IN ('NULL', 'VARCHAR')" if column == "type" else f"json_type(j, '{path}') = 'VARCHAR' AND {_trim(f'''(j->>'{path}')''')} IS NULL"


_KEYS = ("agent_key", "model_deployment_key", "kv_namespace")
_KEY_RULES = " ".join(f"WHEN {_bad(f'$.comparison.{k}', 'type')} THEN 'InvalidComparisonKey' WHEN {_bad(f'$.comparison.{k}', 'blank')} THEN 'EmptyComparisonKey'" for k in _KEYS)
_KEY_FIELDS = " ".join(f"WHEN {_bad(f'$.comparison.{k}', 'type')} OR ({_bad(f'$.comparison.{k}', 'blank')}) THEN '{k}'" for k in _KEYS)
#: Requests that load, and of these the ones that project, with the model and the trimmed session.
_PROJECTABLE = f"""
{SOUND_SQL},
loads AS (SELECT input_line, {_trim('r.session_key')} AS session_key, captured_at FROM requests r
          WHERE {_trim('comparison.endpoint_key')} IS NOT NULL AND json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload::JSON END) = 'OBJECT'
            AND (comparison.agent_key IS NULL OR {_trim('comparison.agent_key')} IS NOT NULL) AND (comparison.model_deployment_key IS NULL OR {_trim('comparison.model_deployment_key')} IS NOT NULL)
            AND (comparison.kv_namespace IS NULL OR {_trim('comparison.kv_namespace')} IS NOT NULL) AND (r.session_key IS NULL OR {_trim('r.session_key')} IS NOT NULL)),
fits AS (SELECT input_line, session_key, captured_at, p FROM loads JOIN sound USING (input_line)
         WHERE json_type(p, '$.model') = 'VARCHAR' AND p->>'$.model' <> '' AND ({_INSTANT}) IS NOT NULL)
"""
_FIELD_UNITS = " UNION ALL ".join(
    f"SELECT input_line, {kind} AS kind FROM msg SEMI JOIN fits USING (input_line) WHERE json_exists(m, '$.{f}')" + (" AND json_type(m, '$.content') <> 'ARRAY'" if f == "content" else "")
    for f, kind in (("name", "'visible_text'"), ("content", "'visible_text'"), ("function_call", "'tool_call'"), ("tool_calls", "'tool_call'"), ("refusal", "'visible_text'"), ("tool_call_id", "CASE WHEN json_type(m, '$.role') = 'VARCHAR' AND m->>'$.role' = 'tool' THEN 'tool_result' ELSE 'visible_text' END"))
)
_RATED = f"""
once AS (SELECT DISTINCT input_line, captured_at, session_key, response_usage AS u FROM corpus_records),
rated AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY coalesce(captured_at, ''), input_line) AS sequence,
                 CASE WHEN u IS NOT NULL AND u.prompt_tokens > 0 THEN least(u.cached_tokens, u.prompt_tokens)::DOUBLE / u.prompt_tokens ELSE 0.0 END AS hit_rate FROM once)
"""

SQL = {
    "line_skips": f"""
        WITH p AS (SELECT input_line, line, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM raw_lines),
        c AS (SELECT input_line, CASE
            WHEN line IS NULL OR regexp_full_match(line, '[ \\t\\r\\f]*') THEN 'EmptyLine' WHEN strlen(line) > {LIMITS.max_payload_bytes} THEN 'RecordTooLarge'
            WHEN j IS NULL THEN 'InvalidJson' WHEN json_type(j) <> 'OBJECT' THEN 'RecordNotObject' WHEN NOT json_exists(j, '$.payload') THEN 'MissingPayload'
            WHEN json_type(j, '$.payload') <> 'OBJECT' THEN 'PayloadNotObject' WHEN coalesce(json_type(j, '$.comparison'), '') <> 'OBJECT' THEN 'MissingComparison'
            WHEN coalesce(json_type(j, '$.comparison.endpoint_key'), '') <> 'VARCHAR' THEN 'MissingEndpointKey'
            WHEN {_trim("(j->>'$.comparison.endpoint_key')")} IS NULL THEN 'EmptyEndpointKey' {_KEY_RULES}
            WHEN {_bad('$.session_key', 'type')} THEN 'InvalidSessionKey' WHEN {_bad('$.session_key', 'blank')} THEN 'EmptySessionKey' END AS code,
            CASE {_KEY_FIELDS} END AS f FROM p)
        SELECT input_line AS record_index, code, CASE WHEN code IN ('InvalidComparisonKey', 'EmptyComparisonKey') THEN f END AS field FROM c WHERE code IS NOT NULL""",
    "domain_windows": f"""
        SELECT (floor(epoch({_INSTANT}) / 3600) * 3600)::BIGINT AS time_window_key, comparison.endpoint_key AS endpoint_key, count(*) AS records
        FROM corpus_records WHERE ({_INSTANT}) IS NOT NULL GROUP BY ALL""",
    "cache_metrics_reported": f"""
        WITH {_RATED}
        SELECT input_line, session_key, sequence, u.prompt_tokens AS prompt_tokens, least(u.cached_tokens, u.prompt_tokens) AS cached_tokens,
               CASE WHEN u IS NOT NULL THEN u.prompt_tokens - least(u.cached_tokens, u.prompt_tokens) END AS miss_tokens, u.completion_tokens AS output_tokens, hit_rate,
               hit_rate - lag(hit_rate) OVER (PARTITION BY session_key ORDER BY sequence) AS hit_rate_delta,
               CASE WHEN u IS NULL THEN 'estimated' ELSE 'reported' END AS basis, u.ttft_ms AS ttft_ms, u.total_ms AS total_ms FROM rated""",
    "usage_by_session": f"""
        WITH {_RATED}
        SELECT session_key, sum(least(u.cached_tokens, u.prompt_tokens))::BIGINT AS cached_tokens, sum(u.prompt_tokens)::BIGINT AS prompt_tokens, count(*) AS reported_rows,
               CASE WHEN sum(u.prompt_tokens) > 0 THEN sum(least(u.cached_tokens, u.prompt_tokens))::DOUBLE / sum(u.prompt_tokens) ELSE 0.0 END AS hit_rate
        FROM rated WHERE u IS NOT NULL AND session_key IS NOT NULL GROUP BY 1""",
    "session_turns": f"""
        WITH {_PROJECTABLE}
        SELECT session_key, row_number() OVER (PARTITION BY session_key ORDER BY {_NANOS}, input_line) AS sequence, input_line FROM fits WHERE session_key IS NOT NULL""",
    "unit_counts": f"""
        WITH {_PROJECTABLE},
        u AS (SELECT input_line, 'structural' AS kind FROM fits, range(2) UNION ALL SELECT input_line, 'structural' FROM fits, range(2) WHERE json_type(p, '$.tools') = 'ARRAY'
              UNION ALL SELECT input_line, 'tool_definition' FROM tl SEMI JOIN fits USING (input_line) UNION ALL SELECT input_line, 'role' FROM msg SEMI JOIN fits USING (input_line)
              UNION ALL SELECT input_line, 'visible_text' FROM blk SEMI JOIN fits USING (input_line) UNION ALL {_FIELD_UNITS})
        SELECT input_line, kind, count(*) AS units FROM u GROUP BY ALL""",
    "tool_overlap": f"""
        WITH {SOUND_SQL},
        n AS (SELECT input_line, list_distinct(list(CASE WHEN json_type(t, '$.name') = 'VARCHAR' THEN t->>'$.name' WHEN json_type(t, '$.function.name') = 'VARCHAR' THEN t->>'$.function.name' END)) AS names FROM tl GROUP BY 1),
        s AS (SELECT {_trim('session_key')} AS session_key, input_line, names FROM requests JOIN n USING (input_line) WHERE len(names) > 0 AND {_trim('session_key')} IS NOT NULL),
        o AS (SELECT *, row_number() OVER w AS sequence, lag(names) OVER w AS before FROM s WINDOW w AS (PARTITION BY session_key ORDER BY input_line))
        SELECT session_key, sequence, input_line, len(list_intersect(names, before))::DOUBLE / len(list_distinct(list_concat(names, before))) AS jaccard FROM o WHERE before IS NOT NULL""",
}

#: Canonical text of JSON values: ``vals`` (v JSON) to ``canon`` (v as text, c). Nodes are listed, then their
#: tokens are put together in the order of their paths; a path that ends in the last code point closes a node.
_CANON = """
root AS (SELECT row_number() OVER () AS vid, v FROM (SELECT DISTINCT v::VARCHAR AS v FROM vals)),
node(vid, path, item, v, kind) AS (
    SELECT vid, []::VARCHAR[], '', v::JSON, json_type(v::JSON) FROM root UNION ALL
    SELECT n.vid, list_append(n.path, CASE WHEN n.kind = 'OBJECT' THEN e.key ELSE lpad(e.key, 9, '0') END), CASE WHEN n.kind = 'OBJECT' THEN to_json(e.key)::VARCHAR || ':' ELSE '' END, e.value, e.type
    FROM node n, json_each(n.v) e WHERE n.kind IN ('OBJECT', 'ARRAY')),
token AS (
    SELECT vid, path, CASE WHEN len(path) = 0 OR row_number() OVER (PARTITION BY vid, path[:-2] ORDER BY path[-1]) = 1 THEN '' ELSE ',' END || item
                      || CASE kind WHEN 'OBJECT' THEN '{' WHEN 'ARRAY' THEN '[' ELSE v::VARCHAR END AS x FROM node
    UNION ALL SELECT vid, list_append(path, chr(1114111)), CASE kind WHEN 'OBJECT' THEN '}' ELSE ']' END FROM node WHERE kind IN ('OBJECT', 'ARRAY')),
canon AS (SELECT v, c FROM root JOIN (SELECT vid, string_agg(x, '' ORDER BY path) AS c FROM token GROUP BY vid) USING (vid))
"""
_RECORD_PARTS = ", ".join(
    f"'\"{k}\":' || {v}"
    for k, v in (
        ("captured_at", "to_json(r.captured_at)::VARCHAR"),
        ("comparison", "'{' || array_to_string(list_filter([" + ", ".join(f"'\"{k}\":' || to_json(r.comparison.{k})::VARCHAR" for k in ("agent_key", "endpoint_key", "kv_namespace", "model_deployment_key")) + "], lambda x: x IS NOT NULL), ',') || '}'"),
        ("payload", "c"),
        ("session_key", "to_json(r.session_key)::VARCHAR"),
        ("source", "to_json(r.source)::VARCHAR"),
    )
)
#: Loaded records with their id, to be used with canon over the payloads.
_IDS = f"""
hashed AS (SELECT input_line, sha256('{{' || array_to_string(list_filter([{_RECORD_PARTS}], lambda x: x IS NOT NULL), ',') || '}}') AS h
           FROM requests r JOIN loads USING (input_line) JOIN canon ON canon.v = r.payload::JSON::VARCHAR),
ids AS (SELECT input_line, h || ':' || row_number() OVER (PARTITION BY h ORDER BY input_line) - 1 AS request_id FROM hashed)
"""
_WHOLE = "vals AS (SELECT payload::JSON AS v FROM requests SEMI JOIN loads USING (input_line))"

# units of the projected requests, ordered by (s1, s2, s3, s4)
_FIELDS = (("name", "'visible_text'"), ("content", "'visible_text'"), ("function_call", "'tool_call'"), ("tool_calls", "'tool_call'"), ("tool_call_id", "CASE WHEN role = 'tool' THEN 'tool_result' ELSE 'visible_text' END"), ("refusal", "'visible_text'"))
_NAME = lambda x: f"coalesce(CASE WHEN json_type({x}, '$.name') = 'VARCHAR' THEN {x}->>'$.name' END, CASE WHEN json_type({x}, '$.function.name') = 'VARCHAR' THEN {x}->>'$.function.name' END)"
_TEXT_KEYS = ("text", "input_text", "output_text", "content")
_MARK = lambda s1, name, x: f"SELECT input_line, {s1} AS s1, 0 AS s2, 0 AS s3, 0 AS s4, 'structural' AS kind, '{name}' AS alignment_key, '{name}' AS own, NULL::JSON AS v, '$.{x}' AS json_path, FALSE AS ranged, NULL::BIGINT AS message_index, NULL AS role, NULL AS tool_identity, '{x}' AS collection, '$.{x}' AS parent_json_path, NULL::BIGINT AS element_index, NULL::BIGINT AS content_block_index FROM fits"
_ONE_FIELD = " UNION ALL ".join(
    f"""SELECT input_line, 4, i, {n}, 0, {kind}, 'message:' || role || ':{f}', CASE WHEN json_type(m, '$.{f}') = 'VARCHAR' THEN m->>'$.{f}' END, m->'$.{f}', '$.messages[' || i || '].{f}',
        {kind} = 'visible_text' AND json_type(m, '$.{f}') = 'VARCHAR', i, role, CASE WHEN {kind} <> 'visible_text' THEN {_NAME(f"(m->'$.{f}')")} END, 'messages', '$.messages', i, NULL
        FROM said WHERE json_exists(m, '$.{f}')""" + (" AND json_type(m, '$.content') <> 'ARRAY'" if f == "content" else "")
    for n, (f, kind) in enumerate(_FIELDS, 1)
)
_BLOCK_KEY = "CASE WHEN json_type(b) = 'OBJECT' THEN CASE " + " ".join(f"WHEN json_type(b, '$.{k}') = 'VARCHAR' THEN '{k}'" for k in _TEXT_KEYS) + " END END"
_UNITS = f"""
said AS (SELECT input_line, i, m, CASE WHEN json_type(m, '$.role') = 'VARCHAR' THEN m->>'$.role' ELSE 'unknown' END AS role FROM msg SEMI JOIN fits USING (input_line)),
parts AS (SELECT s.input_line, s.i, s.role, j, b, {_BLOCK_KEY} AS k FROM blk JOIN said s USING (input_line, i)),
raw AS ({_MARK(1, 'tools:start', 'tools')} WHERE json_type(p, '$.tools') = 'ARRAY' UNION ALL {_MARK(2, 'tools:end', 'tools')} WHERE json_type(p, '$.tools') = 'ARRAY'
    UNION ALL {_MARK(3, 'messages:start', 'messages')} UNION ALL {_MARK(5, 'messages:end', 'messages')}
    UNION ALL SELECT input_line, 1, 1, i, 0, 'tool_definition', 'tool-definition', NULL, t, '$.tools[' || i || ']', FALSE, NULL, NULL, {_NAME('t')}, 'tools', '$.tools', i, NULL FROM tl SEMI JOIN fits USING (input_line)
    UNION ALL SELECT input_line, 4, i, 0, 0, 'role', 'message:role', role, NULL, '$.messages[' || i || '].role', FALSE, i, role, NULL, 'messages', '$.messages', i, NULL FROM said
    UNION ALL SELECT input_line, 4, i, 2, j, 'visible_text', 'message:' || role || ':content-block:' || CASE WHEN json_type(b, '$.type') = 'VARCHAR' THEN b->>'$.type' ELSE 'unknown' END,
        CASE WHEN json_type(b) = 'VARCHAR' THEN b->>'$' WHEN k IS NOT NULL THEN json_extract_string(b, '$.' || k) END, b, '$.messages[' || i || '].content[' || j || ']' || coalesce('.' || k, ''),
        json_type(b) = 'VARCHAR' OR k IS NOT NULL, i, role, NULL, 'content_blocks', '$.messages[' || i || '].content', i, j FROM parts
    UNION ALL {_ONE_FIELD}),
vals AS (SELECT v FROM raw WHERE own IS NULL),
{_CANON},
unit AS (SELECT raw.* EXCLUDE (own, v), coalesce(own, c) AS content, row_number() OVER (PARTITION BY input_line ORDER BY s1, s2, s3, s4) - 1 AS unit_index FROM raw LEFT JOIN canon ON own IS NULL AND canon.v = raw.v::VARCHAR)
"""
#: Consecutive requests of sessions with their units as lists, and what they have in common.
_LCP = lambda a, b: f"coalesce(list_min(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] <> {b}[i])) - 1, least(len({a}), len({b})))"
_SUM = lambda a: f"coalesce(list_sum({a}), 0)::BIGINT"
_CONTENT = "kind IN ('visible_text', 'tool_definition', 'tool_call', 'tool_result')"
_TURNS = f"""
arrays AS (SELECT input_line, list(sha256(concat_ws(chr(1), kind, alignment_key, collection, content)) ORDER BY unit_index) AS u, list(strlen(content) ORDER BY unit_index) AS n,
                  list(sha256(concat_ws(chr(1), kind, alignment_key, collection, content)) ORDER BY unit_index) FILTER ({_CONTENT}) AS cu, list(strlen(content) ORDER BY unit_index) FILTER ({_CONTENT}) AS cn
           FROM unit GROUP BY 1),
numbered AS (SELECT input_line, {_CONTENT} AS counted, substr(sha256(content), 1, 8) AS d, unit_index FROM unit),
marks AS (SELECT *, CASE WHEN d = lag(d) OVER (PARTITION BY input_line ORDER BY unit_index) THEN 0 ELSE 1 END AS new FROM numbered WHERE counted),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY input_line ORDER BY unit_index) AS g FROM marks),
runs AS (SELECT input_line, string_agg(d || 'x' || c, '/' ORDER BY g) AS runs FROM (SELECT input_line, g, any_value(d) AS d, count(*) AS c FROM grouped GROUP BY 1, 2) GROUP BY 1),
turn AS (SELECT f.input_line, f.session_key, f.p->>'$.model' AS model, {', '.join(f"{_trim(f'r.comparison.{k}')} AS {k}" for k in ('endpoint_key', 'model_deployment_key', 'agent_key', 'kv_namespace'))},
                u, n, coalesce(cu, []) AS cu, coalesce(cn, []) AS cn, coalesce(runs, '') AS runs, request_id, row_number() OVER (PARTITION BY f.session_key ORDER BY {_NANOS.replace('captured_at', 'f.captured_at')}, f.input_line) AS seq
         FROM fits f JOIN requests r USING (input_line) JOIN arrays USING (input_line) LEFT JOIN runs USING (input_line) JOIN ids USING (input_line) WHERE f.session_key IS NOT NULL),
pair AS (SELECT b.*, a.request_id AS prev_request_id, a.u AS pu, a.n AS pn, a.cu AS pcu, a.cn AS pcn, a.endpoint_key AS prev_endpoint_key, a.model AS prev_model, {_LCP('a.u', 'b.u')} AS lcp_units, {_LCP('a.cu', 'b.cu')} AS kept,
                {' OR '.join(f'a.{k} IS DISTINCT FROM b.{k}' for k in ('endpoint_key', 'model', 'model_deployment_key', 'agent_key', 'kv_namespace'))} AS domain_changed
         FROM turn a JOIN turn b ON a.session_key = b.session_key AND a.seq + 1 = b.seq),
rest AS (SELECT *, pu[lcp_units + 1 :] AS old, pn[lcp_units + 1 :] AS size, u[lcp_units + 1 :] AS fresh FROM pair),
cut AS (SELECT session_key, seq, coalesce(max(list_sum(size[: k])), 0)::BIGINT AS stable_after_switch_bytes
        FROM (SELECT session_key, seq, size, {_LCP('old', 'tail')} AS k FROM (SELECT session_key, seq, old, size, unnest(list_transform(range(1, len(fresh) + 1), lambda i: fresh[i :])) AS tail FROM rest)) GROUP BY 1, 2),
measured AS (SELECT rest.*, {_SUM('pn[: lcp_units]')} AS lcp_bytes, {_SUM('pcn')} AS previous_total_bytes, {_SUM('pcn[: kept]')} AS retained_prefix_bytes, {_SUM('n')} AS next_total_bytes FROM rest),
events AS (SELECT session_key,
    CASE WHEN lcp_units = len(pu) OR (kept = len(pcu) AND len(cu) > len(pcu)) THEN 'append'
         WHEN len(pcu) > 0 AND len(pcu) = len(cu) AND len(list_distinct(pcu)) = len(pcu) AND list_sort(pcu) = list_sort(cu) THEN 'reorder' WHEN kept = 0 THEN 'reset' ELSE 'fork' END AS event_type,
    seq - 1 AS previous_sequence, seq AS next_sequence, prev_request_id, request_id AS next_request_id, lcp_units, lcp_bytes, coalesce(lag(lcp_bytes) OVER w, 0) AS previous_pair_lcp_bytes,
    greatest(coalesce(lag(lcp_bytes) OVER w, 0) - lcp_bytes, 0) AS prefix_cut_bytes, previous_total_bytes, retained_prefix_bytes,
    CASE WHEN previous_total_bytes > 0 THEN retained_prefix_bytes::DOUBLE / previous_total_bytes END AS prefix_reuse_ratio, previous_total_bytes - retained_prefix_bytes AS abandoned_prefix_bytes,
    retained_prefix_bytes < previous_total_bytes AS prefix_reuse_outlier, domain_changed, next_total_bytes, greatest(next_total_bytes - lcp_bytes, 0) AS recomputed_bytes,
    coalesce(stable_after_switch_bytes, 0) AS stable_after_switch_bytes, runs AS next_block_runs, prev_endpoint_key, prev_model
    FROM measured LEFT JOIN cut USING (session_key, seq) WINDOW w AS (PARTITION BY session_key ORDER BY seq))
"""
#: Payloads keep their canonical text without the reserved usage object.
_IDENTIFIED = f"WITH RECURSIVE {_PROJECTABLE}, {_WHOLE}, {_CANON}, {_IDS}"
_PROJECTED = f"WITH RECURSIVE {_PROJECTABLE}, {_UNITS}"


def _renamed(sql: str, by: int = 2) -> str:
    """The canonical form once more in one query, under other names."""
    for name in ("vals", "root", "node", "token", "canon"):
        sql = re.sub(rf"\b{name}\b", f"{name}{by}", sql)
    return sql


_IDS_TOO = ", ".join((_renamed(_WHOLE), _renamed(_CANON), _renamed(_IDS)))
_EVENTS = f"{_PROJECTED}, {_IDS_TOO}, {_TURNS}"
_REPORTS = """
reports AS (SELECT session_key, arg_min(prev_endpoint_key, previous_sequence) AS endpoint_key, arg_min(prev_model, previous_sequence) AS model, count(*) + 1 AS request_count,
    count(*) FILTER (event_type = 'append') AS append_count, count(*) FILTER (event_type = 'fork') AS fork_count, count(*) FILTER (event_type = 'reorder') AS reorder_count, count(*) FILTER (event_type = 'reset') AS reset_count,
    count(*) FILTER (prefix_reuse_outlier) AS context_refresh_count, sum(recomputed_bytes)::BIGINT AS total_recomputed_bytes, sum(stable_after_switch_bytes)::BIGINT AS total_stable_after_switch_bytes,
    sum(prefix_cut_bytes)::BIGINT AS total_prefix_cut_bytes, (sum(prefix_cut_bytes) // count(*))::BIGINT AS avg_prefix_cut_bytes, sum(abandoned_prefix_bytes)::BIGINT AS total_abandoned_prefix_bytes,
    count(*) FILTER (domain_changed) AS domain_change_count FROM events GROUP BY 1)
"""
_RATIO = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END"
_REUSE = f"""
reuse AS (SELECT session_key, count(*) AS request_pairs, sum(lcp_bytes)::BIGINT AS lcp_bytes, sum(next_total_bytes)::BIGINT AS context_bytes, {_RATIO('sum(lcp_bytes)', 'sum(next_total_bytes)')} AS ratio,
                 sum(greatest(lcp_bytes, least(lcp_bytes, next_total_bytes)))::BIGINT AS potential_lcp_bytes, 0::BIGINT AS gain_bytes FROM events GROUP BY 1)
"""
_TOTAL = f"""
total AS (SELECT sessions, request_pairs, lcp_bytes, context_bytes, {_RATIO('lcp_bytes', 'context_bytes')} AS ratio, potential_lcp_bytes, {_RATIO('potential_lcp_bytes', 'context_bytes')} AS potential_ratio,
                 potential_lcp_bytes - lcp_bytes AS gain_bytes, recoverable_stable_bytes, sessions_with_prefix_cut FROM
    (SELECT sum(request_pairs)::BIGINT AS request_pairs, sum(lcp_bytes)::BIGINT AS lcp_bytes, sum(context_bytes)::BIGINT AS context_bytes, sum(potential_lcp_bytes)::BIGINT AS potential_lcp_bytes FROM reuse),
    (SELECT count(*) AS sessions, sum(total_stable_after_switch_bytes)::BIGINT AS recoverable_stable_bytes, count(*) FILTER (total_prefix_cut_bytes > 0) AS sessions_with_prefix_cut FROM reports) WHERE request_pairs > 0)
"""
_SESSIONS = """
least_ AS (SELECT session_key, min(prefix_reuse_ratio) AS least_reuse, min(previous_sequence) FILTER (prefix_reuse_outlier OR (prefix_reuse_ratio IS NULL AND event_type <> 'append')) AS first_refresh_from FROM events GROUP BY 1),
listed_sessions AS (SELECT session_key, endpoint_key, model, request_count, context_refresh_count AS refreshes, total_abandoned_prefix_bytes AS abandoned_bytes, least_reuse, first_refresh_from, first_refresh_from + 1 AS first_refresh_to,
    append_count, fork_count, reorder_count, reset_count, domain_change_count, avg_prefix_cut_bytes FROM reports JOIN least_ USING (session_key))
"""
# usage of a payload: a total that is no whole number means none, and does not fall back to the other name
_WHOLE_NUMBER = lambda x: f"CASE WHEN json_type(p, '$._response_usage.{x}') = 'UBIGINT' THEN least((p->>'$._response_usage.{x}')::UBIGINT, 4294967295)::BIGINT END"
_MILLIS = lambda x: f"CASE WHEN json_type(p, '$._response_usage.{x}') = 'UBIGINT' AND (p->>'$._response_usage.{x}')::UBIGINT < 9223372036854775808 THEN (p->>'$._response_usage.{x}')::BIGINT END"
_EITHER = lambda a, b: f"CASE WHEN json_exists(p, '$._response_usage.{a}') THEN {_WHOLE_NUMBER(a)} ELSE {_WHOLE_NUMBER(b)} END"
_CACHE = f"""
loaded AS (SELECT input_line, l.session_key, r.captured_at, source, payload::JSON AS p FROM loads l JOIN requests r USING (input_line)),
bare AS (SELECT input_line, CASE WHEN json_exists(p, '$._response_usage') THEN json_merge_patch(p, '{{"_response_usage": null}}')::VARCHAR ELSE p::VARCHAR END AS v FROM loaded),
used AS (SELECT input_line, {_EITHER('prompt_tokens', 'input_tokens')} AS prompt, coalesce({_WHOLE_NUMBER('cached_tokens')}, 0) AS cached, coalesce({_EITHER('completion_tokens', 'output_tokens')}, 0) AS output_tokens, {_MILLIS('ttft_ms')} AS ttft_ms, {_MILLIS('total_ms')} AS total_ms
         FROM loaded WHERE json_type(p, '$._response_usage') = 'OBJECT'),
vals AS (SELECT v FROM bare), {_CANON},
placed AS (SELECT l.input_line, l.session_key, l.captured_at, l.source, request_id, u.* EXCLUDE (input_line), hex(encode(c)) AS h, row_number() OVER w AS sequence, lag(hex(encode(c))) OVER w AS ph
           FROM loaded l JOIN ids USING (input_line) JOIN bare USING (input_line) JOIN canon ON canon.v = bare.v LEFT JOIN used u ON u.input_line = l.input_line AND u.prompt IS NOT NULL
           WINDOW w AS (PARTITION BY l.session_key ORDER BY coalesce(l.captured_at, ''), l.input_line)),
halving(input_line, lo, hi) AS (SELECT input_line, 0, least(length(h), length(ph)) // 2 FROM placed WHERE ph IS NOT NULL UNION ALL
    SELECT input_line, CASE WHEN same THEN mid ELSE lo END, CASE WHEN same THEN hi ELSE mid - 1 END FROM
    (SELECT s.input_line, lo, hi, (lo + hi + 1) // 2 AS mid, substr(h, 1, 2 * ((lo + hi + 1) // 2)) = substr(ph, 1, 2 * ((lo + hi + 1) // 2)) AS same FROM halving s JOIN placed USING (input_line) WHERE lo < hi)),
shared AS (SELECT input_line, lo AS lcp FROM halving WHERE lo = hi),
rated AS (SELECT *, CASE WHEN prompt IS NOT NULL THEN {_RATIO('least(cached, prompt)', 'prompt')} ELSE coalesce(lcp, 0)::DOUBLE / (length(h) // 2) END AS hit_rate FROM placed LEFT JOIN shared USING (input_line)),
metrics AS (SELECT request_id, session_key, sequence, captured_at, source, prompt AS prompt_tokens, CASE WHEN prompt IS NOT NULL THEN least(cached, prompt) END AS cached_tokens, CASE WHEN prompt IS NOT NULL THEN greatest(prompt - least(cached, prompt), 0) END AS miss_tokens,
    CASE WHEN prompt IS NOT NULL THEN output_tokens END AS output_tokens, hit_rate, hit_rate - lag(hit_rate) OVER (PARTITION BY session_key ORDER BY sequence) AS hit_rate_delta, CASE WHEN prompt IS NULL THEN 'estimated' ELSE 'reported' END AS basis,
    CASE WHEN prompt IS NULL THEN lcp END AS estimated_lcp_bytes, length(h) // 2 AS payload_bytes, CASE WHEN prompt IS NOT NULL THEN ttft_ms END AS ttft_ms, CASE WHEN prompt IS NOT NULL THEN total_ms END AS total_ms FROM rated)
"""
_SESSION_TABLE = f"{_EVENTS}, {_REPORTS}, {_SESSIONS}"
SQL |= {
    "request_ids": f"{_IDENTIFIED} SELECT input_line, request_id FROM ids",
    "unit_projection": f"""{_PROJECTED}, {_IDS_TOO}
        SELECT input_line, request_id, unit_index, kind, alignment_key, content, json_path, strlen(content) AS bytes, ranged, message_index, role, tool_identity, collection, parent_json_path, element_index, content_block_index,
               substr(sha256(content), 1, 8) AS digest FROM unit JOIN ids USING (input_line)""",
    "projection_skips": f"""WITH {_PROJECTABLE},
        o AS (SELECT input_line, payload::JSON AS p, captured_at FROM loads JOIN requests USING (input_line, captured_at) UNION ALL SELECT input_line, payload::JSON, captured_at FROM requests r SEMI JOIN loads USING (input_line) WHERE captured_at IS NULL),
        c AS (SELECT input_line, CASE WHEN json_type(p, '$.model') IS DISTINCT FROM 'VARCHAR' OR p->>'$.model' = '' THEN 'MissingModel' WHEN NOT json_exists(p, '$.messages') THEN 'MissingMessages'
                                      WHEN json_type(p, '$.messages') <> 'ARRAY' THEN 'MessagesNotArray' WHEN ({_INSTANT}) IS NULL THEN 'InvalidComparisonGroup'
                                      WHEN len(list_filter(json_extract(p, '$.messages[*]'), lambda m: json_type(m) <> 'OBJECT')) > 0 THEN 'MessageNotObject' END AS code FROM o)
        SELECT input_line AS record_index, code FROM c WHERE code IS NOT NULL""",
    "cache_metrics_estimated": f"{_IDENTIFIED}, {_renamed(_CACHE)} SELECT * FROM metrics",
    "session_events": f"{_EVENTS} SELECT * EXCLUDE (prev_endpoint_key, prev_model) FROM events",
    "session_reports": f"{_EVENTS}, {_REPORTS} SELECT * FROM reports",
    "prefix_reuse_by_session": f"{_EVENTS}, {_REUSE} SELECT * FROM reuse",
    "prefix_reuse_total": f"{_EVENTS}, {_REPORTS}, {_REUSE}, {_TOTAL} SELECT *, greatest(context_bytes - potential_lcp_bytes, 0) AS new_content_bytes FROM total",
    "reuse_gauge": f"""{_EVENTS}, {_REPORTS}, {_REUSE}, {_TOTAL}
        SELECT ratio, potential_ratio, gain_bytes, 0.9::DOUBLE AS target, CASE WHEN ratio >= 0.9 THEN 'above' WHEN potential_ratio >= 0.9 THEN 'reachable' ELSE 'below' END AS verdict FROM total""",
    "session_attention": f"{_SESSION_TABLE} SELECT * FROM listed_sessions WHERE refreshes > 0",
    "session_overview": f"""{_SESSION_TABLE}
        SELECT count(*) AS sessions, sum(request_count)::BIGINT AS requests, sum(refreshes)::BIGINT AS refreshes, sum(abandoned_bytes)::BIGINT AS abandoned_bytes, count(*) FILTER (refreshes > 0) AS with_refresh,
               array_to_string(list_sort(list(DISTINCT endpoint_key)), ', ') AS endpoints, array_to_string(list_sort(list(DISTINCT model)), ', ') AS models FROM listed_sessions""",
    "cross_check": f"""{_EVENTS}, {_REUSE}, {_renamed(_CACHE, 3)},
        reported AS (SELECT session_key, {_RATIO('sum(cached_tokens)', 'sum(prompt_tokens)')} AS real_ratio, count(*) AS reported_rows FROM metrics WHERE basis = 'reported' AND session_key IS NOT NULL GROUP BY 1)
        SELECT session_key, ratio AS structural_ratio, real_ratio, reported_rows, abs(ratio - real_ratio) AS difference FROM reuse JOIN reported USING (session_key) ORDER BY difference DESC, session_key LIMIT 8""",
}

# the pair metric between the first members of a domain
_SEED = LIMITS.max_candidates_per_request + 1
_DIGIT = lambda at: f"(instr('0123456789ABCDEF', substr(x, {at}, 1)) - 1)"
_BYTE = lambda i: f"({_DIGIT(f'2 * ({i}) - 1')} * 16 + {_DIGIT(f'2 * ({i})')})::UBIGINT"
_BAG = "collection, kind, alignment_key, coalesce('=' || tool_identity, '')"


def _fnv(values: list[str]) -> str:
    h = "14695981039346656037::UBIGINT"
    for v in values:
        h = f"((xor({h}, {v})::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return h


def _paired(width: int) -> str:
    return f"""
member AS (SELECT input_line, request_id, (floor(epoch({_INSTANT.replace('captured_at', 'f.captured_at')}) / {width}) * {width})::BIGINT AS time_window_key, f.p->>'$.model' AS model,
                  {', '.join(f"{_trim(f'r.comparison.{k}')} AS {k}" for k in ('endpoint_key', 'model_deployment_key', 'agent_key', 'kv_namespace'))} FROM fits f JOIN requests r USING (input_line) JOIN ids USING (input_line)),
seed AS (SELECT *, dense_rank() OVER (ORDER BY time_window_key, endpoint_key, model, model_deployment_key, agent_key, kv_namespace) AS dom FROM member
         QUALIFY count(*) OVER (PARTITION BY time_window_key, endpoint_key, model, model_deployment_key, agent_key, kv_namespace) >= {LIMITS.min_template_members} AND row_number() OVER (PARTITION BY time_window_key, endpoint_key, model, model_deployment_key, agent_key, kv_namespace ORDER BY request_id) <= {_SEED}),
two AS (SELECT a.dom, a.input_line AS la, b.input_line AS lb, a.request_id AS a, b.request_id AS b, a.time_window_key, a.endpoint_key, a.model FROM seed a JOIN seed b ON a.dom = b.dom AND a.request_id < b.request_id),
item AS (SELECT input_line, concat_ws(chr(1), {_BAG}) AS bag, content, greatest(strlen(content), 1) AS size, row_number() OVER (PARTITION BY input_line, concat_ws(chr(1), {_BAG}), content) AS k FROM unit SEMI JOIN seed USING (input_line)),
ia AS (SELECT la, lb, item.* EXCLUDE (input_line) FROM two JOIN item ON input_line = la),
ib AS (SELECT la, lb, item.* EXCLUDE (input_line) FROM two JOIN item ON input_line = lb),
bags AS (SELECT la, lb, sum(greatest(coalesce(na, 0), coalesce(nb, 0))) AS units FROM (SELECT la, lb, bag, count(*) AS na FROM ia GROUP BY ALL) FULL JOIN (SELECT la, lb, bag, count(*) AS nb FROM ib GROUP BY ALL) USING (la, lb, bag) GROUP BY ALL),
same AS (SELECT la, lb, sum(size) AS w, count(*) AS n FROM ia SEMI JOIN ib USING (la, lb, bag, content, k) GROUP BY ALL),
ra AS (SELECT *, row_number() OVER (PARTITION BY la, lb, bag ORDER BY content) AS r FROM ia ANTI JOIN ib USING (la, lb, bag, content, k)),
rb AS (SELECT *, row_number() OVER (PARTITION BY la, lb, bag ORDER BY content) AS r FROM ib ANTI JOIN ia USING (la, lb, bag, content, k)),
met AS (SELECT la, lb, x.content AS s, y.content AS t, coalesce(greatest(x.size, y.size), x.size, y.size) AS w FROM ra x FULL JOIN rb y USING (la, lb, bag, r)),
asked AS (SELECT DISTINCT s AS c FROM met WHERE s IS NOT NULL AND t IS NOT NULL UNION SELECT DISTINCT t FROM met WHERE s IS NOT NULL AND t IS NOT NULL),
hexed AS (SELECT c, hex(encode(c)) AS x, strlen(c) AS len FROM asked WHERE strlen(c) > 0),
shingle AS (SELECT c, i, CASE WHEN len < 4 THEN {_BYTE('i')} ELSE {_fnv([_BYTE('i'), _BYTE('i + 1'), _BYTE('i + 2'), _BYTE('i + 3')])} END AS h FROM (SELECT *, unnest(range(1, CASE WHEN len < 4 THEN len + 1 ELSE len - 2 END)) AS i FROM hexed)),
head AS (SELECT c, h, row_number() OVER (PARTITION BY c ORDER BY h) AS k, min(h) OVER (PARTITION BY c) AS low FROM shingle WHERE i <= 256),
lowest AS (SELECT c, min(h) AS h FROM shingle GROUP BY 1),
sampled AS (SELECT c, h, count(*) AS n FROM (SELECT c, h FROM head WHERE k > 1 UNION ALL SELECT c, h FROM lowest) GROUP BY ALL),
total_of AS (SELECT c, sum(n) AS n FROM sampled GROUP BY 1),
dice AS (SELECT s, t, CASE WHEN s = t THEN 1.0 ELSE coalesce(2.0 * sum(least(x.n, y.n)) FILTER (y.n IS NOT NULL) / any_value(p.n + q.n), 0.0) END AS d
         FROM (SELECT DISTINCT s, t FROM met WHERE s IS NOT NULL AND t IS NOT NULL) LEFT JOIN total_of p ON p.c = s LEFT JOIN total_of q ON q.c = t LEFT JOIN sampled x ON x.c = s LEFT JOIN sampled y ON y.c = t AND y.h = x.h GROUP BY s, t),
rest_sum AS (SELECT la, lb, sum(w) AS w, sum(CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN d * w ELSE 0 END) AS alike, count(*) FILTER (s IS NOT NULL AND t IS NOT NULL) AS n FROM met LEFT JOIN dice USING (s, t) GROUP BY ALL),
tools_of AS (SELECT input_line, coalesce(list(DISTINCT tool_identity) FILTER (tool_identity IS NOT NULL), []) AS tools FROM unit SEMI JOIN seed USING (input_line) GROUP BY 1),
judged AS (SELECT two.*, (coalesce(same.w, 0) + coalesce(alike, 0))::DOUBLE / greatest(coalesce(same.w, 0) + coalesce(rest_sum.w, 0), 1) AS content, (coalesce(same.n, 0) + coalesce(rest_sum.n, 0))::DOUBLE / greatest(units, 1) AS structure,
                  len(list_intersect(x.tools, y.tools)) AS common, len(list_distinct(list_concat(x.tools, y.tools))) AS known
           FROM two JOIN bags USING (la, lb) LEFT JOIN same USING (la, lb) LEFT JOIN rest_sum USING (la, lb) JOIN tools_of x ON x.input_line = la JOIN tools_of y ON y.input_line = lb),
scores AS (SELECT *, CASE WHEN known > 0 THEN 0.20::DOUBLE * structure + 0.15::DOUBLE * common / known + 0.65::DOUBLE * content ELSE 0.25::DOUBLE * structure + 0.75::DOUBLE * content END AS compatibility, 1 - content AS dynamic FROM judged),
pair_of AS (SELECT *, compatibility + 1e-12 >= {LIMITS.template_compatibility_threshold} AND dynamic <= {LIMITS.max_dynamic_coverage_ratio} + 1e-12 AS accepted FROM scores)
"""
_SCORES = f"{_PROJECTED}, {_IDS_TOO}, {_paired(14 * 86400)}"
SQL |= {
    "pair_scores": f"{_SCORES} SELECT time_window_key, endpoint_key, model, a, b, round(compatibility, 9) AS compatibility, round(dynamic, 9) AS dynamic, accepted FROM pair_of",
}
#: The greedy search of a domain: its members as a list, the scores of its pairs as a map, a centre a step.
_LEAST = LIMITS.min_template_members
_OK = lambda x, y: f"mp[{x} || '|' || {y}].ok"
_SEARCH = f"""
each_way AS (SELECT dom, a AS x, b AS y, compatibility AS c, dynamic AS d, accepted AS ok FROM pair_of UNION ALL SELECT dom, b, a, compatibility, dynamic, accepted FROM pair_of UNION ALL SELECT dom, request_id, request_id, 1.0, 0.0, TRUE FROM seed),
scored AS (SELECT dom, map_from_entries(list(struct_pack(k := x || '|' || y, v := struct_pack(c := c, d := d, ok := ok)))) AS mp FROM each_way GROUP BY 1),
search(dom, members, centre, cohort) AS (
    SELECT dom, list(request_id ORDER BY request_id), NULL::VARCHAR, NULL::VARCHAR[] FROM seed GROUP BY 1 UNION ALL
    SELECT dom, CASE WHEN len(kept) >= {_LEAST} THEN list_filter(members, lambda x: NOT list_contains(kept, x)) ELSE list_filter(members, lambda x: x <> mid) END, mid, CASE WHEN len(kept) >= {_LEAST} THEN kept END
    FROM (SELECT *, CASE WHEN len(near) >= {_LEAST} THEN list_filter(near, lambda x: len(list_filter(list_concat(least_, list_filter(list_sort(list_distinct([(q * (len(near) - 1)) // 4 + 1 for q in range(5)])), lambda i: NOT list_contains(least_, i)))[:8], lambda j: NOT {_OK('x', 'near[j]')})) = 0) ELSE near END AS kept
    FROM (SELECT *, list_transform(list_sort(list_transform(range(1, len(near) + 1), lambda i: struct_pack(c := mp[mid || '|' || near[i]].c, d := -mp[mid || '|' || near[i]].d, i := i)))[:4], lambda s: s.i) AS least_
    FROM (SELECT *, list_filter(members, lambda x: {_OK('mid', 'x')}) AS near
    FROM (SELECT dom, members, mp, list_min(list_transform(members, lambda x: struct_pack(n := -len(list_filter(members, lambda y: {_OK('x', 'y')})), m := -list_avg(list_transform(list_filter(members, lambda y: {_OK('x', 'y')}), lambda y: mp[x || '|' || y].c)), id := x))).id AS mid
          FROM search JOIN scored USING (dom) WHERE len(members) >= {_LEAST})))))
"""
# ids of cohorts: digests over the domain, the structure of the centre and the members, put together in hexadecimal
_HEX = lambda x: f"hex(encode({x})) || '00'"
_OPTIONAL = lambda x: f"CASE WHEN {x} IS NULL THEN '0000' ELSE '01' || {_HEX(x)} END"
_FIXED = lambda x: x.encode().hex() + "00"


def _cohorts(width: int) -> str:
    return f"""{_PROJECTED}, {_IDS_TOO}, {_paired(width)}, {_SEARCH},
    signature AS (SELECT input_line, sha256(from_hex(string_agg(hex(encode(replace(collection, '_', '-') || ':' || alignment_key)), '1F' ORDER BY unit_index) || '00' || coalesce(string_agg({_HEX('tool_identity')}, '' ORDER BY tool_identity), ''))) AS sig FROM unit SEMI JOIN seed USING (input_line) GROUP BY 1),
    named AS (SELECT dom, centre, cohort, sha256(from_hex(printf('%016x', time_window_key) || '00' || {_HEX('endpoint_key')} || '{_FIXED('openai-compatible-chat')}' || {_HEX('model')} || {_OPTIONAL('model_deployment_key')} || '{_FIXED('openai-compatible-chat/v1')}'
                     || {_OPTIONAL('agent_key')} || {_OPTIONAL('kv_namespace')} || '{_FIXED('1')}' || hex(encode(sig)) || array_to_string(list_transform(cohort, lambda m: {_HEX('m')}), ''))) AS cohort_id
              FROM search JOIN seed USING (dom) JOIN signature USING (input_line) WHERE cohort IS NOT NULL AND request_id = centre),
    listed_members AS (SELECT dom, cohort_id, centre, unnest(cohort) AS request_id FROM named)
    SELECT cohort_id, centre AS medoid_request_id, request_id, round(mp[centre || '|' || request_id].c, 9) AS compatibility, round(avg(mp[centre || '|' || request_id].c) OVER (PARTITION BY cohort_id), 9) AS cohesion FROM listed_members JOIN scored USING (dom)"""


SQL |= {"cohorts": _cohorts(LIMITS.comparison_window_seconds), "cohorts_two_weeks": _cohorts(14 * 86400), "cohorts_in_rounds": _cohorts(14 * 86400)}
#: The rules on sessions, over events found here; the rules on templates and defects hold on every table, so they list nothing.
SQL["integrity"] = f"""{_EVENTS}, {_REPORTS},
    e AS (SELECT *, session_key || '/' || next_sequence AS name FROM events),
    s AS (SELECT session_key, count(*) AS n, count(*) FILTER (prefix_reuse_outlier) AS r, sum(abandoned_prefix_bytes) AS a FROM events GROUP BY 1)
    SELECT 'abandoned bytes lie in the request before' AS rule, name AS subject FROM e WHERE abandoned_prefix_bytes > previous_total_bytes
    UNION ALL SELECT 'retained and abandoned make up the request before', name FROM e WHERE retained_prefix_bytes + abandoned_prefix_bytes <> previous_total_bytes
    UNION ALL SELECT 'an outlier abandons bytes', name FROM e WHERE prefix_reuse_outlier <> (abandoned_prefix_bytes > 0)
    UNION ALL SELECT 'a session has one request more than events', session_key FROM reports JOIN s USING (session_key) WHERE request_count <> n + 1
    UNION ALL SELECT 'refreshes are the outliers', session_key FROM reports JOIN s USING (session_key) WHERE context_refresh_count <> r
    UNION ALL SELECT 'abandoned bytes add up', session_key FROM reports JOIN s USING (session_key) WHERE total_abandoned_prefix_bytes <> a"""
