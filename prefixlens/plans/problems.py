"""Queries of the two general data problems: hot keys (p4) and nested records (p5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlens.functions.strings import clean_key
from prefixlens.operators import flatten, weighted
from prefixlens.sources.tables import table

#: A pair is heavy from this share of all rows on.
HEAVY_SHARE = 0.02


def _pairs(df: DataFrame, *more: str) -> DataFrame:
    return df.select(clean_key("comparison.endpoint_key").alias("endpoint_key"), clean_key("comparison.agent_key").alias("agent_key"), *[F.col(m) for m in more])


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    pairs = _pairs(table(spark, base, "requests"), "comparison.model_deployment_key")
    return weighted.heavy_keys(pairs, ["endpoint_key", "agent_key"], HEAVY_SHARE, "model_deployment_key").select("endpoint_key", "agent_key")


def p4_pair_stats(spark: SparkSession, base: str) -> DataFrame:
    """Exact distinct counts, mode and percentiles of total_ms per endpoint and agent."""
    rows = _pairs(table(spark, base, "corpus_records"), "response_usage.total_ms")
    return weighted.weighted_stats(rows, ["endpoint_key", "agent_key"], "total_ms", (0.5, 0.95))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return flatten.flatten_payloads(table(spark, base, "requests"), full=False)


def p5_messages(spark: SparkSession, base: str) -> DataFrame:
    return flatten.messages_table(flatten.flatten_payloads(table(spark, base, "requests")))


def p5_blocks(spark: SparkSession, base: str) -> DataFrame:
    return flatten.blocks_table(flatten.flatten_payloads(table(spark, base, "requests")))


def p5_tools(spark: SparkSession, base: str) -> DataFrame:
    return flatten.tools_table(flatten.flatten_payloads(table(spark, base, "requests")))


QUERIES = {f.__name__: f for f in (p4_found, p4_pair_stats, p5_found, p5_messages, p5_blocks, p5_tools)}

_WS = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g'), '')"


_PAIRS = f"{_trim('comparison.endpoint_key')} AS endpoint_key, {_trim('comparison.agent_key')} AS agent_key"
#: Sound payloads with their messages as a list of JSON values.
SOUND_SQL = """
parsed AS (SELECT input_line, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM requests),
object AS (SELECT input_line, p FROM parsed WHERE json_type(p) = 'OBJECT' AND json_type(p, '$.messages') = 'ARRAY'),
listed AS (SELECT input_line, p, json_extract(p, '$.messages[*]') AS ms FROM object),
sound AS (SELECT input_line, p, ms FROM listed WHERE len(list_filter(ms, lambda m: json_type(m) <> 'OBJECT')) = 0),
msg AS (SELECT input_line, unnest(range(len(ms)))::BIGINT AS i, unnest(ms) AS m FROM sound),
blk AS (SELECT input_line, i, unnest(range(len(bs)))::BIGINT AS j, unnest(bs) AS b FROM
        (SELECT input_line, i, json_extract(m, '$.content[*]') AS bs FROM msg WHERE json_type(m, '$.content') = 'ARRAY')),
tl AS (SELECT input_line, unnest(range(len(ts)))::BIGINT AS i, unnest(ts) AS t FROM
       (SELECT input_line, json_extract(p, '$.tools[*]') AS ts FROM sound WHERE json_type(p, '$.tools') = 'ARRAY'))
"""
#: A block's string: itself, else the first string among its text keys.
BLOCK_SQL = "CASE WHEN json_type(b) = 'VARCHAR' THEN b->>'$' " + " ".join(f"WHEN json_type(b, '$.{k}') = 'VARCHAR' THEN b->>'$.{k}'" for k in ("text", "input_text", "output_text", "content")) + " END"


def _kind_sql(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"


def _string_sql(x: str, path: str) -> str:
    return f"CASE WHEN json_type({x}, '{path}') = 'VARCHAR' THEN {x}->>'{path}' END"


_TOOL_NAME = "coalesce(" + _string_sql("t", "$.name") + ", " + _string_sql("t", "$.function.name") + ")"

SQL = {
    "p4_found": f"""
        WITH k AS (SELECT {_PAIRS} FROM requests)
        SELECT endpoint_key, agent_key FROM k WHERE endpoint_key IS NOT NULL AND agent_key IS NOT NULL
        GROUP BY ALL HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM k)""",
    "p4_pair_stats": f"""
        WITH k AS (SELECT {_PAIRS}, response_usage.total_ms AS v FROM corpus_records),
        f AS (SELECT endpoint_key, agent_key, v, count(*) AS w FROM k WHERE v IS NOT NULL GROUP BY ALL),
        m AS (SELECT *, row_number() OVER (PARTITION BY endpoint_key, agent_key ORDER BY w DESC, v) AS rn FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY endpoint_key, agent_key ORDER BY v) AS pos,
                     count(*) OVER (PARTITION BY endpoint_key, agent_key) AS n FROM k WHERE v IS NOT NULL),
        q AS (SELECT endpoint_key, agent_key, min(v) FILTER (pos * 100 >= 50 * n) AS p50, min(v) FILTER (pos * 100 >= 95 * n) AS p95 FROM r GROUP BY ALL),
        g AS (SELECT endpoint_key, agent_key, count(*) AS n_rows, count(v) AS n_values, count(DISTINCT v) AS n_distinct FROM k GROUP BY ALL)
        SELECT g.*, m.v AS mode, m.w AS mode_count, q.p50, q.p95 FROM g
        LEFT JOIN m ON m.rn = 1 AND m.endpoint_key IS NOT DISTINCT FROM g.endpoint_key AND m.agent_key IS NOT DISTINCT FROM g.agent_key
        LEFT JOIN q ON q.endpoint_key IS NOT DISTINCT FROM g.endpoint_key AND q.agent_key IS NOT DISTINCT FROM g.agent_key""",
    "p5_found": f"""
        WITH {SOUND_SQL}
        SELECT input_line, 'message' AS section, i AS element_index, -1::BIGINT AS block_index FROM msg
        UNION ALL SELECT input_line, 'block', i, j FROM blk UNION ALL SELECT input_line, 'tool', i, -1 FROM tl""",
    "p5_messages": f"""
        WITH {SOUND_SQL}
        SELECT input_line, i AS message_index, {_string_sql('m', '$.role')} AS role,
               CASE WHEN json_exists(m, '$.content') THEN {_kind_sql("m->'$.content'")} ELSE 'absent' END AS content_kind,
               {_string_sql('m', '$.content')} AS content FROM msg""",
    "p5_blocks": f"""
        WITH {SOUND_SQL}
        SELECT input_line, i AS message_index, j AS block_index, {_kind_sql('b')} AS block_kind,
               {_string_sql('b', '$.type')} AS block_type, {BLOCK_SQL} AS text FROM blk""",
    "p5_tools": f"""
        WITH {SOUND_SQL}
        SELECT input_line, i AS tool_index, {_kind_sql('t')} AS tool_kind, {_string_sql('t', '$.type')} AS tool_type,
               {_TOOL_NAME} AS name FROM tl""",
}
