"""Queries that run the engine's own functions, filters and report tables over the test tables, with their SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlens.functions import strings as S
from prefixlens.functions.register import register
from prefixlens.functions.times import rfc3339_nanos, rfc3339_seconds, window_start
from prefixlens.operators import cache, projection, session
from prefixlens.plans import analysis_queries as A
from prefixlens.plans import analysis_sql as Q
from prefixlens.plans.problems import _WS, _trim
from prefixlens.report import tables as report
from prefixlens.sources import records as R
from prefixlens.sources.tables import spread, table, written


def text_forms(spark: SparkSession, base: str) -> DataFrame:
    """Lengths, cuts and labels of every document's text."""
    size = S.byte_length("text")
    return table(spark, base, "documents").select(
        "doc_id", size.alias("bytes"), S.truncate_points("text", 40).alias("head"), S.short_id("text").alias("short"), S.short_digest("text").alias("digest"),
        S.flatten_label("text", 80).alias("label"), S.human_bytes(size * 300).alias("size"), S.digest_parts(F.col("text"), F.col("doc_id").cast("string")).alias("parts"),
    )


def instants(spark: SparkSession, base: str) -> DataFrame:
    """Seconds, nanoseconds and windows of every time stamp as it was captured."""
    at = table(spark, base, "corpus_records").select("input_line", "captured_at").distinct()
    seconds = rfc3339_seconds("captured_at")
    return at.select("input_line", seconds.alias("seconds"), rfc3339_nanos("captured_at").cast("string").alias("nanos"), window_start(seconds, 900).alias("quarter"))


def canonical_payloads(spark: SparkSession, base: str) -> DataFrame:
    """Every payload that is JSON in its canonical form."""
    register(spark)
    rows = spread(table(spark, base, "requests").select("input_line", "payload"))
    return rows.select("input_line", F.call_function("canonical_json", "payload").alias("canonical")).where("canonical IS NOT NULL")


def report_labels(spark: SparkSession, base: str) -> DataFrame:
    """Sources and sessions as the reports write them."""
    register(spark)
    names = table(spark, base, "documents").select(F.concat_ws(" ", "source", "lang").alias("name")).distinct().unionByName(table(spark, base, "corpus_records").select(F.col("session_key").alias("name")).where("name IS NOT NULL").distinct())
    return names.select("name", *[F.call_function(f, "name").alias(f) for f in ("markdown_text", "heading_anchor", "session_label")])


def key_hashes(spark: SparkSession, base: str) -> DataFrame:
    """FNV-1a of every session key."""
    register(spark)
    keys = table(spark, base, "corpus_records").select("session_key").distinct().where("session_key IS NOT NULL")
    return keys.select("session_key", F.call_function("fnv1a64", "session_key").alias("hash"))


#: Small limits, so that records pass them.
SMALL = dataclasses.replace(A.OPTIONS, max_payload_bytes=1500, max_records=40)
NARROW = dataclasses.replace(A.OPTIONS, max_projection_units=18, max_text_unit_bytes=700)


def limited_lines(spark: SparkSession, base: str) -> DataFrame:
    """What small limits on the size and number of records reject."""
    return R.skips(R.load_lines(table(spark, base, "raw_lines"), SMALL)).select("record_index", "code").where("code IN ('RecordTooLarge', 'RecordBudgetExceeded')")


def limited_units(spark: SparkSession, base: str) -> DataFrame:
    """What small limits on units and texts reject."""
    skips = projection.projection_skips(projection.project(R.hashed(A._loaded(spark, base)), NARROW))
    return skips.select("record_index", "code").where("code IN ('UnitBudgetExceeded', 'TextBudgetExceeded')")


def event_bars(spark: SparkSession, base: str) -> DataFrame:
    """Turns with the class of their bar."""
    return report.event_details({"session_events": A._events(spark, base)})


def cache_groups(spark: SparkSession, base: str) -> DataFrame:
    """Cache rows with the number of their session in the report."""
    rows = written(cache.cache_metrics(R.identified(A._loaded(spark, base))), "cache")
    return report.cache_table(rows).select("request_id", "session_key", "sequence", "group")


def cache_totals(spark: SparkSession, base: str) -> DataFrame:
    found = cache.metric_totals(cache.cache_metrics(R.identified(A._loaded(spark, base))))
    return found.withColumn("mean_hit_rate", F.round("mean_hit_rate", 9))


def session_key_prefix(spark: SparkSession, base: str) -> DataFrame:
    """The prefix that all session keys have in common."""
    return report.common_key_prefix(session.session_reports(A._events(spark, base)), "session_key")


def normal_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Sessions without context refreshes, as the report lists them."""
    return report.normal(A._session_table(spark, base)).drop("first_refresh")


QUERIES = {f.__name__: f for f in (text_forms, instants, canonical_payloads, report_labels, key_hashes, limited_lines, limited_units, event_bars, cache_groups, cache_totals, session_key_prefix, normal_sessions)}


def _flat(x: str) -> str:
    flat = f"regexp_replace(replace({x}, '\\n', ' '), '{_WS}+', ' ', 'g')"
    return f"coalesce({_trim(flat)}, '')"


#: Units up to the first message that is no object.
_WHOLE = "sound AS (SELECT input_line, p, ms FROM listed WHERE len(list_filter(ms, lambda m: json_type(m) <> 'OBJECT')) = 0)"
_CUT = "sound AS (SELECT input_line, p, CASE WHEN bad > 0 THEN ms[: bad - 1] ELSE ms END AS ms, coalesce(bad, 0) = 0 AS whole FROM (SELECT *, list_position(list_transform(ms, lambda m: json_type(m) <> 'OBJECT'), TRUE) AS bad FROM listed))"
assert _WHOLE in Q._PROJECTED
_UP_TO_BAD = Q._PROJECTED.replace(_WHOLE, _CUT)
SQL = {
    "text_forms": f"""
        SELECT doc_id, strlen(text) AS bytes, text[:40] AS head, CASE WHEN length(text) > 12 THEN text[:12] || '…' ELSE text END AS short, sha256(text)[:8] AS digest,
               CASE WHEN length({_flat('text')}) > 80 THEN ({_flat('text')})[:80] || '…' WHEN text IS NOT NULL THEN {_flat('text')} END AS label,
               CASE WHEN strlen(text) * 300 >= 1048576 THEN printf('%.1f MB', strlen(text) * 300 / 1048576.0::DOUBLE) WHEN strlen(text) * 300 >= 1024 THEN printf('%d KB', round_even(strlen(text) * 300 / 1024.0::DOUBLE, 0)::BIGINT) ELSE printf('%d B', strlen(text) * 300) END AS size,
               sha256(from_hex(hex(encode(text)) || '00' || hex(encode(doc_id::VARCHAR)) || '00')) AS parts
        FROM documents""",
    "instants": f"""
        WITH d AS (SELECT DISTINCT input_line, captured_at FROM corpus_records)
        SELECT input_line, floor(epoch({Q._INSTANT}))::BIGINT AS seconds, ({Q._NANOS})::VARCHAR AS nanos, (floor(epoch({Q._INSTANT}) / 900) * 900)::BIGINT AS quarter FROM d""",
    "canonical_payloads": f"""
        WITH RECURSIVE vals AS (SELECT payload::JSON AS v FROM requests WHERE json_valid(payload)), {Q._CANON}
        SELECT input_line, c AS canonical FROM (SELECT input_line, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM requests) JOIN canon ON canon.v = p::VARCHAR""",
    "report_labels": f"""
        WITH n AS (SELECT DISTINCT concat_ws(' ', source, lang) AS name FROM documents UNION ALL SELECT DISTINCT session_key FROM corpus_records WHERE session_key IS NOT NULL)
        SELECT name, regexp_replace({_flat('name')}, '([\\\\`*_{{}}\\[\\]()<>#+\\-.!|~&])', '\\\\\\1', 'g') AS markdown_text,
               regexp_replace(regexp_replace(coalesce({_trim('lower(name)')}, ''), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s', '-', 'g') AS heading_anchor,
               CASE WHEN length(name) <= 32 THEN name ELSE name[:8] || '…' || name[-12:] END AS session_label FROM n""",
    "key_hashes": f"""
        WITH k AS (SELECT DISTINCT session_key, hex(encode(session_key)) AS x FROM corpus_records WHERE session_key IS NOT NULL),
        b AS (SELECT session_key, list_transform(range(1, length(x) // 2 + 1), lambda i: ((instr('0123456789ABCDEF', substr(x, 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i, 1)) - 1)::UHUGEINT) AS bytes FROM k),
        h AS (SELECT session_key, list_reduce(bytes, lambda h, v: ((xor(h, v) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT), 14695981039346656037::UHUGEINT) AS h FROM b)
        SELECT session_key, CASE WHEN h >= 9223372036854775808::UHUGEINT THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS hash FROM h""",
    "limited_lines": f"""
        WITH big AS (SELECT input_line AS record_index, 'RecordTooLarge' AS code FROM raw_lines WHERE strlen(line) > {SMALL.max_payload_bytes} AND NOT regexp_full_match(line, '[ \\t\\r\\f]*')),
        bad AS ({Q.SQL['line_skips']}),
        good AS (SELECT input_line, row_number() OVER (ORDER BY input_line) AS n FROM raw_lines WHERE input_line NOT IN (SELECT record_index FROM bad) AND input_line NOT IN (SELECT record_index FROM big))
        SELECT * FROM big UNION ALL SELECT input_line, 'RecordBudgetExceeded' FROM good WHERE n > {SMALL.max_records}""",
    "limited_units": f"""{_UP_TO_BAD},
        broken AS (SELECT input_line, min(CASE WHEN strlen(content) > {NARROW.max_text_unit_bytes} AND kind NOT IN ('structural', 'role', 'tool_definition') THEN 2 * unit_index END) AS t,
                          min(CASE WHEN unit_index >= {NARROW.max_projection_units} AND (kind <> 'structural' OR (content = 'messages:end' AND whole)) THEN 2 * unit_index + 1 END) AS u FROM unit JOIN sound USING (input_line) GROUP BY 1)
        SELECT input_line AS record_index, CASE WHEN u IS NULL OR t < u THEN 'TextBudgetExceeded' ELSE 'UnitBudgetExceeded' END AS code FROM broken WHERE t IS NOT NULL OR u IS NOT NULL""",
    "event_bars": f"""{Q._EVENTS}
        SELECT session_key, previous_sequence, next_sequence, event_type, prefix_reuse_ratio, CASE WHEN prefix_reuse_ratio IS NULL THEN 'none' WHEN prefix_reuse_ratio < 0.5 THEN 'low' WHEN prefix_reuse_ratio < 0.75 THEN 'mid' ELSE 'high' END AS bar,
               abandoned_prefix_bytes, recomputed_bytes, stable_after_switch_bytes, domain_changed, next_block_runs FROM events""",
    "cache_groups": f"{Q._IDENTIFIED}, {Q._renamed(Q._CACHE)} SELECT request_id, session_key, sequence, dense_rank() OVER (ORDER BY session_key NULLS FIRST) AS \"group\" FROM metrics",
    "cache_totals": f"{Q._IDENTIFIED}, {Q._renamed(Q._CACHE)} SELECT count(*) AS rows, round(avg(hit_rate), 9) AS mean_hit_rate, count(*) FILTER (basis = 'reported') AS reported, count(*) FILTER (basis = 'estimated') AS estimated FROM metrics",
    "session_key_prefix": f"""{Q._EVENTS}, {Q._REPORTS}, ends AS (SELECT min(session_key) AS a, max(session_key) AS b FROM reports)
        SELECT coalesce(a[: list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda n: starts_with(b, a[: n])))], '') AS prefix FROM ends""",
    "normal_sessions": f"{Q._SESSION_TABLE} SELECT * EXCLUDE (first_refresh_from, first_refresh_to) FROM listed_sessions WHERE refreshes = 0",
}
