"""Queries that run the streaming operators over a test table as a stream that ends, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlens.plans import analysis_sql as Q
from prefixlens.plans.problems import _trim
from prefixlens.sources.tables import hadoop_path, shared_dir
from prefixlens.streaming import live


def _lines(spark: SparkSession, base: str) -> DataFrame:
    """The captured lines as a stream, in the order of their numbers."""
    path = f"{base}/raw_lines.parquet"
    files, at = hadoop_path(spark, path)
    # a stream reads folders
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    rows = reader.parquet(path) if files.getFileStatus(at).isDirectory() else reader.option("pathGlobFilter", "raw_lines.parquet").parquet(base)
    return live.load(rows.select("input_line", "line", F.lpad(F.col("input_line").cast("string"), 20, "0").alias("place")))


def _ended(df: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives until its source is read."""
    name = f"ended_{uuid.uuid4().hex}"
    checkpoint = f"{shared_dir(df.sparkSession)}/{name}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    files, at = hadoop_path(df.sparkSession, checkpoint)
    files.deleteOnExit(at)
    return df.sparkSession.table(name)


def stream_windows(spark: SparkSession, base: str) -> DataFrame:
    """Records per endpoint and tumbling hour, kept up to date by the stream."""
    return _ended(live.window_counts(_lines(spark, base)), "complete")


def stream_skips(spark: SparkSession, base: str) -> DataFrame:
    """Rejected lines of the stream."""
    return _ended(_lines(spark, base).where("skip_code IS NOT NULL").select(F.col("input_line").alias("record_index"), F.col("skip_code").alias("code")), "append")


def stream_turns(spark: SparkSession, base: str) -> DataFrame:
    """Turns of sessions from state; those the watermark has not passed still wait."""
    return _ended(live.session_turns(_lines(spark, base), delay="0 seconds"), "append")


QUERIES = {f.__name__: f for f in (stream_windows, stream_skips, stream_turns)}

_TEXT = lambda k: f"CASE WHEN json_type(j, '$.{k}') = 'VARCHAR' THEN j->>'$.{k}' END"
_KEY = lambda k: f"CASE WHEN json_type(j, '$.comparison.{k}') = 'VARCHAR' THEN j->>'$.comparison.{k}' END"
#: The accepted lines in the form of the table of requests, which they stand for in the SQL below.
_REQUESTS = f"""
turned_down AS ({Q.SQL['line_skips']}),
requests AS (SELECT input_line, {_TEXT('captured_at')} AS captured_at, {_TEXT('source')} AS source, {_TEXT('session_key')} AS session_key,
                    struct_pack({', '.join(f'{k} := {_KEY(k)}' for k in ('endpoint_key', 'agent_key', 'model_deployment_key', 'kv_namespace'))}) AS comparison, (j->'$.payload')::VARCHAR AS payload, j
             FROM (SELECT input_line, line::JSON AS j FROM raw_lines WHERE input_line NOT IN (SELECT record_index FROM turned_down)))
"""
#: Ids are digests of the whole line here: lines can hold keys that the table does not.
_LINE_IDS = f"vals2 AS (SELECT j AS v FROM requests), {Q._renamed(Q._CANON)}, ids AS (SELECT input_line, sha256(c) || ':0' AS request_id FROM requests JOIN canon2 ON canon2.v = j::VARCHAR)"
SQL = {
    "stream_windows": f"""WITH {_REQUESTS}
        SELECT (floor(epoch({Q._INSTANT}) / 3600) * 3600)::BIGINT AS time_window_key, {_trim('comparison.endpoint_key')} AS endpoint_key, count(*) AS records FROM requests WHERE ({Q._INSTANT}) IS NOT NULL GROUP BY ALL""",
    "stream_skips": f"WITH s AS ({Q.SQL['line_skips']}) SELECT record_index, code FROM s",
    "stream_turns": f"""WITH RECURSIVE {_REQUESTS}, {Q._PROJECTED.removeprefix('WITH RECURSIVE')}, {_LINE_IDS}, {Q._TURNS},
        mark AS (SELECT max(floor(epoch({Q._INSTANT})))::HUGEINT * 1000000000 AS m FROM requests SEMI JOIN fits USING (input_line) WHERE session_key IS NOT NULL)
        SELECT events.session_key, next_request_id AS request_id, events.prev_request_id AS previous_request_id, event_type, lcp_units, lcp_bytes, next_total_bytes, FALSE AS late
        FROM events JOIN ids ON request_id = next_request_id JOIN requests r USING (input_line), mark WHERE ({Q._NANOS.replace('captured_at', 'r.captured_at')}) < m""",
}
