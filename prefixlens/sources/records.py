"""From captured lines to loaded records: line scan, filters, the validation chain, identity.

Reading goes cheapest first: blank and oversized lines are filtered on their bytes by Catalyst before the
Arrow stage parses anything. No line is lost: each comes out as a record or as a skip with a code and
arguments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlens.functions import canonical as C
from prefixlens.functions.strings import py_trim
from prefixlens.operators.ordering import row_numbers
from prefixlens.options import AnalysisOptions
from prefixlens.sources.tables import pieces, spread, written

#: Payload keys that hold the reserved usage object.
USAGE_KEYS = ("_response_usage",)
U32_MAX = 4294967295

USAGE = "struct<prompt_tokens: bigint, cached_tokens: bigint, completion_tokens: bigint, ttft_ms: bigint, total_ms: bigint>"
RECORD = (
    "input_line bigint, id_hash string, captured_at string, source string, session_key string, endpoint_key string, "
    f"agent_key string, model_deployment_key string, kv_namespace string, response_usage {USAGE}, payload string, "
    "skip_code string, skip_args map<string,string>"
)
_USAGE_TYPE = pa.struct([(n, pa.int64()) for n in ("prompt_tokens", "cached_tokens", "completion_tokens", "ttft_ms", "total_ms")])
_ARROW = [pa.int64(), *[pa.string()] * 8, _USAGE_TYPE, pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
_NAMES = ["input_line", "id_hash", "captured_at", "source", "session_key", "endpoint_key", "agent_key", "model_deployment_key", "kv_namespace", "response_usage", "payload", "skip_code", "skip_args"]


class Skip(Exception):
    """A rejected line: code and arguments."""

    def __init__(self, code: str, **args: object):
        self.code, self.args_ = code, {k: str(v) for k, v in args.items()}


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(input_line, line) of the files at ``path``: lines end at newline only; numbered in file order from 1."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # one file's blocks are read in order, so (file, block, order of reading) is the physical order
    return row_numbers(raw, [], ["file", "block", "at"], "input_line").select("input_line", F.col("value").alias("line"))


def _token(v: object) -> int | None:
    """An unsigned whole number, saturated at 32 bits; anything else is absent."""
    if type(v) is int and v >= 0:
        return min(v, U32_MAX)
    return None


def _millis(v: object) -> int | None:
    return v if type(v) is int and 0 <= v < 2**63 else None


def usage_of(payload: dict) -> dict | None:
    """The reserved usage object. A present but invalid total does not fall back to the other name."""
    u = next((payload[k] for k in USAGE_KEYS if k in payload), None)
    if type(u) is not dict:
        return None
    total = _token(u.get("prompt_tokens") if "prompt_tokens" in u else u.get("input_tokens"))
    if total is None:
        return None
    out = u["completion_tokens"] if "completion_tokens" in u else u.get("output_tokens")
    return {
        "prompt_tokens": total,
        "cached_tokens": _token(u.get("cached_tokens")) or 0,
        "completion_tokens": _token(out) or 0,
        "ttft_ms": _millis(u.get("ttft_ms")),
        "total_ms": _millis(u.get("total_ms")),
    }


def _key(comparison: dict, field: str) -> str | None:
    v = comparison.get(field)
    if v is None:
        return None
    if type(v) is not str:
        raise Skip("InvalidComparisonKey", field=field)
    if not (v := py_trim(v)):
        raise Skip("EmptyComparisonKey", field=field)
    return v


def check_record(record: object) -> dict:
    """The loaded form of a parsed line; the first failing rule decides.

    The id is the digest of the whole record; the payload is kept without the reserved usage object.
    """
    if type(record) is not dict:
        raise Skip("RecordNotObject")
    if "payload" not in record:
        raise Skip("MissingPayload")
    payload, comparison = record["payload"], record.get("comparison")
    if type(payload) is not dict:
        raise Skip("PayloadNotObject")
    if type(comparison) is not dict:
        raise Skip("MissingComparison")
    endpoint = comparison.get("endpoint_key")
    if type(endpoint) is not str:
        raise Skip("MissingEndpointKey")
    if not (endpoint := py_trim(endpoint)):
        raise Skip("EmptyEndpointKey")
    keys = {f: _key(comparison, f) for f in ("agent_key", "model_deployment_key", "kv_namespace")}
    session = record.get("session_key")
    if session is not None:
        if type(session) is not str:
            raise Skip("InvalidSessionKey")
        if not (session := py_trim(session)):
            raise Skip("EmptySessionKey")
    text = lambda f: record[f] if type(record.get(f)) is str else None
    digest, usage = hashlib.sha256(C.canonical(record).encode()).hexdigest(), usage_of(payload)
    payload = {k: v for k, v in payload.items() if k not in USAGE_KEYS}
    return {
        "id_hash": digest,
        "captured_at": text("captured_at"), "source": text("source"), "session_key": session, "endpoint_key": endpoint, **keys,
        "response_usage": usage, "payload": C.canonical(payload),
    }


def load_line(line: str) -> dict:
    try:
        record = C.parse(line)
    except ValueError as e:
        raise Skip("InvalidJson", message=str(e)) from None
    return check_record(record)


def _batches(batches: Iterator[pa.RecordBatch], load) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        rows = []
        for line, *values in zip(*(c.to_pylist() for c in b.columns)):
            try:
                rows.append({"input_line": line, **load(*values)})
            except Skip as s:
                rows.append({"input_line": line, "skip_code": s.code, "skip_args": list(s.args_.items())})
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _ARROW)], names=_NAMES)


def load_lines(lines: DataFrame, options: AnalysisOptions = AnalysisOptions()) -> DataFrame:
    """RECORD rows of (input_line, line). Blank and too large lines are skipped before parsing."""
    size = F.octet_length("line")
    early = F.when(F.col("line").isNull() | F.col("line").rlike(r"^[ \t\r\f]*$"), F.lit("EmptyLine")).when(size > options.max_payload_bytes, F.lit("RecordTooLarge"))
    marked = lines.select(F.col("input_line").cast("bigint"), "line", early.alias("early"), size.alias("size"))
    parsed = spread(marked.where(F.col("early").isNull()).select("input_line", "line")).mapInArrow(lambda it: _batches(it, load_line), RECORD)
    args = F.when(F.col("early") == "RecordTooLarge", F.create_map(F.lit("bytes"), F.col("size").cast("string"), F.lit("limit"), F.lit(str(options.max_payload_bytes)))).otherwise(F.create_map().cast("map<string,string>"))
    nothing = [F.lit(None).cast(parsed.schema[n].dataType).alias(n) for n in _NAMES[1:-2]]
    skipped = marked.where(F.col("early").isNotNull()).select("input_line", *nothing, F.col("early").alias("skip_code"), args.alias("skip_args"))
    return _budget(parsed.unionByName(skipped), lines, options)


def load_requests(requests: DataFrame, options: AnalysisOptions = AnalysisOptions()) -> DataFrame:
    """RECORD rows of parsed envelopes whose payload is still JSON text (a table instead of lines)."""

    def load(captured_at, source, session, comparison, payload):
        try:
            value = C.parse(payload) if payload is not None else None
        except ValueError as e:
            raise Skip("InvalidJson", message=str(e)) from None
        record = {"captured_at": captured_at, "source": source, "session_key": session, "payload": value}
        record = {k: v for k, v in record.items() if v is not None}
        if comparison is not None:
            record["comparison"] = {k: v for k, v in comparison.items() if v is not None}
        return check_record(record)

    picked = requests.select(F.col("input_line").cast("bigint"), "captured_at", "source", "session_key", "comparison", "payload")
    return _budget(spread(picked).mapInArrow(lambda it: _batches(it, load), RECORD), requests, options)


def _budget(records: DataFrame, lines: DataFrame, options: AnalysisOptions) -> DataFrame:
    """Records past ``max_records`` accepted ones become skips; only accepted ones count, in line order.

    The order is only taken where there are more lines than the budget.
    """
    if lines.count() <= options.max_records:
        return records
    accepted = records.where(F.col("skip_code").isNull())
    numbered = row_numbers(accepted, [], ["input_line"], "_n")
    over = F.col("_n") > options.max_records
    cut = numbered.withColumn("skip_code", F.when(over, "RecordBudgetExceeded")).withColumn("skip_args", F.when(over, F.create_map(F.lit("limit"), F.lit(str(options.max_records))))).drop("_n")
    return cut.unionByName(records.where(F.col("skip_code").isNotNull()))


def hashed(records: DataFrame) -> DataFrame:
    """Accepted records; request_id is their content hash until ``numbered``."""
    return records.where(F.col("skip_code").isNull()).drop("skip_code", "skip_args").withColumnRenamed("id_hash", "request_id")


def numbered(records: DataFrame) -> DataFrame:
    """request_id completed by the 0-based occurrence of the content in line order. ``records`` is a written table.

    Only content that repeats is numbered, on narrow rows.
    """
    narrow = records.select(F.col("request_id").alias("h"), "input_line")
    repeated = narrow.join(narrow.groupBy("h").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("h"), "h")
    # written, so that the planner knows it to be small, where it is, and leaves the wide rows where they lie
    numbers = written(row_numbers(repeated, ["h"], ["input_line"], "_n").select("input_line", "_n"), "numbers")
    number = F.coalesce(F.col("_n") - 1, F.lit(0)).cast("string")
    return records.join(numbers, "input_line", "left").withColumn("request_id", F.concat("request_id", F.lit(":"), number)).drop("_n")


def identified(records: DataFrame) -> DataFrame:
    """Accepted records with request_id: content hash and occurrence."""
    return numbered(written(hashed(records), "accepted"))


def skip_text(phase: str, code: Column, args: Column) -> Column:
    """``phase: Code`` or ``phase: Code { name: value, ... }``."""
    inner = F.array_join(F.transform(F.map_entries(args), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    return F.concat(F.lit(f"{phase}: "), code, F.when(F.coalesce(F.size(args), F.lit(0)) > 0, F.concat(F.lit(" { "), inner, F.lit(" }"))).otherwise(""))


def skips(records: DataFrame, phase: str = "corpus") -> DataFrame:
    """(record_index, reason, code, args) of what was rejected."""
    return records.where(F.col("skip_code").isNotNull()).select(F.col("input_line").alias("record_index"), skip_text(phase, F.col("skip_code"), F.col("skip_args")).alias("reason"), F.col("skip_code").alias("code"), F.col("skip_args").alias("args"))
