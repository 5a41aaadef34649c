"""Projection of loaded records to ordered, model-visible units, and the comparison domain.

One Arrow stage decodes each canonical payload once and lays the units of a batch out as flat columns under
list offsets. The domain is a native expression on the record's keys.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlens.functions.canonical import canonical
from prefixlens.functions.times import rfc3339_seconds, window_start
from prefixlens.options import AnalysisOptions
from prefixlens.sources import payload as P
from prefixlens.sources.records import Skip, skips
from prefixlens.sources.tables import pieces

#: Fixed values of the projected dialect.
DIALECT, ADAPTER, SCHEMA = "openai-compatible-chat", "1", "openai-compatible-chat/v1"
#: Kinds and collections in their order.
KINDS = ("structural", "role", "visible_text", "tool_definition", "tool_call", "tool_result")
COLLECTIONS = ("request", "tools", "messages", "content_blocks")
CONTENT_KINDS = KINDS[2:]
#: Message fields in the order they are projected.
FIELDS = ("name", "content", "function_call", "tool_calls", "tool_call_id", "refusal")

_UNIT = (
    ("kind", pa.string()), ("alignment_key", pa.string()), ("content", pa.string()), ("json_path", pa.string()), ("bytes", pa.int64()), ("ranged", pa.bool_()),
    ("message_index", pa.int64()), ("role", pa.string()), ("tool_identity", pa.string()), ("collection", pa.string()), ("parent_json_path", pa.string()),
    ("element_index", pa.int64()), ("content_block_index", pa.int64()), ("fp", pa.string()), ("digest", pa.string()),
)
UNIT = "struct<" + ", ".join(f"{n}: {'boolean' if t == pa.bool_() else 'bigint' if t == pa.int64() else 'string'}" for n, t in _UNIT) + ">"


def tool_identity(value: object) -> str | None:
    if type(value) is not dict:
        return None
    if type(name := value.get("name")) is str:
        return name
    function = value.get("function")
    return function["name"] if type(function) is dict and type(function.get("name")) is str else None


class _Units:
    """The units of one request; raises Skip where a budget is passed."""

    def __init__(self, options: AnalysisOptions):
        self.options, self.rows = options, []

    def add(self, kind: str, key: str, content: str, path: str, collection: str, parent: str, message=None, role=None, tool=None, element=None, block=None, ranged=False) -> None:
        raw = content.encode()
        fp = hashlib.blake2b("\0".join((kind, key, collection, "")).encode() + raw, digest_size=16).hexdigest()
        short = hashlib.sha256(raw).hexdigest()[:8]
        self.rows.append((kind, key, content, path, len(raw), ranged, message, role, tool, collection, parent, element, block, fp, short))

    def check(self) -> None:
        if len(self.rows) > self.options.max_projection_units:
            raise Skip("UnitBudgetExceeded", limit=self.options.max_projection_units)

    def text(self, content: str, path: str) -> None:
        if len(content) * 4 > self.options.max_text_unit_bytes and (size := len(content.encode())) > self.options.max_text_unit_bytes:
            raise Skip("TextBudgetExceeded", path=path, bytes=size, limit=self.options.max_text_unit_bytes)


def units_of(payload: dict, options: AnalysisOptions) -> list[tuple]:
    if type(payload.get("model")) is not str or not payload["model"]:
        raise Skip("MissingModel")
    if "messages" not in payload:
        raise Skip("MissingMessages")
    if type(messages := payload["messages"]) is not list:
        raise Skip("MessagesNotArray")
    u = _Units(options)
    if type(tools := payload.get("tools")) is list:
        u.add("structural", "tools:start", "tools:start", "$.tools", "tools", "$.tools")
        for i, tool in enumerate(tools):
            u.add("tool_definition", "tool-definition", canonical(tool), f"$.tools[{i}]", "tools", "$.tools", tool=tool_identity(tool), element=i)
            u.check()
        u.add("structural", "tools:end", "tools:end", "$.tools", "tools", "$.tools")
    u.add("structural", "messages:start", "messages:start", "$.messages", "messages", "$.messages")
    for i, m in enumerate(messages):
        if type(m) is not dict:
            raise Skip("MessageNotObject", index=i)
        role = m["role"] if type(m.get("role")) is str else "unknown"
        base = f"$.messages[{i}]"
        u.add("role", "message:role", role, f"{base}.role", "messages", "$.messages", i, role, element=i)
        u.check()
        for field in FIELDS:
            if field not in m:
                continue
            value = m[field]
            if field == "content" and type(value) is list:
                for j, block in enumerate(value):
                    path, content, exact = f"{base}.content[{j}]", None, True
                    if type(block) is str:
                        content = block
                    elif type(block) is dict:
                        for key in P.BLOCK_TEXT_KEYS:
                            if type(block.get(key)) is str:
                                content, path = block[key], f"{path}.{key}"
                                break
                    if content is None:
                        content, exact = canonical(block), False
                    u.text(content, path)
                    kind = block["type"] if type(block) is dict and type(block.get("type")) is str else "unknown"
                    u.add("visible_text", f"message:{role}:content-block:{kind}", content, path, "content_blocks", f"{base}.content", i, role, element=i, block=j, ranged=exact)
                    u.check()
                continue
            path = f"{base}.{field}"
            content = value if type(value) is str else canonical(value)
            u.text(content, path)
            kind = "tool_call" if field in ("tool_calls", "function_call") else "tool_result" if field == "tool_call_id" and role == "tool" else "visible_text"
            u.add(kind, f"message:{role}:{field}", content, path, "messages", "$.messages", i, role, tool_identity(value) if kind != "visible_text" else None, i, ranged=kind == "visible_text" and type(value) is str)
            u.check()
    u.add("structural", "messages:end", "messages:end", "$.messages", "messages", "$.messages")
    u.check()
    return u.rows


PROJECTED = f"input_line bigint, request_id string, captured_at string, session_key string, endpoint_key string, agent_key string, model_deployment_key string, kv_namespace string, model string, units array<{UNIT}>, skip_code string, skip_args map<string,string>"
_KEPT = ("input_line", "request_id", "captured_at", "session_key", "endpoint_key", "agent_key", "model_deployment_key", "kv_namespace")


def project(records: DataFrame, options: AnalysisOptions = AnalysisOptions(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Identified records with model, units, domain columns and skip_code/skip_args of those that have none.

    ``carry``: further string columns to keep.
    """
    kept = (*_KEPT, *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            models, codes, args, sizes, flat = [], [], [], [], []
            for text in b.column(len(kept)).to_pylist():
                payload = json.loads(text)
                try:
                    rows = units_of(payload, options)
                    flat += rows
                    sizes.append(len(rows))
                    codes.append(None)
                    args.append(None)
                except Skip as s:
                    sizes.append(0)
                    codes.append(s.code)
                    args.append(list(s.args_.items()))
                models.append(payload["model"] if type(payload.get("model")) is str else None)
            columns = list(zip(*flat)) or [()] * len(_UNIT)
            units = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _UNIT)], [n for n, _ in _UNIT])
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(models, pa.string()), pa.ListArray.from_arrays(offsets, units), pa.array(codes, pa.string()), pa.array(args, pa.map_(pa.string(), pa.string()))],
                names=[*kept, "model", "units", "skip_code", "skip_args"],
            )

    schema = PROJECTED.replace("model string", "".join(f"{c} string, " for c in carry) + "model string", 1)
    rows = records.select(*kept, "payload").mapInArrow(run, schema)
    seconds = rfc3339_seconds("captured_at")
    # a request without time has no domain; that shows before its messages are looked into
    early = F.col("skip_code").isin("MissingModel", "MissingMessages", "MessagesNotArray")
    untimed = ~F.coalesce(early, F.lit(False)) & seconds.isNull()
    reason = F.when(F.col("captured_at").isNull(), "MissingCapturedAt").otherwise("InvalidCapturedAt")
    return (
        rows.withColumn("time_window_key", window_start(seconds, options.comparison_window_seconds))
        .withColumn("skip_args", F.when(untimed, F.create_map(F.lit("reason"), reason)).otherwise(F.col("skip_args")))
        .withColumn("skip_code", F.when(untimed, "InvalidComparisonGroup").otherwise(F.col("skip_code")))
    )


#: The columns of a comparison domain, in its order. Null is a value of its own.
DOMAIN = ("time_window_key", "endpoint_key", "model", "model_deployment_key", "agent_key", "kv_namespace")


def sequences(projected: DataFrame) -> DataFrame:
    return projected.where(F.col("skip_code").isNull()).drop("skip_code", "skip_args")


def projection_skips(projected: DataFrame) -> DataFrame:
    return skips(projected, "projection")


def unit_rows(seqs: DataFrame) -> DataFrame:
    """The exploded form: one row per unit."""
    return seqs.select("input_line", "request_id", F.posexplode("units").alias("unit_index", "u")).select("input_line", "request_id", F.col("unit_index").cast("bigint"), "u.*")
