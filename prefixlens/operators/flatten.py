"""Deeply nested records as flat tables with parent links, by Arrow list offsets.

Two layers:

* ``flatten_list`` takes any DataFrame with a column of lists (of structs, of lists, ...) and emits one
  row per element. Inside each Arrow batch the child array is the list's own value buffer; the parent of
  each element comes from the list offsets (``list_parent_indices``) and every key column follows by one
  vectorised ``take``. No row is looked at in Python.
* ``flatten_payloads`` does the same for JSON payload text: each text is decoded once into nested Arrow
  lists (messages > blocks, tools) and those are flattened by the same kernels into one long table.

Defined cases: a null or empty list gives no rows; a null element keeps its row with null fields; a null
key stays null; repeated parents give repeated children; extra columns are ignored, so their names cannot
clash with the output's; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixlens.sources import payload as P
from prefixlens.sources.tables import spread


def child_index(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(elements, parent row of each, index of each within its parent) of a list array, from its offsets."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    parents = pc.list_parent_indices(lists)
    parent = parents.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    return pc.list_flatten(lists), parent, pa.array(np.arange(len(parent), dtype=np.int64) - starts[parent])


def flatten_list(df: DataFrame, column: str, keys: list[str], index: str = "element_index", element: str = "element") -> DataFrame:
    """One row per element of ``column``: keys, position in the parent, and the element.

    A struct element is spread into its fields; a field whose name is taken gets ``element`` and an
    underscore in front (more underscores while that is taken too).
    """
    fields = [df.schema[k] for k in keys]
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{column} is no array")
    names, spread = [*keys, index], isinstance(kind.elementType, T.StructType)
    out = T.StructType([*fields, T.StructField(index, T.LongType())])
    for f in kind.elementType.fields if spread else [T.StructField(element, kind.elementType)]:
        name = f.name
        while name in names:
            name = f"{element}_{name}" if not name.startswith(f"{element}_") else f"{element}_{name[len(element):]}"
        names.append(name)
        out.add(name, f.dataType, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            child, parent, position = child_index(b.column(len(keys)))
            take = pa.array(parent)
            cols = [b.column(i).take(take) for i in range(len(keys))] + [position]
            if spread:
                # struct_field() applies the struct's own nulls to its fields
                cols += [pc.struct_field(child, [i]) for i in range(child.type.num_fields)]
            else:
                cols.append(child)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{column}`")).mapInArrow(run, out)


#: The sections of the long table.
MESSAGE, BLOCK, TOOL = "message", "block", "tool"
KEY_SCHEMA = "input_line bigint, section string, element_index bigint, block_index bigint"
FULL_SCHEMA = KEY_SCHEMA + ", role string, kind string, type string, value string"


def _kind(v: object) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")


class _Level:
    """A child level while payloads are decoded: sizes per parent and the flat value columns."""

    def __init__(self, full: bool):
        self.sizes: list[int] = []
        self.role: list = []
        self.kind: list = []
        self.type: list = []
        self.value: list = []
        self.full = full

    def lists(self, total: int) -> pa.ListArray:
        offsets = np.zeros(len(self.sizes) + 1, dtype=np.int32)
        np.cumsum(self.sizes, out=offsets[1:])
        if self.full:
            values = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (self.role, self.kind, self.type, self.value)], ["role", "kind", "type", "value"])
        else:
            values = pa.nulls(total)
        return pa.ListArray.from_arrays(pa.array(offsets), values)


def _string(v: object) -> str | None:
    return P.clean(v) if type(v) is str else None


def _element(level: _Level, item: object, value: str | None) -> None:
    level.role.append(_string(item.get("role")) if type(item) is dict else None)
    level.kind.append(_kind(item))
    level.type.append(_string(item.get("type")) if type(item) is dict else None)
    level.value.append(P.clean(value))


def decode(payloads: list[str | None], full: bool) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
    """Payload texts as nested lists: messages per payload, blocks per message, tools per payload.

    A payload that is not sound has no messages and no tools.
    """
    messages, blocks, tools = _Level(full), _Level(full), _Level(full)
    n = [0, 0, 0]
    for text in payloads:
        o = P.sound(text)
        found = o["messages"] if o is not None else ()
        declared = o.get("tools") if o is not None else None
        declared = declared if type(declared) is list else ()
        messages.sizes.append(len(found))
        tools.sizes.append(len(declared))
        n[0] += len(found)
        n[2] += len(declared)
        for m in found:
            content = m.get("content")
            inner = content if type(content) is list else ()
            blocks.sizes.append(len(inner))
            n[1] += len(inner)
            if full:
                _element(messages, m, content if type(content) is str else None)
                messages.kind[-1] = _kind(content) if "content" in m else "absent"
                for b in inner:
                    _element(blocks, b, P.block_string(b))
        if full:
            for t in declared:
                name = None
                if type(t) is dict:
                    name = t.get("name")
                    if type(name) is not str and type(t.get("function")) is dict:
                        name = t["function"].get("name")
                _element(tools, t, name if type(name) is str else None)
    return messages.lists(n[0]), blocks.lists(n[1]), tools.lists(n[2])


def flatten_payloads(df: DataFrame, line: str = "input_line", payload: str = "payload", full: bool = True) -> DataFrame:
    """The long table of messages, blocks and tools of every sound payload, linked by (input_line, indexes).

    Columns: the keys of KEY_SCHEMA; with ``full`` also role, kind (JSON type of a message's content, of a
    block or tool itself), type, and value (string content, a block's string, a tool's name). Lone
    surrogates become question marks. Payloads that are null, no JSON or not sound give no rows.
    """

    def rows(keys: pa.Array, lists: pa.ListArray, section: str, parent_index: pa.Array | None) -> tuple[pa.RecordBatch, pa.Array, pa.Array]:
        child, parent, position = child_index(lists)
        take = pa.array(parent)
        line_of = keys.take(take)
        none = pa.array(np.full(len(parent), -1, dtype=np.int64))
        element, block = (position, none) if parent_index is None else (parent_index.take(take), position)
        cols = [line_of, pa.repeat(pa.scalar(section), len(parent)), element, block]
        names = ["input_line", "section", "element_index", "block_index"]
        if full:
            cols += [pc.struct_field(child, [i]) for i in range(4)]
            names += ["role", "kind", "type", "value"]
        return pa.RecordBatch.from_arrays(cols, names=names), line_of, position

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0)
            messages, blocks, tools = decode(b.column(1).to_pylist(), full)
            out, line_of, position = rows(keys, messages, MESSAGE, None)
            yield out
            yield rows(line_of, blocks, BLOCK, position)[0]
            yield rows(keys, tools, TOOL, None)[0]

    picked = df.select(F.col(f"`{line}`").cast("bigint").alias("input_line"), F.col(f"`{payload}`").cast("string").alias("payload"))
    return spread(picked).mapInArrow(run, FULL_SCHEMA if full else KEY_SCHEMA)


def messages_table(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("section") == MESSAGE).select("input_line", F.col("element_index").alias("message_index"), "role", F.col("kind").alias("content_kind"), F.col("value").alias("content"))


def blocks_table(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("section") == BLOCK).select("input_line", F.col("element_index").alias("message_index"), "block_index", F.col("kind").alias("block_kind"), F.col("type").alias("block_type"), F.col("value").alias("text"))


def tools_table(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("section") == TOOL).select("input_line", F.col("element_index").alias("tool_index"), F.col("kind").alias("tool_kind"), F.col("type").alias("tool_type"), F.col("value").alias("name"))
