"""Mergeable percentiles of very large numeric columns: q-digests over a bounded ordered universe.

Values are quantized to a universe of ``2**DEPTH`` leaves that keeps their order: exact up to ``2**BITS``,
above that ``BITS`` significant bits. The leaves are the bottom of a dyadic tree. A digest holds counts on
nodes of that tree; counts that are small together with their sibling's and parent's move to the parent.
With n values and compression k no inner node holds more than n/k, and at most DEPTH inner nodes straddle any
value, so between two leaves every rank read from the digest is wrong by at most ``DEPTH * n / k``; values of
one leaf are not told apart. ``percentiles`` states for each result how far its rank can be off, both
causes included. Digests are merged by adding the counts of equal nodes and compressing again; each merge of
compressed digests keeps the bound for the merged n.

A group's rows are brought to one task, which counts its leaves and compresses them there; only the digest
leaves it. A group of more rows than ``GROUP_ROWS`` (a hot key) goes to several tasks by its rows' ids, whose
digests are merged. At most N / GROUP_ROWS groups of N rows can be so large, and GROUP_ROWS grows where these
would be over a million, so the list of them is bounded.

Defined cases: null values are not counted, measured zeros are; a group without values has no digest;
negative values mirror positive ones; ties are counts; rows that repeat an id with equal values count once;
null group keys form a group; an empty table gives an empty digest; key columns may not be named like the
digest's own columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from prefixlens.sources.tables import written

#: Significant bits that quantization keeps, and the depth of the tree over the universe.
BITS, DEPTH = 16, 22
#: Compression: ranks between leaves are right within DEPTH / K of n.
K = 4400
#: Rows of a group that one task takes.
GROUP_ROWS = 1 << 20
_HALF = 1 << (BITS - 1)
_ZERO = 1 << (DEPTH - 1)


def leaves_of(v: np.ndarray) -> np.ndarray:
    """Numbers of the leaves of 64-bit values, in the order of values; the middle of the universe is 0."""
    size = np.abs(np.maximum(v, -(2**63) + 1))
    # floats round up near powers of two, so the shift is corrected
    shift = np.maximum(np.frexp(size.astype(np.float64))[1].astype(np.int64) - BITS, 0)
    shift = np.where((shift > 0) & (size >> np.maximum(shift - 1, 0) < 1 << BITS), shift - 1, shift)
    code = shift * _HALF + (size >> shift)
    return np.where(v < 0, _ZERO - code, _ZERO + code)


def _bounds(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each leaf."""
    # leaves beyond the largest 64-bit value stand for it
    code = np.minimum(np.abs(leaves - _ZERO), (63 - BITS) * _HALF + (1 << BITS) - 1)
    shift = np.maximum(code // _HALF - 1, 0)
    base = code - shift * _HALF
    low = base << shift
    high = low + (np.int64(1) << shift) - 1
    negative = leaves < _ZERO
    return np.where(negative, -high, low), np.where(negative, -low, high)


def _node_bounds(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value under each node."""
    level = np.frexp(node.astype(np.float64))[1].astype(np.int64) - 1
    first = (node << (DEPTH - level)) - (1 << DEPTH)
    return _bounds(first)[0], _bounds(first + (np.int64(1) << (DEPTH - level)) - 1)[1]


def _compress(group: np.ndarray, node: np.ndarray, w: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Move small counts upwards, a level at a time, in all groups at once."""
    if not limit.any():
        return group, node, w
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in range(DEPTH, 0, -1):
        here = node >> level == 1
        if not here.any():
            continue
        parent_level = node >> (level - 1) == 1
        g, p, c = group[here | parent_level], np.where(here, node >> 1, node)[here | parent_level], w[here | parent_level]
        key = g * (1 << DEPTH) + p
        unique, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, c, len(unique)).astype(np.int64)
        up = total <= limit[unique >> DEPTH]
        moved = up[inverse]
        stays = here.copy()
        stays[np.flatnonzero(here | parent_level)[moved]] = False
        done.append((group[stays], node[stays], w[stays]))
        rest = ~here
        rest[np.flatnonzero(here | parent_level)[moved]] = False
        group = np.concatenate([group[rest], unique[up] >> DEPTH])
        node = np.concatenate([node[rest], unique[up] & ((1 << DEPTH) - 1)])
        w = np.concatenate([w[rest], total[up]])
    done.append((group, node, w))
    return tuple(np.concatenate(x) for x in zip(*done))


def _runs(table: pa.Table, keys: int) -> np.ndarray:
    """Where groups start; equal keys are neighbours."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for i in range(keys):
        codes = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups; rows come sorted by their keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        starts = _runs(pa.Table.from_batches([b]), keys)
        if held and all(held[-1].column(i)[-1].as_py() == b.column(i)[0].as_py() for i in range(keys)):
            starts = starts[1:]
        if len(starts):
            if starts[-1]:
                held.append(b.slice(0, starts[-1]))
            if held:
                yield pa.Table.from_batches(held)
            held, b = [], b.slice(starts[-1])
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _digests(table: pa.Table, keys: int, starts: np.ndarray, group: np.ndarray, node: np.ndarray, w: np.ndarray, k: int, schema: pa.Schema, more: dict[str, object]) -> pa.RecordBatch:
    """Compressed digests of counts that may repeat a node; groups without any are left out."""
    unique, inverse = np.unique(group.astype(np.int64) << (DEPTH + 1) | node, return_inverse=True)
    w = np.bincount(inverse, w, len(unique)).astype(np.int64)
    group, node = unique >> (DEPTH + 1), unique & ((1 << (DEPTH + 1)) - 1)
    n = np.bincount(group, w, len(starts)).astype(np.int64)
    group, node, w = _compress(group, node, w, n // k)
    order = np.lexsort((node, group))
    group, node, w = group[order], node[order], w[order]
    present = np.flatnonzero(n)
    offsets = pa.array(np.append(np.searchsorted(group, present), len(group)).astype(np.int32))
    take = pa.array(starts[present])
    columns = [table.column(i).combine_chunks().take(take) for i in range(keys)]
    columns += [pa.array([v] * len(present), schema.field(name).type) if not isinstance(v, np.ndarray) else pa.array(v[present]) for name, v in more.items()]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n[present]), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (node, w))], schema=schema)


def _schema(df: DataFrame, keys: list[str], **more: T.DataType) -> T.StructType:
    own = [T.StructField(name, kind) for name, kind in (*more.items(), ("n", T.LongType()), ("nodes", T.ArrayType(T.LongType())), ("weights", T.ArrayType(T.LongType())))]
    return T.StructType([df.schema[c] for c in keys] + own)


def digest(df: DataFrame, keys: list[str], values: list[str], row_id: str, k: int = K, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A digest per group and value column: keys, metric (the column), n, nodes, weights.

    Rows that agree in keys, ``row_id`` and values count once. ``df`` is read twice, the first time its keys only.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    every = sizes.agg(F.sum("_rows")).first()[0] or 0
    most = max(group_rows, every // GROUP_ROWS)
    hot = sizes.where(F.col("_rows") > most).select(*[F.col(c).alias(f"_{c}") for c in keys], F.ceil(F.col("_rows") / most).alias("_parts"))
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # the hot groups are at most every / most rows
    rows = df.select(*keys, row_id, *[F.col(v).cast("bigint").alias(v) for v in values]).join(F.broadcast(hot), on, "left")
    part = F.when(F.col("_parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(row_id), "_parts")).cast("int")
    placed = rows.withColumn("_part", part).select(*keys, "_part", row_id, *values).repartition(*keys, "_part")
    # equal rows are in one partition already: no further shuffle
    once = placed.groupBy(*keys, "_part", row_id, *values).agg(F.lit(0).alias("_0")).select(*keys, "_part", *values).sortWithinPartitions(*keys, "_part")
    m, schema = len(keys) + 1, _schema(once, [*keys, "_part"], metric=T.StringType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, m):
            starts = _runs(t, m)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
            for i, name in enumerate(values):
                column = t.column(m + i).combine_chunks()
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                node = (1 << DEPTH) + leaves_of(column.drop_null().to_numpy())
                yield _digests(t, m, starts, group[there], node, np.ones(len(there)), k, arrow, {"metric": name})

    parts = written(once.mapInArrow(run, schema), "quantile-digests")
    whole = parts.where("_part < 0").drop("_part")
    return whole.unionByName(merge(parts.where("_part >= 0"), [*keys, "metric"], k))


def merge(digests: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Digests of parts (days, partitions, ...) as one digest per ``keys``, by adding nodes.

    Nodes are added before they come together, so a group's task gets each node once.
    """
    schema = _schema(digests, keys)
    arrow, m = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, m):
            starts = _runs(t, m)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
            yield _digests(t, m, starts, group, t.column(m).to_numpy(), t.column(m + 1).to_numpy(), k, arrow, {})

    added = digests.select(*keys, F.explode(F.arrays_zip("nodes", "weights")).alias("x")).groupBy(*keys, F.col("x.nodes").alias("node")).agg(F.sum("x.weights").alias("w"))
    return added.select(*keys, "node", "w").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def percentiles(digests: DataFrame, keys: list[str], qs: tuple[float, ...]) -> DataFrame:
    """Per group and q: n, the interval [low, high] that holds the exact percentile, and rank_error.

    The exact q-percentile is the smallest value with at least q of the group's values at or below it.
    ``rank_error``: at most so many more values than asked for lie at or below high. Digests stay where they are.
    """
    schema = T.StructType([digests.schema[c] for c in keys] + [T.StructField("q", T.DoubleType())] + [T.StructField(c, T.LongType()) for c in ("n", "low", "high", "rank_error")])
    arrow, m = to_arrow_schema(schema), len(keys)
    asked = [Fraction(repr(q)) for q in qs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nodes, weights = b.column(m + 1), b.column(m + 2)
            sizes = np.diff(nodes.offsets.to_numpy())
            group = np.repeat(np.arange(b.num_rows), sizes)
            w, n = weights.flatten().to_numpy(), b.column(m).to_numpy()
            low, high = _node_bounds(nodes.flatten().to_numpy())
            before = np.cumsum(n) - n
            sides = []
            for x in (low, high):
                order = np.lexsort((x, group))
                sides.append((x[order], np.cumsum(w[order])))
            out = []
            for q, f in zip(qs, asked):
                rank = np.maximum(-(-f.numerator * n // f.denominator), 1)
                # cumulative counts rise over all groups, so one search finds every group's place
                (lows, may), (highs, sure) = sides
                a, z = lows[np.searchsorted(may, before + rank)], highs[np.searchsorted(sure, before + rank)]
                below = np.bincount(group[low <= z[group]], w[low <= z[group]], b.num_rows).astype(np.int64)
                out.append(pa.RecordBatch.from_arrays([*b.columns[:m], *map(pa.array, (np.full(b.num_rows, q), n, a, z, below - rank))], schema=arrow))
            yield from out

    return digests.select(*keys, "n", "nodes", "weights").mapInArrow(run, schema)
