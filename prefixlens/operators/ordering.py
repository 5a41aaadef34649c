"""Row numbers, running sums and predecessors within groups of any size.

A window over a group sorts the whole group in one task. Here rows are range-partitioned by (keys, order)
instead, so that a large group spans many tasks, numbered inside each partition, and shifted by the rows of
the same group in earlier partitions (one narrow row per partition and group). Looking at a neighbour is then
an equi-join on (keys, number), which spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixlens.sources.tables import pieces, written


def _equal(a: str, b: str, keys: list[str]):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str, small: bool = False) -> DataFrame:
    """df with the 1-based number of each row within its keys, by ``order`` (nulls first).

    ``order`` should be total; ties are numbered in any order. ``small`` says that groups are bounded, then
    a plain window does it. The table is written once, so that its partitions stay what they were.
    """
    if small and keys:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    inside = placed.withColumn("_pid", F.spark_partition_id())
    inside = written(inside.withColumn("_seq", F.monotonically_increasing_id()), "ordered")
    per = inside.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_c"), F.min("_seq").alias("_first"))
    # one row per partition and group; a group's rows here are at most the number of partitions
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("_offset", F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).select("_pid", *keys, "_offset")
    joined = inside.alias("r").join(offsets.alias("o"), _equal("r", "o", ["_pid", *keys]))
    return joined.select("r.*", (F.col("r._seq") + F.col("o._offset") + 1).alias(out)).drop("_pid", "_seq")


def running_sums(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of the whole numbers ``value`` up to and including each row, within its keys, by a total ``order``."""
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_inside", T.LongType())])
    at, of = [df.columns.index(k) for k in keys], df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, carried = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for i in at:
                codes = b.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            first, last = ([b.column(i)[j].as_py() for i in at] for j in (0, b.num_rows - 1))
            upto = np.cumsum(b.column(of).to_numpy())
            starts = np.flatnonzero(new)
            base = np.zeros(b.num_rows, np.int64)
            base[starts] = np.diff(np.append(0, upto[starts - 1]))
            upto = upto - np.cumsum(base)
            if first == before:
                upto[: starts[0] if len(starts) else None] += carried
            before, carried = last, int(upto[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto)], names=[*b.schema.names, "_inside"])

    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_pid", F.spark_partition_id())
    inside = written(placed.mapInArrow(run, schema), "summed")
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition and group
    offsets = inside.groupBy("_pid", *keys).agg(F.sum(value).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).select("_pid", *keys, "_before")
    joined = inside.alias("r").join(offsets.alias("o"), _equal("r", "o", ["_pid", *keys]))
    return joined.select("r.*", (F.col("r._inside") + F.col("o._before")).alias(out)).drop("_pid", "_inside")


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], number: str, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``measure`` of every row together with the row before it in its keys, by a total ``order``, and its number.

    Rows are range-partitioned and sorted once, so that the row before is the one at hand. ``measure`` gets df with
    a ``prev_`` copy of each column (null where there is none yet) and ``_place``; it keeps all rows, ``_place``,
    the keys and what else is wanted. Only its result is written. A partition's first row may belong to the last
    one before it: these rows, at most one per partition, are joined and measured again.
    """
    columns = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"prev_{f.name}", f.dataType) for f in df.schema.fields], *[T.StructField(n, t) for n, t in (("_pid", T.IntegerType()), ("_n", T.LongType()), ("_first", T.BooleanType()), ("_last", T.BooleanType()))]])
    at, m = [columns.index(k) for k in keys], len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, count, first = None, None, 0, True
        for b in pieces(batches):
            if held is not None:
                yield held
            rows = b.num_rows
            cols = [b.column(i) if before is None else pa.concat_arrays([before.column(i), b.column(i)]) for i in range(m)]
            new = np.zeros(len(cols[0]), bool)
            new[0] = True
            for i in at:
                codes = cols[i].dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new)
            n = np.arange(len(new)) - np.repeat(starts, np.diff(np.append(starts, len(new)))) + 1
            if before is not None:
                n[: starts[1] if len(starts) > 1 else None] += count - 1
                new, n = new[1:], n[1:]
            take = pa.array(np.arange(rows) - (before is None), mask=new)
            flags = np.zeros(rows, bool)
            flags[0], first = first, False
            held = [*b.columns[:m], *(c.take(take) for c in cols), b.column(m), pa.array(n), pa.array(flags)]
            held = pa.RecordBatch.from_arrays([*held, pa.array(np.zeros(rows, bool))], names=names)
            before, count = b.slice(rows - 1), int(n[-1])
        if held is not None:
            yield held.set_column(len(names) - 1, "_last", pa.array(np.arange(held.num_rows) == held.num_rows - 1))

    names = schema.names
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_pid", F.spark_partition_id())
    edge = F.when(F.col("_first") | F.col("_last"), F.struct(*columns)).alias("edge")
    place = F.struct(F.col("_pid").alias("pid"), F.col("_n").alias("n"), F.col("_first").alias("first"), F.col("_last").alias("last"), edge)
    pairs = placed.mapInArrow(run, schema).withColumn("_place", place).drop("_pid", "_n", "_first", "_last")
    measured = written(measure(pairs), "neighbours")
    # from here on: one row per partition, or per partition and group
    pids = measured.where("_place.first").select(F.col("_place.pid").alias("pid"))
    follows = pids.withColumn("before", F.lag("pid").over(Window.orderBy("pid"))).where("before IS NOT NULL")
    last = measured.where("_place.last").select(F.col("_place.pid").alias("before"), F.col("_place.edge").alias("_e"))
    heads = measured.where("_place.first").select(F.col("_place.pid").alias("pid"), "_place").join(follows, "pid").join(last, "before")
    for k in keys:
        heads = heads.where(F.col(f"_place.edge.{k}").eqNullSafe(F.col(f"_e.{k}")))
    again = heads.select(*[F.col(f"_place.edge.{c}").alias(c) for c in columns], *[F.col(f"_e.{c}").alias(f"prev_{c}") for c in columns], "_place")
    rest = measured.join(heads.select(F.col("pid").alias("_again")), F.col("_place.first") & (F.col("_place.pid") == F.col("_again")), "left_anti")
    every = rest.unionByName(measure(again).select(*rest.columns)).withColumns({"_pid": F.col("_place.pid"), number: F.col("_place.n")}).drop("_place")
    per = measured.groupBy(F.col("_place.pid").alias("_pid"), *keys).agg(F.max("_place.n").alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("_offset", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).where("_offset > 0").select("_pid", *keys, "_offset")
    joined = every.alias("r").join(offsets.alias("o"), _equal("r", "o", ["_pid", *keys]), "left")
    return joined.select(*[F.col(f"r.{c}") for c in every.columns if c not in (number, "_pid")], (F.col(f"r.{number}") + F.coalesce("o._offset", F.lit(0))).alias(number))


def with_previous(df: DataFrame, keys: list[str], number: str, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """df with ``columns`` of the row numbered one less in the same group, null for the first."""
    before = df.select(*[F.col(k) for k in keys], (F.col(number) + 1).alias(number), *[F.col(c).alias(prefix + c) for c in columns])
    joined = df.alias("r").join(before.alias("p"), _equal("r", "p", [*keys, number]), "left")
    return joined.select("r.*", *[F.col(f"p.{prefix}{c}") for c in columns])
