"""Per-key results when a few keys hold most rows, by value-frequency compression.

Rows are first grouped by (key, value), which combines on the map side and spreads one key's values over
all tasks; the key alone is grouped only afterwards, over distinct values with their weights. Counts and
modes then combine on the map side again. Percentiles never bring a key's values together: weights are
summed over coarse bins of the value, the bin holding each rank is found among a bounded number of bins,
and only the values of that one bin are ordered, refining bin by bin down to single values. The compressed
rows are written once; a refining step reads of them what lies in the open bins.

Defined cases: rows with a null in any key column form a group of their own (null is a key); null values count in
``n_rows`` only; a key without values has nulls for mode and percentiles; ties of the mode go to the
smallest value; repeated rows count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlens.sources.tables import written

#: Significant bits of the first bins (at most 2**(BITS + 6) of them per key), and bits resolved by a refining step.
BITS, STEP = 8, 16


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def compress(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct (keys, value) with weights: columns k0.., v, w."""
    return df.groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{value}`").alias("v")).agg(F.count(F.lit(1)).alias("w"))


def weighted_stats(df: DataFrame, keys: list[str], value: str, percentiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Per key: n_rows, n_values, n_distinct, mode, mode_count and p<percent> of an integer column.

    The q-percentile is the smallest value with at least q of the key's values at or below it.
    """
    if dict(df.dtypes)[value] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("percentiles need an integer column; scale decimals first")
    ks = [f"k{i}" for i in range(len(keys))]
    packed = written(compress(df.withColumn(value, F.col(f"`{value}`").cast("bigint")), keys, value), "weighted-values")
    present = F.col("v").isNotNull()
    base = packed.groupBy(*ks).agg(
        F.sum("w").alias("n_rows"),
        F.coalesce(F.sum(F.when(present, F.col("w"))), F.lit(0)).alias("n_values"),
        F.count("v").alias("n_distinct"),
        F.max(F.when(present, F.struct(F.col("w"), (-F.col("v").cast("decimal(20,0)")).alias("neg")))).alias("top"),
    )
    out = base.select(*ks, "n_rows", "n_values", "n_distinct", (-F.col("top.neg")).cast("bigint").alias("mode"), F.col("top.w").alias("mode_count"))
    if percentiles:
        found = _percentiles(packed.where(present), ks, percentiles)
        out = out.alias("o").join(found.alias("f"), reduce(lambda x, y: x & y, [F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ks]), "left").select("o.*", *[F.col(f"f.p{_name(q)}") for q in percentiles])
    return out.select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], *[c for c in out.columns if c not in ks])


def _name(q: float) -> str:
    return f"{q * 100:g}".replace(".", "_")


def _leaf(v: Column) -> tuple[Column, Column]:
    """(bin of BITS significant bits, which keeps the order of values, and the bits left open in it)."""
    size = F.abs(F.greatest(v, F.lit(-(2**63) + 1)))
    left = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    code = (left * (1 << (BITS - 1))).cast("bigint") + F.call_function("shiftright", size, left)
    return F.when(v < 0, -code).otherwise(code), left


def _found(bins: DataFrame, ranks: DataFrame, ks: list[str], within: list[str], kept: list[str]) -> DataFrame:
    """The bin of each rank (ks, within, q, r) among bins (ks, within, bin, bw): r counts from the bin's start then."""
    joined = ranks.alias("s").join(bins.alias("b"), reduce(lambda x, y: x & y, [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*ks, *within]]))
    joined = joined.select(*[F.col(f"s.{k}").alias(k) for k in ks], "s.q", "s.r", *[f"b.{c}" for c in ("bin", "bw", *kept)])
    run = Window.partitionBy(*ks, "q").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most the bins of one step
    upto = joined.withColumn("upto", F.sum("bw").over(run)).where((F.col("upto") >= F.col("r")) & (F.col("upto") - F.col("bw") < F.col("r")))
    return upto.select(*ks, "q", (F.col("r") - F.col("upto") + F.col("bw")).alias("r"), "bin", *kept)


def _percentiles(packed: DataFrame, ks: list[str], percentiles: tuple[float, ...]) -> DataFrame:
    """Locate each rank among bins of BITS significant bits, then refine only the bins that hold one, STEP bits at a time."""
    qs = sorted(set(percentiles))
    leaf, left = _leaf(F.col("v"))
    packed = packed.select(*ks, "v", "w", leaf.alias("leaf"), left.alias("left"))
    total = packed.groupBy(*ks).agg(F.sum("w").alias("n"))
    ranks = total.select(
        *ks,
        F.explode(F.array(*[F.struct(F.lit(f"p{_name(q)}").alias("q"), F.greatest(F.ceil(F.lit(repr(q)).cast("decimal(20,10)") * F.col("n")).cast("bigint"), F.lit(1).cast("bigint")).alias("r")) for q in qs])).alias("t"),
    ).select(*ks, "t.q", "t.r")
    bins = packed.groupBy(*ks, F.col("leaf").alias("bin")).agg(F.sum("w").alias("bw"), F.max("left").alias("left"))
    # written, so that the planner knows it to be small, where it is
    state = written(_found(bins, ranks, ks, [], ["left"]).withColumnRenamed("bin", "leaf"), "weighted-ranks")
    shift = F.greatest(F.col("left") - STEP, F.lit(0))
    up = None
    while True:
        at = F.call_function("shiftright", F.col("r.v"), F.col("s.shift"))
        asked = state.withColumn("shift", shift)
        open_ = asked.select(*ks, "leaf", "shift", *([] if up is None else ["up", "left"])).distinct()
        on = reduce(lambda x, y: x & y, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*ks, "leaf"]])
        if up is not None:
            on = on & (F.call_function("shiftright", F.col("r.v"), F.col("s.left")) == F.col("s.up"))
        within = ["leaf"] if up is None else ["leaf", "up"]
        inside = packed.alias("r").join(open_.alias("s"), on).select(*[F.col(f"r.{k}").alias(k) for k in ks], *[f"s.{c}" for c in (*within, "shift")], at.alias("bin"), "r.w")
        bins = inside.groupBy(*ks, *within, "shift", "bin").agg(F.sum("w").alias("bw"))
        state = written(_found(bins, asked, ks, within, ["leaf", "shift"]).select(*ks, "q", "r", "leaf", F.col("bin").alias("up"), F.col("shift").alias("left")), "weighted-ranks")
        if not (state.agg(F.max("left")).first()[0] or 0):
            break
        up = "up"
    return state.groupBy(*ks).agg(*[F.max(F.when(F.col("q") == f"p{_name(q)}", F.col("up"))).alias(f"p{_name(q)}") for q in qs])


def heavy_keys(df: DataFrame, keys: list[str], share: float, value: str | None = None) -> DataFrame:
    """Keys that hold at least ``share`` of all rows of df (rows with null keys count in the total).

    Rows are compressed by (keys, value) first, so that even a key with most of the rows spreads over all
    tasks, and weights are summed per key. Columns: keys, n_rows, total_rows. Keys with a null part are not
    listed. ``value`` defaults to the keys themselves.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    packed = compress(df, keys, value if value is not None else keys[0])
    counts = packed.groupBy(*ks).agg(F.sum("w").alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("total_rows"))
    whole = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in ks])
    # the total is one row
    return (
        counts.where(whole).join(F.broadcast(total))
        .where(F.col("n_rows").cast("decimal(38,12)") >= F.col("total_rows").cast("decimal(20,0)") * F.lit(repr(share)).cast("decimal(12,10)"))
        .select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], "n_rows", "total_rows")
    )
