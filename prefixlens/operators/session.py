"""Sessions turn by turn: how each request continues the one before it.

Requests of a session are sorted by instant (unparsable first), then line, over any session size, and each is
measured against the one before it where it lies. The measures are native expressions over slim unit arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlens.functions.strings import saturating_sub
from prefixlens.functions.times import rfc3339_nanos
from prefixlens.operators.ordering import with_neighbours, with_previous
from prefixlens.operators.projection import CONTENT_KINDS
from prefixlens.sources.tables import pieces

DOMAIN_KEYS = ("endpoint_key", "model", "model_deployment_key", "agent_key", "kv_namespace")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def slim_units(units: Column) -> Column:
    """What turns are compared by; 64 bits of a unit's fingerprint, as only neighbours are compared."""
    return F.transform(units, lambda u: F.struct(F.xxhash64(u["fp"]).alias("fp"), u["bytes"].alias("bytes"), u["kind"].isin(*CONTENT_KINDS).alias("content")))


def block_runs(units: Column) -> Column:
    """Runs of equal content digests as ``digest x count``, joined by slashes; one pass over the units."""
    digests = F.transform(F.filter(units, lambda u: u["kind"].isin(*CONTENT_KINDS)), lambda u: u["digest"])
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"), F.lit(0).alias("n"))
    closed = lambda a: F.when(a["n"] == 0, "").otherwise(F.concat(a["done"], F.when(a["done"] == "", "").otherwise("/"), a["last"], F.lit("x"), a["n"].cast("string")))
    step = lambda a, d: F.when(
        (a["n"] > 0) & (a["last"] == d), F.struct(a["done"].alias("done"), a["last"].alias("last"), (a["n"] + 1).alias("n"))
    ).otherwise(F.struct(closed(a).alias("done"), d.alias("last"), F.lit(1).alias("n")))
    return F.aggregate(digests, start, step, closed)


def array_lcp(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays; a missing element equals nothing."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.array_position(same, F.lit(False))
    return F.when(miss == 0, F.size(a).cast("bigint")).otherwise(miss - 1).cast("bigint")


def _bytes(units: Column) -> Column:
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda s, u: s + u["bytes"])


def _fps(units: Column) -> Column:
    return F.transform(units, lambda u: u["fp"])


def z_run_bytes(old: list[str], new: list[str], sizes: list[int]) -> int:
    """Most bytes of ``new``, from any start, that repeat ``old`` from its beginning in order."""
    z, left, right, best = [0] * (len(old) + 1 + len(new)), 0, 0, 0
    s: list = [*old, None, *new]
    prefix = [0]
    for b in sizes:
        prefix.append(prefix[-1] + b)
    for i in range(1, len(s)):
        n = min(right - i, z[i - left]) if i < right else 0
        while i + n < len(s) and s[n] == s[i + n] and s[n] is not None:
            n += 1
        z[i] = n
        if i + n > right:
            left, right = i, i + n
        if i > len(old):
            best = max(best, prefix[n])
    return best


def _recovered(pairs: DataFrame) -> DataFrame:
    """Adds stable_after_switch_bytes from the arrays after the point of divergence, in Arrow batches."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in pairs.schema.fields if f.name not in ("_old", "_new")] + [T.StructField("stable_after_switch_bytes", T.LongType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [z_run_bytes([u["fp"] for u in o], [u["fp"] for u in n], [u["bytes"] for u in o]) if o and n else 0 for o, n in zip(b.column("_old").to_pylist(), b.column("_new").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:-1]), pa.array(out, pa.int64())], names=names)

    return pairs.mapInArrow(run, schema)


def _measures(pairs: DataFrame) -> DataFrame:
    """What each request has in common with the one before it; nulls where there is none."""
    p, n = F.col("prev_u"), F.col("u")
    pc, nc = F.filter(p, lambda x: x["content"]), F.filter(n, lambda x: x["content"])
    pairs = pairs.withColumns({"lcp_units": array_lcp(_fps(p), _fps(n)), "pc": _fps(pc), "nc": _fps(nc), "previous_total_bytes": _bytes(pc), "next_total_bytes": _bytes(n)})
    pairs = pairs.withColumn("content_lcp", array_lcp(F.col("pc"), F.col("nc")))
    kept = F.col("content_lcp")
    permuted = (F.size("pc") == F.size("nc")) & (F.size("pc") > 0) & (F.size(F.array_distinct("pc")) == F.size("pc")) & (F.array_sort("pc") == F.array_sort("nc"))
    event = (
        F.when((F.col("lcp_units") == F.size(p)) | ((kept == F.size("pc")) & (F.size("nc") > F.size("pc"))), "append")
        .when(permuted, "reorder").when(kept == 0, "reset").otherwise("fork")
    )
    start = (F.col("lcp_units") + 1).cast("int")
    domain = F.lit(False)
    for k in DOMAIN_KEYS:
        domain = domain | ~F.col(k).eqNullSafe(F.col(f"prev_{k}"))
    measured = pairs.select(
        "session_key", event.alias("event_type"), "prev_request_id", F.col("request_id").alias("next_request_id"),
        "lcp_units", _bytes(F.slice(p, F.lit(1), F.col("lcp_units").cast("int"))).alias("lcp_bytes"), "previous_total_bytes", _bytes(F.slice(pc, F.lit(1), kept.cast("int"))).alias("retained_prefix_bytes"),
        domain.alias("domain_changed"), "next_total_bytes", F.col("runs").alias("next_block_runs"), "prev_endpoint_key", "prev_model", "_place",
        F.slice(p, start, F.greatest(F.size(p), F.lit(1))).alias("_old"), F.slice(n, start, F.greatest(F.size(n), F.lit(1))).alias("_new"),
    )
    return _recovered(measured)


def session_events(seqs: DataFrame) -> DataFrame:
    """One row per consecutive pair of requests of a session, in order of instant, then line."""
    rows = seqs.where(F.col("session_key").isNotNull()).select(
        "session_key", rfc3339_nanos("captured_at").alias("ts"), "input_line", "request_id", *DOMAIN_KEYS, slim_units(F.col("units")).alias("u"), block_runs(F.col("units")).alias("runs")
    )
    found = with_neighbours(rows, ["session_key"], ["ts", "input_line"], "next_sequence", _measures).where("prev_request_id IS NOT NULL").withColumn("previous_sequence", F.col("next_sequence") - 1)
    found = with_previous(found, ["session_key"], "next_sequence", ["lcp_bytes"], "before_")
    before = F.coalesce("before_lcp_bytes", _zero())
    abandoned = saturating_sub(F.col("previous_total_bytes"), F.col("retained_prefix_bytes"))
    return found.select(
        "session_key", "event_type", "previous_sequence", "next_sequence", "prev_request_id", "next_request_id", "lcp_units", "lcp_bytes",
        before.alias("previous_pair_lcp_bytes"), saturating_sub(before, F.col("lcp_bytes")).alias("prefix_cut_bytes"), "previous_total_bytes", "retained_prefix_bytes",
        F.when(F.col("previous_total_bytes") > 0, F.col("retained_prefix_bytes") / F.col("previous_total_bytes")).alias("prefix_reuse_ratio"),
        abandoned.alias("abandoned_prefix_bytes"), (F.col("retained_prefix_bytes") < F.col("previous_total_bytes")).alias("prefix_reuse_outlier"), "domain_changed", "next_total_bytes",
        saturating_sub(F.col("next_total_bytes"), F.col("lcp_bytes")).alias("recomputed_bytes"), "stable_after_switch_bytes", "next_block_runs", "prev_endpoint_key", "prev_model",
    )


#: The public columns of an event.
EVENT_COLUMNS = (
    "session_key", "event_type", "previous_sequence", "next_sequence", "prev_request_id", "next_request_id", "lcp_units", "lcp_bytes", "previous_pair_lcp_bytes", "prefix_cut_bytes",
    "previous_total_bytes", "retained_prefix_bytes", "prefix_reuse_ratio", "abandoned_prefix_bytes", "prefix_reuse_outlier", "domain_changed", "next_total_bytes", "recomputed_bytes",
    "stable_after_switch_bytes", "next_block_runs",
)


def session_reports(events: DataFrame) -> DataFrame:
    """Totals per session of at least two requests; endpoint and model are the first request's."""
    count = lambda kind: F.count_if(F.col("event_type") == kind).alias(f"{kind}_count")
    total = lambda c, name: F.sum(c).cast("bigint").alias(name)
    return events.groupBy("session_key").agg(
        F.min_by("prev_endpoint_key", "previous_sequence").alias("endpoint_key"), F.min_by("prev_model", "previous_sequence").alias("model"), (F.count(F.lit(1)) + 1).alias("request_count"),
        *map(count, ("append", "fork", "reorder", "reset")), F.count_if("prefix_reuse_outlier").alias("context_refresh_count"),
        total("recomputed_bytes", "total_recomputed_bytes"), total("stable_after_switch_bytes", "total_stable_after_switch_bytes"), total("prefix_cut_bytes", "total_prefix_cut_bytes"),
        F.floor(F.sum("prefix_cut_bytes") / F.count(F.lit(1))).cast("bigint").alias("avg_prefix_cut_bytes"), total("abandoned_prefix_bytes", "total_abandoned_prefix_bytes"), F.count_if("domain_changed").alias("domain_change_count"),
    )


def ranked_reports(reports: DataFrame) -> DataFrame:
    """Most refreshes first, then most abandoned bytes, then the key."""
    return reports.orderBy(F.desc("context_refresh_count"), F.desc("total_abandoned_prefix_bytes"), "session_key")
