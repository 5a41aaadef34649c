"""Cache metrics of every loaded record: reported where usage is present, else estimated from payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixlens.operators.ordering import with_neighbours, with_previous


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: slices compare as memory."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _lcp(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else common_prefix(x.encode(), y.encode()) for x, y in zip(a, b)], dtype="Int64")


def byte_lcp(a: Column, b: Column) -> Column:
    """Common prefix of two strings in UTF-8 bytes; null where either is null."""
    return F.pandas_udf(_lcp, T.LongType())(a, b)


def cache_metrics(records: DataFrame) -> DataFrame:
    """Per record of identified records, in session order by the text of captured_at, then line.

    Records without a session are one group whose neighbours are compared too. A hit rate is cached over
    prompt tokens where usage was reported, else the bytes shared with the payload before over all bytes.
    """
    rows = records.select("request_id", "session_key", "input_line", "captured_at", "source", "response_usage", "payload", F.coalesce("captured_at", F.lit("")).alias("_at"))
    kept = ("request_id", "session_key", "captured_at", "source", "response_usage")

    def measure(pairs: DataFrame) -> DataFrame:
        return pairs.select(*kept, byte_lcp(F.col("payload"), F.col("prev_payload")).alias("lcp"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), "_place")

    return with_deltas(with_neighbours(rows, ["session_key"], ["_at", "input_line"], "sequence", measure))


def with_deltas(rows: DataFrame) -> DataFrame:
    """Rates, bases and first differences of numbered rows with response_usage, lcp and payload_bytes."""
    usage = F.col("response_usage")
    reported = usage.isNotNull()
    prompt, cached = usage["prompt_tokens"], F.least(usage["cached_tokens"], usage["prompt_tokens"])
    rate = F.when(reported, F.when(prompt > 0, cached / prompt).otherwise(F.lit(0.0))).otherwise(
        F.when(F.col("payload_bytes") > 0, F.coalesce("lcp", F.lit(0)) / F.col("payload_bytes")).otherwise(F.lit(0.0))
    )
    rated = rows.withColumn("hit_rate", rate.cast("double"))
    rated = with_previous(rated, ["session_key"], "sequence", ["hit_rate"])
    return rated.select(
        "request_id", "session_key", "sequence", "captured_at", "source", prompt.alias("prompt_tokens"), F.when(reported, cached).alias("cached_tokens"),
        F.when(reported, F.greatest(prompt - cached, F.lit(0))).alias("miss_tokens"), usage["completion_tokens"].alias("output_tokens"), "hit_rate",
        (F.col("hit_rate") - F.col("prev_hit_rate")).alias("hit_rate_delta"), F.when(reported, "reported").otherwise("estimated").alias("basis"),
        F.when(~reported, F.col("lcp")).alias("estimated_lcp_bytes"), "payload_bytes", usage["ttft_ms"].alias("ttft_ms"), usage["total_ms"].alias("total_ms"),
    )


def usage_by_session(metrics: DataFrame) -> DataFrame:
    """Token-weighted hit rate per session over reported rows."""
    rows = metrics.where((F.col("basis") == "reported") & F.col("session_key").isNotNull())
    return rows.groupBy("session_key").agg(F.sum("cached_tokens").alias("cached_tokens"), F.sum("prompt_tokens").alias("prompt_tokens"), F.count(F.lit(1)).alias("reported_rows"), F.coalesce(F.try_divide(F.sum("cached_tokens").cast("double"), F.sum("prompt_tokens").cast("double")), F.lit(0.0)).alias("hit_rate"))


def metric_totals(metrics: DataFrame) -> DataFrame:
    """Unweighted mean hit rate and rows per basis."""
    return metrics.agg(F.count(F.lit(1)).alias("rows"), F.avg("hit_rate").alias("mean_hit_rate"), F.count_if(F.col("basis") == "reported").alias("reported"), F.count_if(F.col("basis") == "estimated").alias("estimated"))
