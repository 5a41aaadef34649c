"""Structural reuse of prefixes: what sessions keep, and what fixing known defects could add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlens.functions.strings import safe_ratio

#: Requests listed with a gain.
LISTED = 500


def request_potential(defects: DataFrame) -> DataFrame:
    """Per request: the most blocked stable bytes of its defects, and their ids. All variants count."""
    members = defects.select("id", "blocked_stable_bytes", F.explode("variants").alias("v")).select("id", "blocked_stable_bytes", F.explode("v.member_request_ids").alias("request_id"))
    return members.groupBy("request_id").agg(F.max("blocked_stable_bytes").alias("blocked"), F.array_sort(F.collect_set("id")).alias("defect_ids"))


def event_potential(events: DataFrame, potential: DataFrame | None) -> DataFrame:
    """Events with the prefix they could reach: reusable <= potential <= total."""
    if potential is None:
        joined = events.withColumn("blocked", F.lit(0).cast("bigint")).withColumn("defect_ids", F.array().cast("array<string>"))
    else:
        joined = events.join(potential.withColumnRenamed("request_id", "next_request_id"), "next_request_id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(0).cast("bigint")))
    return joined.withColumn("potential", F.greatest("lcp_bytes", F.least(F.col("lcp_bytes") + F.col("blocked"), F.col("next_total_bytes"))))


def by_session(potentials: DataFrame) -> DataFrame:
    return potentials.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("request_pairs"), F.sum("lcp_bytes").alias("lcp_bytes"), F.sum("next_total_bytes").alias("context_bytes"),
        safe_ratio(F.sum("lcp_bytes"), F.sum("next_total_bytes")).alias("ratio"), F.sum("potential").alias("potential_lcp_bytes"), (F.sum("potential") - F.sum("lcp_bytes")).alias("gain_bytes"),
    )


def summary(sessions: DataFrame, reports: DataFrame) -> DataFrame:
    """One row over all sessions; no row where there is no pair."""
    totals = sessions.agg(*[F.sum(c).alias(c) for c in ("request_pairs", "lcp_bytes", "context_bytes", "potential_lcp_bytes")])
    extra = reports.agg(F.count(F.lit(1)).alias("sessions"), F.sum("total_stable_after_switch_bytes").alias("recoverable_stable_bytes"), F.count_if(F.col("total_prefix_cut_bytes") > 0).alias("sessions_with_prefix_cut"))
    lcp, context, potential = F.col("lcp_bytes"), F.col("context_bytes"), F.col("potential_lcp_bytes")
    gain = F.greatest(potential - lcp, F.lit(0))
    # two single rows
    return totals.crossJoin(extra).where("request_pairs > 0").select(
        "sessions", "request_pairs", "lcp_bytes", "context_bytes", safe_ratio(lcp, context).alias("ratio"), "potential_lcp_bytes", safe_ratio(potential, context).alias("potential_ratio"),
        gain.alias("gain_bytes"), "recoverable_stable_bytes", "sessions_with_prefix_cut",
        F.struct(context.alias("context_bytes"), lcp.alias("reusable_bytes"), gain.alias("recoverable_bytes"), F.greatest(context - potential, F.lit(0)).alias("new_content_bytes")).alias("composition"),
    )


def requests_with_gain(potentials: DataFrame, limit: int = LISTED) -> DataFrame:
    """Requests that could reuse more, largest gain first; the list is a top-k report."""
    gain = F.col("potential") - F.col("lcp_bytes")
    return potentials.where(gain > 0).select(
        F.col("next_request_id").alias("request_id"), "session_key", F.col("lcp_bytes").alias("reusable_prefix_bytes"), F.col("potential").alias("potential_prefix_bytes"), gain.alias("gain_bytes"), F.col("defect_ids").alias("blocking_defect_ids")
    ).orderBy(F.desc("gain_bytes"), "request_id").limit(limit)
