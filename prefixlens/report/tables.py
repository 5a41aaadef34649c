"""The reporting queries: small relations that the renderers print, computed from a result's relations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlens.functions.strings import safe_ratio
from prefixlens.operators import cache
from prefixlens.operators.ordering import row_numbers

#: Product target of structural reuse, entries of the cross-check, collapsed session rows (fixed values).
TARGET, CROSS_CHECK, COLLAPSED = 0.9, 8, 8
Relations = Mapping[str, DataFrame]


def run_summary(r: Relations, input_records: int, analysed: int, skipped: int) -> DataFrame:
    """The four counts of a run."""
    d = r["defects"].agg(F.count(F.lit(1)).alias("defects"))
    return d.select(F.lit(input_records).alias("input_records"), F.lit(analysed).alias("analyzed_records"), F.lit(skipped).alias("skipped_records"), "defects")


def reuse_gauge(total: DataFrame, target: float = TARGET) -> DataFrame:
    """R2: ratio and reachable ratio against the target."""
    verdict = F.when(F.col("ratio") >= target, "above").when(F.col("potential_ratio") >= target, "reachable").otherwise("below")
    return total.select("ratio", "potential_ratio", "gain_bytes", F.lit(target).alias("target"), verdict.alias("verdict"))


def cross_check(by_session: DataFrame, metrics: DataFrame, limit: int = CROSS_CHECK) -> DataFrame:
    """Sessions whose structural reuse and reported hit rate differ most; a top-k report."""
    real = cache.usage_by_session(metrics).select("session_key", F.col("hit_rate").alias("real_ratio"), "reported_rows")
    both = by_session.select("session_key", F.col("ratio").alias("structural_ratio")).join(real, "session_key").withColumn("difference", F.abs(F.col("structural_ratio") - F.col("real_ratio")))
    return both.orderBy(F.desc("difference"), "session_key").limit(limit)


def defect_location(variants: Column) -> Column:
    """Path and bytes of the first source of the first variant that has one."""
    sources = F.flatten(F.transform(variants, lambda v: v["representative"]["sources"]))
    s = F.try_element_at(sources, F.lit(1))
    span = F.when(s["byte_start"].isNotNull(), F.concat(F.lit(" ["), s["byte_start"].cast("string"), F.lit(".."), s["byte_end"].cast("string"), F.lit(")"))).otherwise("")
    return F.when(s.isNull(), "-").otherwise(F.concat(s["json_path"], span))


def top_table(r: Relations) -> DataFrame:
    """The top defects in order. One that is listed but missing is an error."""
    joined = r["top_k"].join(r["defects"].drop("rank"), F.col("defect_id") == F.col("id"), "left")
    known = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("top entry without defect: "), F.col("defect_id")))).otherwise(F.col("id"))
    return joined.select("rank", known.alias("defect_id"), "pattern", defect_location(F.col("variants")).alias("location"), "blocked_stable_bytes", "affected_count", "comparable_count", "confidence", "score").orderBy("rank")


def defect_details(r: Relations) -> DataFrame:
    """One row per variant of every defect, the largest first."""
    d = r["defects"].select("rank", "id", "template_id", "pattern", "facts", "insights", "recovered_stable", F.explode("variants").alias("v"))
    size = F.size("v.member_request_ids")
    order = Window.partitionBy("id").orderBy(F.desc(size), "v.fingerprint")
    return d.select("rank", "id", "template_id", "pattern", F.row_number().over(order).alias("variant"), size.alias("members"), F.col("v.representative.request_id").alias("example"), F.col("v.representative.utf8_bytes").alias("bytes"), F.col("v.representative.excerpt").alias("excerpt")).orderBy("rank", "variant")


def effective_refreshes(modern: Column) -> Column:
    """Sessions of older files have no refresh count; there, every turn that is no append counts."""
    return F.when(modern | (F.col("context_refresh_count") > 0), F.col("context_refresh_count")).otherwise(F.col("fork_count") + F.col("reorder_count") + F.col("reset_count"))


def effective_abandoned(modern: Column) -> Column:
    return F.when(modern | (F.col("total_abandoned_prefix_bytes") > 0), F.col("total_abandoned_prefix_bytes")).otherwise(F.col("total_prefix_cut_bytes"))


def sessions(r: Relations) -> DataFrame:
    """One row per session with what its table shows."""
    e, s = r["session_events"], r["session_reports"]
    modern = F.coalesce("modern", F.lit(True)) if "modern" in s.columns else F.lit(True)
    numbered = e
    if not e.where("previous_sequence <= 0 OR next_sequence <= 0").isEmpty():
        # older files leave turns without numbers
        at = row_numbers(e, ["session_key"], ["next_sequence", "next_request_id"], "_i")
        numbered = at.withColumns({"previous_sequence": F.when(F.col("previous_sequence") > 0, F.col("previous_sequence")).otherwise(F.col("_i")), "next_sequence": F.when(F.col("next_sequence") > 0, F.col("next_sequence")).otherwise(F.col("_i") + 1)})
    refresh = F.col("prefix_reuse_outlier") | (F.col("prefix_reuse_ratio").isNull() & (F.col("event_type") != "append"))
    per = numbered.groupBy("session_key").agg(F.min("prefix_reuse_ratio").alias("least_reuse"), F.min(F.when(refresh, F.struct("previous_sequence", "next_sequence"))).alias("first_refresh"))
    rows = s.withColumn("_modern", modern).join(per, "session_key", "left")
    return rows.select("session_key", "endpoint_key", "model", "request_count", effective_refreshes(F.col("_modern")).alias("refreshes"), effective_abandoned(F.col("_modern")).alias("abandoned_bytes"), "least_reuse", "first_refresh", "append_count", "fork_count", "reorder_count", "reset_count", "domain_change_count", "avg_prefix_cut_bytes")


def session_overview(table: DataFrame) -> DataFrame:
    """Totals over all sessions, with the endpoints and models they use."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return table.agg(F.count(F.lit(1)).alias("sessions"), F.sum("request_count").alias("requests"), F.sum("refreshes").alias("refreshes"), F.sum("abandoned_bytes").alias("abandoned_bytes"), F.count_if(F.col("refreshes") > 0).alias("with_refresh"), names("endpoint_key").alias("endpoints"), names("model").alias("models"))


def attention(table: DataFrame) -> DataFrame:
    return table.where("refreshes > 0").orderBy(F.desc("refreshes"), F.desc("abandoned_bytes"), "session_key")


def normal(table: DataFrame) -> DataFrame:
    return table.where("refreshes = 0").orderBy("session_key")


def event_details(r: Relations) -> DataFrame:
    """Turns with the class their spark bar gets."""
    ratio = F.col("prefix_reuse_ratio")
    bar = F.when(ratio.isNull(), "none").when(ratio < 0.5, "low").when(ratio < 0.75, "mid").otherwise("high")
    return r["session_events"].select("session_key", "previous_sequence", "next_sequence", "event_type", "prefix_reuse_ratio", bar.alias("bar"), "abandoned_prefix_bytes", "recomputed_bytes", "stable_after_switch_bytes", "domain_changed", "next_block_runs").orderBy("session_key", "next_sequence")


def cache_table(metrics: DataFrame) -> DataFrame:
    """Cache rows in session order; ``group`` counts up where the session changes."""
    groups = row_numbers(metrics.select(F.col("session_key").alias("_key")).distinct(), [], ["_key"], "group")
    return metrics.join(groups, F.col("session_key").eqNullSafe(F.col("_key"))).drop("_key").orderBy("group", "sequence")


def template_totals(nodes: DataFrame) -> DataFrame:
    """Bytes and nodes by kind, and the first divergence of each template's chain."""
    dynamic = F.col("kind") == "dynamic"
    split = dynamic | (F.col("support_ratio") < 1)
    return nodes.withColumn("_o", F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")).groupBy("template_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(dynamic).alias("dynamic_nodes"), F.sum("utf8_bytes").alias("bytes"), F.sum(F.when(dynamic, F.col("utf8_bytes")).otherwise(0)).alias("dynamic_bytes"),
        F.min(F.when(split, F.col("_o"))).alias("first_divergence"), F.max(F.size("member_request_ids")).alias("members"),
    )


def decay(nodes: DataFrame) -> DataFrame:
    """Members left along the chain; about ten ticks."""
    rows = nodes.select("template_id", F.regexp_extract("id", r"(\d+)$", 1).cast("bigint").alias("index"), "support_count", "member_request_ids")
    per = rows.groupBy("template_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("member_request_ids")).alias("_m"))
    step = F.greatest(F.floor(F.col("_n") / 10), F.lit(1))
    return rows.join(per, "template_id").select("template_id", "index", "support_count", safe_ratio(F.col("support_count"), F.col("_m")).alias("share"), (F.col("index") % step == 0).alias("tick")).orderBy("template_id", "index")


def dropped_members(r: Relations) -> DataFrame:
    """Members of a template that a node has lost."""
    t = r["templates"].select(F.col("id").alias("template_id"), F.col("member_request_ids").alias("_all"))
    return r["prefix_nodes"].join(t, "template_id").select("template_id", "id", F.array_except("_all", "member_request_ids").alias("dropped"))


def common_key_prefix(df: DataFrame, column: str) -> DataFrame:
    """The common prefix of all keys, which is that of the smallest and the largest."""
    both = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    length = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("a"), F.length("b"))), lambda i: F.substring("a", F.lit(1), i.cast("int")) == F.substring("b", F.lit(1), i.cast("int"))))
    return both.select(F.when(F.coalesce(F.length("a"), F.lit(0)) == 0, "").otherwise(F.substring("a", F.lit(1), length)).alias("prefix"))
