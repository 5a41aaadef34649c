"""Integrity of the result relations: every rule is a query whose rows are violations."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlens.options import EPSILON

SCHEMA_VERSION = "0.1.0"
SLACK = 8 * EPSILON


def _rows(df: DataFrame, rule: str, bad: Column, subject: Column) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(True))).select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))


def _repeats(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("subject"))


def _distinct(c: str) -> Column:
    return F.size(F.array_distinct(c)) != F.size(c)


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= SLACK * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def _probability(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) <= 1)


def _bad_source(s: Column) -> Column:
    both = s["byte_start"].isNull() == s["byte_end"].isNull()
    return (s["json_path"].isNull()) | (s["json_path"] == "") | ~both | (s["byte_start"] > s["byte_end"])


def _bad_group(g: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{g}.{k}"), F.lit("")) == "" for k in ("time_window_key", "endpoint_key", "model", "context_schema_key")])


def violations(relations: Mapping[str, DataFrame], top_k_limit: int | None = None) -> DataFrame:
    """(rule, subject) of everything that contradicts itself; empty for a sound result.

    ``relations``: templates, defects (in rank order, with a column rank), top_k, prefix_nodes,
    session_reports, session_events; those not given are not checked.
    """
    out: list[DataFrame] = []
    t, d, k = relations.get("templates"), relations.get("defects"), relations.get("top_k")
    if t is not None:
        out += [
            _repeats(t, "template ids are unique", "id"),
            _rows(t, "cohesion lies between 0 and 1", ~_probability("cohesion"), F.col("id")),
            _rows(t, "template members are unique", _distinct("member_request_ids"), F.col("id")),
            _rows(t, "the centre is a member", ~F.array_contains("member_request_ids", F.col("medoid_request_id")), F.col("id")),
            _rows(t, "template group keys are filled", _bad_group("comparison_group"), F.col("id")),
            _rows(t, "template sources are sound", F.exists("stable_spans", lambda s: _bad_source(s["source"])) | F.exists("slots", lambda s: _bad_source(s["source"])), F.col("id")),
        ]
    if d is not None:
        v = d.select("id", "comparable_count", F.explode("variants").alias("v"))
        members = d.select("id", "template_id", F.explode("variants").alias("v")).select("id", "template_id", F.explode("v.member_request_ids").alias("m"))
        sizes = F.transform("variants", lambda x: F.size(x["member_request_ids"]))
        total, largest = F.aggregate(sizes, F.lit(0), lambda a, b: a + b), F.array_max(sizes)
        out += [
            _repeats(d, "defect ids are unique", "id"),
            _rows(d, "a defect has two variants", F.size("variants") < 2, F.col("id")),
            _rows(v, "a variant has members", F.size("v.member_request_ids") == 0, F.col("id")),
            _rows(d, "variant fingerprints are unique", F.size(F.array_distinct(F.transform("variants", lambda x: x["fingerprint"]))) != F.size("variants"), F.col("id")),
            _rows(v, "the representative is a member", ~F.array_contains("v.member_request_ids", F.col("v.representative.request_id")), F.col("id")),
            _repeats(members, "a member has one variant", "id", "m"),
            _rows(v, "a variant without source is empty", (F.size("v.representative.sources") == 0) & ((F.col("v.representative.utf8_bytes") != 0) | F.col("v.representative.excerpt").isNotNull()), F.col("id")),
            _rows(d, "members are comparable and supported", (total != F.col("comparable_count")) | (F.col("recovered_stable.support_count") != F.col("comparable_count")), F.col("id")),
            _rows(d, "the stable stretch has a source", F.size("recovered_stable.sources") == 0, F.col("id")),
            _rows(d, "affected are all but the largest variant", (F.col("affected_count") != F.col("comparable_count") - largest) | (F.col("affected_count") < 1), F.col("id")),
            _rows(d, "a defect has an insight", F.size("insights") == 0, F.col("id")),
            _rows(d, "potential is at least actual", F.col("potential_prefix_bytes") < F.col("actual_prefix_bytes"), F.col("id")),
            _rows(d, "blocked bytes lie in the stable stretch", F.col("blocked_stable_bytes") > F.col("recovered_stable.utf8_bytes"), F.col("id")),
            _rows(d, "confidence lies between 0 and 1", ~_probability("confidence"), F.col("id")),
            _rows(d, "the score is its factors' product", ~_close(F.col("score"), F.col("blocked_stable_bytes") * F.col("affected_count") * F.col("confidence")), F.col("id")),
            _rows(d, "defect group keys are filled", _bad_group("comparison_group"), F.col("id")),
            _rows(d, "defect sources are sound", F.exists("variants", lambda x: F.exists(x["representative"]["sources"], _bad_source)) | F.exists("recovered_stable.sources", _bad_source), F.col("id")),
        ]
        if t is not None:
            own = t.select(F.col("id").alias("template_id"), F.col("comparison_group").alias("_g"), "member_request_ids")
            joined = d.select("id", "template_id", "comparison_group").join(own, "template_id", "left")
            out.append(_rows(joined, "a defect's template exists in its group", F.col("_g").isNull() | ~F.col("_g").eqNullSafe(F.col("comparison_group")), F.col("id")))
            of = own.select("template_id", F.explode("member_request_ids").alias("m"))
            out.append(members.join(of, ["template_id", "m"], "left_anti").select(F.lit("variant members belong to the template").alias("rule"), F.concat_ws("/", "id", "m").alias("subject")))
    if k is not None:
        out.append(_repeats(k, "top entries are unique", "defect_id"))
        if top_k_limit is not None:
            out.append(_rows(k, "top entries keep the limit", F.col("rank") > top_k_limit, F.col("defect_id")))
        if d is not None and "rank" in d.columns:
            ranks = d.select(F.col("id").alias("defect_id"), F.col("rank").alias("_r"))
            out.append(_rows(k.join(ranks, "defect_id", "left"), "top entries begin the ranking", F.col("_r").isNull() | (F.col("_r") != F.col("rank")), F.col("defect_id")))
    if (n := relations.get("prefix_nodes")) is not None:
        name = F.concat_ws("/", "template_id", "id")
        per = n.groupBy("template_id").agg(F.count(F.lit(1)).alias("_n"), F.count("sequence_child").alias("_c"), F.count_if(F.col("id") == "seq-0").alias("_root"))
        child = n.where("sequence_child IS NOT NULL").select("template_id", F.col("sequence_child").alias("id"), F.col("id").alias("_from"))
        step = lambda c: F.regexp_extract(c, r"^seq-(\d+)$", 1).try_cast("bigint")
        out += [
            _repeats(n, "node ids are unique", "template_id", "id"),
            # each node has one child at most and children only go forward, so all nodes form one chain from the root
            _rows(per, "nodes form one chain from the root", (F.col("_root") != 1) | (F.col("_c") != F.col("_n") - 1), F.col("template_id")),
            child.join(n.select("template_id", "id"), ["template_id", "id"], "left_anti").select(F.lit("a child exists").alias("rule"), F.concat_ws("/", "template_id", "id").alias("subject")),
            _repeats(child, "a node has one parent", "template_id", "id"),
            _rows(child, "the chain has no cycle", step("id") <= step("_from"), F.concat_ws("/", "template_id", "_from")),
            _rows(n, "node sources are sound", _bad_source(F.col("source")), name),
        ]
    e, r = relations.get("session_events"), relations.get("session_reports")
    if e is not None:
        name = F.concat_ws("/", "session_key", "next_sequence")
        total, kept, gone = F.col("previous_total_bytes"), F.col("retained_prefix_bytes"), F.col("abandoned_prefix_bytes")
        out += [
            _rows(e, "abandoned bytes lie in the request before", gone > total, name),
            _rows(e, "retained and abandoned make up the request before", kept + gone != total, name),
            _rows(e, "the reuse ratio is retained over all", F.when(total > 0, ~_close(F.col("prefix_reuse_ratio"), kept / total)).otherwise(F.col("prefix_reuse_ratio").isNotNull()), name),
            _rows(e, "an outlier abandons bytes", F.col("prefix_reuse_outlier") != (gone > 0), name),
        ]
        if r is not None:
            sums = e.groupBy("session_key").agg(F.count(F.lit(1)).alias("_n"), F.count_if("prefix_reuse_outlier").alias("_r"), F.sum("abandoned_prefix_bytes").alias("_a"))
            both = r.join(sums, "session_key", "left")
            out += [
                _rows(both, "a session has one request more than events", F.col("request_count") != F.coalesce("_n", F.lit(0)) + 1, F.col("session_key")),
                _rows(both, "refreshes are the outliers", F.col("context_refresh_count") != F.coalesce("_r", F.lit(0)), F.col("session_key")),
                _rows(both, "abandoned bytes add up", F.col("total_abandoned_prefix_bytes") != F.coalesce("_a", F.lit(0)), F.col("session_key")),
            ]
    return reduce(DataFrame.unionByName, out)
