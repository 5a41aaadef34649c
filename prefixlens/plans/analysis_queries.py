"""Queries of the analysis over the captured tables; each builds only the branch it reports."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlens.functions.strings import clean_key
from prefixlens.functions.times import rfc3339_nanos, rfc3339_seconds, window_start
from prefixlens.operators import cache, cohort, extract, prefix_view, projection, rank, reuse, session
from prefixlens.operators.ordering import row_numbers
from prefixlens.operators.validate import violations
from prefixlens.options import AnalysisOptions
from prefixlens.report import tables as report
from prefixlens.sources import records as R
from prefixlens.sources.tables import table, written

#: The tables are taken whole, whatever their number of records.
OPTIONS = AnalysisOptions(max_records=(1 << 63) - 1)


#: The same with domains of two weeks, in which there is more to compare.
TWO_WEEKS = dataclasses.replace(OPTIONS, comparison_window_seconds=14 * 86400)


def _loaded(spark: SparkSession, base: str) -> DataFrame:
    return R.load_requests(table(spark, base, "requests"), OPTIONS)


def _projected(spark: SparkSession, base: str, options: AnalysisOptions = OPTIONS) -> DataFrame:
    return R.numbered(written(projection.project(R.hashed(_loaded(spark, base)), options), "projected"))


def _events(spark: SparkSession, base: str) -> DataFrame:
    return session.session_events(projection.sequences(_projected(spark, base)))


def _members(spark: SparkSession, base: str, options: AnalysisOptions = OPTIONS) -> DataFrame:
    """What the search for cohorts needs of the sequences; nothing else is written."""
    return R.numbered(written(cohort.members(projection.sequences(projection.project(R.hashed(_loaded(spark, base)), options))), "members"))


def _templates(spark: SparkSession, base: str, options: AnalysisOptions = OPTIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    seqs = projection.sequences(_projected(spark, base, options))
    cohorts = written(cohort.find_cohorts(seqs, options), "cohorts")
    return seqs, cohorts, extract.extract_templates(cohorts, seqs, options)


def line_skips(spark: SparkSession, base: str) -> DataFrame:
    """Rejected raw lines with the rule that rejected them."""
    lines = R.load_lines(table(spark, base, "raw_lines"), OPTIONS)
    return R.skips(lines).select("record_index", "code", F.try_element_at("args", F.lit("field")).alias("field"))


def request_ids(spark: SparkSession, base: str) -> DataFrame:
    return R.identified(_loaded(spark, base)).select("input_line", "request_id")


def unit_projection(spark: SparkSession, base: str) -> DataFrame:
    return projection.unit_rows(projection.sequences(_projected(spark, base))).drop("fp")


def unit_counts(spark: SparkSession, base: str) -> DataFrame:
    """Units per kind of every request that can be projected."""
    units = projection.unit_rows(projection.sequences(_projected(spark, base)))
    return units.groupBy("input_line", "kind").agg(F.count(F.lit(1)).alias("units"))


def projection_skips(spark: SparkSession, base: str) -> DataFrame:
    return projection.projection_skips(_projected(spark, base)).select("record_index", "code")


def domain_windows(spark: SparkSession, base: str) -> DataFrame:
    """Records per endpoint and tumbling hour."""
    rows = table(spark, base, "corpus_records").select(window_start(rfc3339_seconds("captured_at"), OPTIONS.comparison_window_seconds).alias("time_window_key"), F.col("comparison.endpoint_key").alias("endpoint_key"))
    return rows.where("time_window_key IS NOT NULL").groupBy("time_window_key", "endpoint_key").agg(F.count(F.lit(1)).alias("records"))


def _reported(spark: SparkSession, base: str) -> DataFrame:
    """Cache metrics of the loaded corpus, whose payloads are not kept: usage only."""
    rows = table(spark, base, "corpus_records").select("input_line", "captured_at", "source", "session_key", "response_usage").distinct()
    ordered = row_numbers(rows.withColumn("_at", F.coalesce("captured_at", F.lit(""))), ["session_key"], ["_at", "input_line"], "sequence")
    none = F.lit(None).cast("bigint")
    metrics = cache.with_deltas(ordered.select(F.col("input_line").cast("string").alias("request_id"), "session_key", "sequence", "captured_at", "source", "response_usage", none.alias("lcp"), none.alias("payload_bytes")))
    return metrics.withColumn("input_line", F.col("request_id").cast("bigint"))


def cache_metrics_reported(spark: SparkSession, base: str) -> DataFrame:
    return _reported(spark, base).select("input_line", "session_key", "sequence", "prompt_tokens", "cached_tokens", "miss_tokens", "output_tokens", "hit_rate", "hit_rate_delta", "basis", "ttft_ms", "total_ms")


def usage_by_session(spark: SparkSession, base: str) -> DataFrame:
    return cache.usage_by_session(_reported(spark, base))


def cache_metrics_estimated(spark: SparkSession, base: str) -> DataFrame:
    return cache.cache_metrics(R.identified(_loaded(spark, base)))


def session_turns(spark: SparkSession, base: str) -> DataFrame:
    """Consecutive requests of each session, numbered by instant and line."""
    rows = projection.sequences(_projected(spark, base)).where("session_key IS NOT NULL").select("session_key", rfc3339_nanos("captured_at").alias("ts"), "input_line")
    ordered = row_numbers(rows, ["session_key"], ["ts", "input_line"], "sequence")
    return ordered.select("session_key", "sequence", "input_line")


def session_events(spark: SparkSession, base: str) -> DataFrame:
    return _events(spark, base).select(*session.EVENT_COLUMNS)


def session_reports(spark: SparkSession, base: str) -> DataFrame:
    return session.session_reports(_events(spark, base))


def prefix_reuse_total(spark: SparkSession, base: str) -> DataFrame:
    events = written(_events(spark, base), "events")
    return reuse.summary(reuse.by_session(reuse.event_potential(events, None)), session.session_reports(events)).withColumn("new_content_bytes", F.col("composition.new_content_bytes")).drop("composition")


def prefix_reuse_by_session(spark: SparkSession, base: str) -> DataFrame:
    return reuse.by_session(reuse.event_potential(_events(spark, base), None))


def tool_overlap(spark: SparkSession, base: str) -> DataFrame:
    """Jaccard overlap of the tool names that consecutive turns of a session declare."""
    from prefixlens.operators.flatten import flatten_payloads, tools_table
    from prefixlens.operators.ordering import with_previous

    requests = table(spark, base, "requests")
    names = tools_table(flatten_payloads(requests)).where("name IS NOT NULL").groupBy("input_line").agg(F.collect_set("name").alias("names"))
    rows = requests.select("input_line", clean_key("session_key").alias("session_key")).where("session_key IS NOT NULL").join(names, "input_line")
    turns = with_previous(row_numbers(rows, ["session_key"], ["input_line"], "sequence"), ["session_key"], "sequence", ["names"]).where("prev_names IS NOT NULL")
    return turns.select("session_key", "sequence", "input_line", (F.size(F.array_intersect("names", "prev_names")) / F.size(F.array_union("names", "prev_names"))).alias("jaccard"))


def _listed(found: DataFrame) -> DataFrame:
    """Members of cohorts, their scores to nine digits."""
    return found.where("cohort_id IS NOT NULL").select("cohort_id", "medoid_request_id", "request_id", F.round("compatibility", 9).alias("compatibility"), F.round("cohesion", 9).alias("cohesion"))


def cohorts(spark: SparkSession, base: str) -> DataFrame:
    return _listed(cohort.find_cohorts(_members(spark, base), OPTIONS))


def pair_scores(spark: SparkSession, base: str) -> DataFrame:
    """The pair metric between the seed members of every domain of two weeks; scores to nine digits."""
    found = cohort.seed_scores(projection.sequences(_projected(spark, base, TWO_WEEKS)), TWO_WEEKS)
    return found.select("time_window_key", "endpoint_key", "model", "a", "b", F.round("compatibility", 9).alias("compatibility"), F.round("dynamic", 9).alias("dynamic"), "accepted")


def cohorts_two_weeks(spark: SparkSession, base: str) -> DataFrame:
    return _listed(cohort.find_cohorts(_members(spark, base, TWO_WEEKS), TWO_WEEKS))


def cohorts_in_rounds(spark: SparkSession, base: str) -> DataFrame:
    """The same with every domain of more than five variants searched in distributed rounds."""
    return _listed(cohort.find_cohorts(_members(spark, base, TWO_WEEKS), TWO_WEEKS, task_variants=5))


def defects_two_weeks(spark: SparkSession, base: str) -> DataFrame:
    return rank.rank_defects(rank.candidates(_templates(spark, base, TWO_WEEKS)[2]))


def templates(spark: SparkSession, base: str) -> DataFrame:
    return _templates(spark, base)[2].drop("candidates", "coordinates")


def bindings(spark: SparkSession, base: str) -> DataFrame:
    seqs, found, _ = _templates(spark, base)
    return extract.extract_bindings(found, seqs, OPTIONS)


def defects(spark: SparkSession, base: str) -> DataFrame:
    return rank.rank_defects(rank.candidates(_templates(spark, base)[2]))


def top_defects(spark: SparkSession, base: str) -> DataFrame:
    return rank.top_k(rank.rank_defects(rank.candidates(_templates(spark, base)[2])), OPTIONS.top_k)


def prefix_nodes(spark: SparkSession, base: str) -> DataFrame:
    found = written(_templates(spark, base)[2], "templates")
    return prefix_view.prefix_nodes(found, rank.rank_defects(rank.candidates(found)), OPTIONS)


def reuse_requests(spark: SparkSession, base: str) -> DataFrame:
    """Requests that could reuse more than they do, were known defects fixed."""
    seqs, _, found = _templates(spark, base)
    potential = reuse.request_potential(rank.rank_defects(rank.candidates(found)))
    return reuse.requests_with_gain(reuse.event_potential(session.session_events(seqs), potential))


def _session_table(spark: SparkSession, base: str) -> DataFrame:
    events = written(_events(spark, base), "events")
    return report.sessions({"session_events": events, "session_reports": session.session_reports(events)})


def session_attention(spark: SparkSession, base: str) -> DataFrame:
    """Sessions with context refreshes, as the report lists them."""
    first = F.col("first_refresh")
    return report.attention(_session_table(spark, base)).withColumns({"first_refresh_from": first["previous_sequence"], "first_refresh_to": first["next_sequence"]}).drop("first_refresh")


def session_overview(spark: SparkSession, base: str) -> DataFrame:
    return report.session_overview(_session_table(spark, base))


def reuse_gauge(spark: SparkSession, base: str) -> DataFrame:
    return report.reuse_gauge(prefix_reuse_total(spark, base))


def cross_check(spark: SparkSession, base: str) -> DataFrame:
    """Sessions whose structural reuse differs most from the hit rate they report."""
    records = written(R.identified(_loaded(spark, base)), "records")
    events = session.session_events(projection.sequences(written(projection.project(records, OPTIONS), "projected")))
    return report.cross_check(reuse.by_session(reuse.event_potential(events, None)), cache.cache_metrics(records))


def template_totals(spark: SparkSession, base: str) -> DataFrame:
    return report.template_totals(prefix_nodes(spark, base))


def decay(spark: SparkSession, base: str) -> DataFrame:
    """Members left along each template's chain."""
    return report.decay(prefix_nodes(spark, base))


def integrity(spark: SparkSession, base: str) -> DataFrame:
    """Violated integrity rules of the analysis; none are expected."""
    seqs, _, found = _templates(spark, base)
    found = written(found, "templates")
    ranked = written(rank.scored(rank.unique_defects(rank.candidates(found))), "defects")
    events = written(session.session_events(seqs), "events")
    relations = {"templates": found.where("limitation IS NULL"), "defects": ranked, "top_k": rank.top_k(ranked, OPTIONS.top_k), "prefix_nodes": prefix_view.prefix_nodes(found, ranked, OPTIONS), "session_events": events, "session_reports": session.session_reports(events)}
    return violations(relations, OPTIONS.top_k)


QUERIES = {
    f.__name__: f
    for f in (
        line_skips, request_ids, unit_projection, unit_counts, projection_skips, domain_windows, cache_metrics_reported, usage_by_session, cache_metrics_estimated, session_turns,
        session_events, session_reports, prefix_reuse_total, prefix_reuse_by_session, tool_overlap, pair_scores, cohorts, cohorts_two_weeks, cohorts_in_rounds, templates, bindings, defects, defects_two_weeks, top_defects, prefix_nodes, reuse_requests,
        session_attention, session_overview, reuse_gauge, cross_check, template_totals, decay, integrity,
    )
}
