"""The whole analysis: lines or tables of requests to the seven result relations."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlens.operators import cache, cohort, extract, prefix_view, projection, rank, reuse, session
from prefixlens.options import AnalysisOptions
from prefixlens.sources import records as R
from prefixlens.sources.tables import written


class NothingToAnalyse(ValueError):
    """No record could be projected."""


@dataclass
class Analysis:
    """The relations of one run. All are lazy over tables written once in the shared folder."""

    options: AnalysisOptions
    records: DataFrame
    skips: DataFrame
    sequences: DataFrame
    cohorts: DataFrame
    templates: DataFrame
    defects: DataFrame
    top_k: DataFrame
    prefix_nodes: DataFrame
    session_events: DataFrame
    session_reports: DataFrame
    cache_metrics: DataFrame
    prefix_reuse: DataFrame
    prefix_reuse_by_session: DataFrame
    prefix_reuse_requests: DataFrame
    limitations: DataFrame


def write_tables(a: Analysis, folder: str, batch: int | None = None) -> None:
    """Every relation as a Parquet table under ``folder``, of any size.

    With ``batch`` only that batch's part of each table is written; writing a batch again replaces it.
    """
    for f in dataclasses.fields(a):
        if isinstance(df := getattr(a, f.name), DataFrame):
            df.write.mode("overwrite").parquet(f"{folder}/{f.name}" + ("" if batch is None else f"/batch={batch}"))


def analyse_file(spark: SparkSession, path: str, options: AnalysisOptions = AnalysisOptions()) -> Analysis:
    return analyse_loaded(R.load_lines(R.scan_lines(spark, path), options), options)


def analyse_requests(requests: DataFrame, options: AnalysisOptions = AnalysisOptions()) -> Analysis:
    return analyse_loaded(R.load_requests(requests, options), options)


def analyse_loaded(loaded: DataFrame, options: AnalysisOptions = AnalysisOptions(), shingles: str = "compat", counts: str = "compat") -> Analysis:
    """``loaded``: RECORD rows. Parsing, projection and templates are written once; the rest is lazy."""
    loaded = written(loaded, "loaded")
    records = written(R.identified(loaded), "records")
    projected = written(projection.project(records, options), "projected")
    seqs = projection.sequences(projected)
    if seqs.isEmpty():
        raise NothingToAnalyse("no record could be analysed")
    events = written(session.session_events(seqs), "events")
    reports = session.session_reports(events)
    cohorts = written(cohort.find_cohorts(seqs, options, shingles), "cohorts")
    templates = written(extract.extract_templates(cohorts, seqs, options, counts), "templates")
    defects = written(rank.scored(rank.unique_defects(rank.candidates(templates))), "defects")
    potentials = reuse.event_potential(events, reuse.request_potential(defects))
    by_session = reuse.by_session(potentials)
    stopped = cohorts.where(F.col("skip_members").isNotNull()).select(F.format_string("candidate medoid budget %d exhausted for %d members", F.lit(options.max_candidates_per_request), "skip_members").alias("limitation"))
    limits = stopped.unionByName(templates.where(F.col("limitation").isNotNull()).select("limitation"))
    return Analysis(
        options=options,
        records=records,
        skips=R.skips(loaded).unionByName(projection.projection_skips(projected)).orderBy("record_index", "reason"),
        sequences=seqs,
        cohorts=cohorts.where(F.col("cohort_id").isNotNull()),
        templates=templates.where(F.col("limitation").isNull()).drop("limitation"),
        defects=rank.ranking(defects),
        top_k=rank.top_k(defects, options.top_k),
        prefix_nodes=prefix_view.prefix_nodes(templates, defects, options),
        session_events=events.select(*session.EVENT_COLUMNS),
        session_reports=session.ranked_reports(reports),
        cache_metrics=cache.cache_metrics(records),
        prefix_reuse=reuse.summary(by_session, reports),
        prefix_reuse_by_session=by_session,
        prefix_reuse_requests=reuse.requests_with_gain(potentials),
        limitations=limits.orderBy("limitation"),
    )
