"""python -m prefixlens.cli.analyse --input requests.ndjson --output analysis.json

With --tables FOLDER the relations are written as Parquet tables there; use it for results too large for one document.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from prefixlens.options import AnalysisOptions
from prefixlens.plans.pipeline import analyse_file, write_tables
from prefixlens.report.document import ensure_distinct, to_document, write_document


def _positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output")
    p.add_argument("--tables")
    p.add_argument("--config")
    p.add_argument("--top-k", type=_positive)
    p.add_argument("--comparison-window-seconds", type=_positive)
    a = p.parse_args(argv)
    options = AnalysisOptions.from_json(Path(a.config).read_text()) if a.config else AnalysisOptions()
    options = options.overridden(top_k=a.top_k, comparison_window_seconds=a.comparison_window_seconds)
    if not (a.output or a.tables):
        p.error("--output or --tables is needed")
    if a.output:
        ensure_distinct(a.input, a.output)
    found = analyse_file(session("analyse"), a.input, options)
    if a.tables:
        write_tables(found, a.tables)
    if a.output:
        write_document(a.output, to_document(found))


if __name__ == "__main__":
    main()
