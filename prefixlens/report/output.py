"""Report files: where they go, and all of them or none."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from prefixlens.report import document as D
from prefixlens.report import render, view
from prefixlens.report.locale import Locale

FORMATS = {"html": render.html, "markdown": render.markdown}
_SUFFIX = {"html": ".html", "markdown": ".md"}


def report_paths(output: str | Path, form: str | None) -> dict[str, Path]:
    """Targets per format. With one format the path is taken as it is; else .html or .md is taken off."""
    output = Path(output)
    if form is not None:
        return {form: output}
    base = output.with_suffix("") if output.suffix.lower() in _SUFFIX.values() else output
    return {f: base.with_name(base.name + s) for f, s in _SUFFIX.items()}


def write_reports(spark: SparkSession, source: str | Path, output: str | Path, form: str | None = None, locale: Locale | None = None) -> list[Path]:
    """Read and check a result document, render every format, then publish."""
    targets = report_paths(output, form)
    D.ensure_distinct(source, *targets.values())
    document = D.read_document(source)
    D.check_document(spark, document)
    v = view.build(spark, document)
    D.write_atomic({path: FORMATS[f](v, locale) for f, path in targets.items()})
    return list(targets.values())
