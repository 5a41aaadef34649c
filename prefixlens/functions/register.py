"""The engine's own scalar functions under SQL names, as Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixlens.functions import canonical as C
from prefixlens.operators.cache import _lcp
from prefixlens.operators.diagnose import loose_json
from prefixlens.operators.metric import FNV_OFFSET, FNV_PRIME, PairMetric, Profile
from prefixlens.report.format import anchor, inline, session_label


def _each(f):
    """Null in, null out."""
    return lambda s: pd.Series([None if x is None else f(x) for x in s], dtype=object)


def _canonical(text: str) -> str | None:
    try:
        return C.canonical(C.parse(text))
    except ValueError:
        return None


def _loose(text: str) -> dict | None:
    found = loose_json(text)
    return None if found is None else {"label": found[0], "json": found[1]}


def fnv1a64(text: str) -> int:
    h = FNV_OFFSET
    for b in text.encode():
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h - 2**64 if h >= 2**63 else h


def _dice(mode: str):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        m = PairMetric(mode)
        return pd.Series([None if x is None or y is None else m.dice(x, y) for x, y in zip(a, b)], dtype=float)

    return run


def _pair(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The pair metric of two arrays of units."""
    m = PairMetric()
    found = [(None, None) if x is None or y is None else m(Profile.of(list(x)), Profile.of(list(y))) for x, y in zip(a, b)]
    return pd.DataFrame(found, columns=["compatibility", "dynamic"], dtype=float)


#: Name -> (function over series, result type).
FUNCTIONS = {
    "canonical_json": (_each(_canonical), "string"),
    "loose_json": (lambda s: pd.DataFrame([_loose(x) or {"label": None, "json": None} if x is not None else {"label": None, "json": None} for x in s], columns=["label", "json"]), "struct<label: string, json: string>"),
    "byte_lcp": (_lcp, "bigint"),
    "fnv1a64": (_each(fnv1a64), "bigint"),
    "markdown_text": (_each(inline), "string"),
    "heading_anchor": (_each(anchor), "string"),
    "session_label": (_each(session_label), "string"),
    "pair_metric": (_pair, "struct<compatibility: double, dynamic: double>"),
    "text_similarity": (_dice("compat"), "double"),
    "text_similarity_bottom_k": (_dice("bottom_k"), "double"),
}


def register(spark: SparkSession) -> list[str]:
    """Make FUNCTIONS callable from SQL; the names are returned."""
    for name, (f, kind) in FUNCTIONS.items():
        n = 2 if name in ("byte_lcp", "pair_metric", "text_similarity", "text_similarity_bottom_k") else 1
        typed = (lambda f: lambda a, b: f(a, b))(f) if n == 2 else (lambda f: lambda a: f(a))(f)
        typed.__annotations__ = {**({"a": pd.Series, "b": pd.Series} if n == 2 else {"a": pd.Series}), "return": pd.DataFrame if kind.startswith("struct") else pd.Series}
        spark.udf.register(name, F.pandas_udf(typed, T._parse_datatype_string(kind) if kind.startswith("struct") else kind))
    return list(FUNCTIONS)
