"""String expressions and their Python counterparts used inside Arrow stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_JAVA_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE_SPACE) + "]"


def unicode_trim(c: Column | str) -> Column:
    """Remove surrounding White_Space characters; Spark's trim() removes spaces only. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, f"^{_JAVA_CLASS}+|{_JAVA_CLASS}+$", "")


def clean_key(c: Column | str) -> Column:
    """A grouping key: trimmed, null when nothing is left."""
    t = unicode_trim(c)
    return F.when(t != "", t)


def py_trim(s: str) -> str:
    return s.strip(WHITE_SPACE)


def byte_length(c: Column | str) -> Column:
    return F.octet_length(c).cast("bigint")


def truncate_points(c: Column | str, n: int) -> Column:
    return F.substring(c, 1, n)


def short_id(c: Column | str, n: int = 12) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def flatten_label(c: Column | str, limit: int | None = None) -> Column:
    """One-line label: literal backslash-n and runs of white space become one space, cut with an ellipsis."""
    c = F.col(c) if isinstance(c, str) else c
    flat = F.regexp_replace(F.replace(c, F.lit("\\n"), F.lit(" ")), f"{_JAVA_CLASS}+", " ")
    flat = unicode_trim(flat)
    if limit is None:
        return flat
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def human_bytes(c: Column | str) -> Column:
    """Bytes, KB or MB; halves are rounded to even."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return (
        F.when(c >= 1048576, F.format_string("%.1f MB", F.bround(c / 1048576, 1)))
        .when(c >= 1024, F.format_string("%.0f KB", F.bround(c / 1024, 0)))
        .otherwise(F.format_string("%.0f B", c))
    )


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def digest_parts(*parts: Column) -> Column:
    """Hex SHA-256 of the parts, each followed by a zero byte."""
    pieces = []
    for p in parts:
        pieces += [F.encode(p, "UTF-8"), F.unhex(F.lit("00"))]
    return F.sha2(F.concat(*pieces), 256)


def short_digest(c: Column | str) -> Column:
    return F.substring(F.sha2(c, 256), 1, 8)
