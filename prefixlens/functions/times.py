"""RFC 3339 text to instants. Bare casts accept more than RFC 3339 does, so a pattern guards them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: date, time, optional fraction, offset; RFC 3339 allows lower-case t and z.
RFC3339 = (
    r"^(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):([0-5]\d):([0-5]\d|60)"
    r"(?:\.(\d+))?(?:[Zz]|([+-])([01]\d|2[0-3]):([0-5]\d))$"
)


def rfc3339_seconds(c: Column | str) -> Column:
    """Whole epoch seconds (fraction dropped, rounded down), null for anything that is no RFC 3339 instant.

    A leap second (:60) counts as the first second of the next minute.
    """
    c = F.col(c) if isinstance(c, str) else c
    # the pattern fixes every place but the offset's, which is counted from the end
    two = lambda at: F.substring(c, at, 2).try_cast("int")
    days = F.unix_date(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")).cast("bigint")
    offset = F.when(F.substring(c, -1, 1).isin("Z", "z"), F.lit(0)).otherwise((two(-5) * 3600 + two(-2) * 60) * F.when(F.substring(c, -6, 1) == "-", -1).otherwise(1))
    return F.when(c.rlike(RFC3339), days * 86400 + two(12) * 3600 + two(15) * 60 + two(18) - offset)


def rfc3339_nanos(c: Column | str) -> Column:
    """Epoch nanoseconds as DECIMAL(38,0), digits past the ninth dropped; null when invalid."""
    c = F.col(c) if isinstance(c, str) else c
    frac = F.rpad(F.substring(F.regexp_extract(c, RFC3339, 7), 1, 9), 9, "0").try_cast("bigint")
    return rfc3339_seconds(c).cast("decimal(38,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + F.coalesce(
        frac, F.lit(0)
    ).cast("decimal(10,0)")


def utc_day(seconds: Column) -> Column:
    """yyyy-MM-dd of epoch seconds in UTC, whatever the session's zone."""
    return F.date_format(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")


def window_start(seconds: Column, width: int) -> Column:
    """Epoch-aligned tumbling window, floor division (right for negative seconds)."""
    return (F.floor(seconds / width) * width).cast("bigint")
