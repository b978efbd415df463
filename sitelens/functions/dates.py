"""Date helpers: permit-date parsing, day differences, as-of parameters."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(d: str | _dt.date | Column) -> Column:
    if isinstance(d, Column):
        return d
    return F.lit(str(d)).cast("date")


def parse_permit_date(c: Column | str) -> Column:
    """Text -> DATE: drop ``/``, ``-`` and spaces, read ``yyyyMMdd``;
    anything that is not a real calendar day becomes NULL."""
    col = F.col(c) if isinstance(c, str) else c
    cleaned = F.regexp_replace(col.cast("string"), r"[/\- ]", "")
    # Exactly eight digits: the strict form the permit files use.
    parsed = F.try_to_timestamp(cleaned, F.lit("yyyyMMdd")).cast("date")
    return F.when(cleaned.rlike(r"^[0-9]{8}$"), parsed)


def days_between(end: Column, start: Column) -> Column:
    """Whole days ``end - start`` as BIGINT (may be negative)."""
    return F.datediff(end, start).cast("long")


def ntz(ts: _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal, independent of the session time zone."""
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
