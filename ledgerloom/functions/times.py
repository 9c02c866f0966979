"""Strict UTC times and calendar-date bounds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a time; Spark's own parser takes more.
UTC_TEXT = r"^\d{4}-\d{2}-\d{2}([Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2}))?$"


def parse_utc(c: Column) -> Column:
    """A timestamp from a full date or a date-time with zone; null for all else."""
    return F.when(F.rlike(c, F.lit(UTC_TEXT)), F.try_to_timestamp(F.upper(c)))


def on_or_between(ts: Column, start: date | str | None, end: date | str | None) -> Column:
    """Both days included, in UTC; a missing bound does not bind. Stated as a half-open range so that scans can use it."""
    out = F.lit(True)
    if start is not None:
        out = out & (ts >= F.lit(str(start)).cast("date"))
    if end is not None:
        out = out & (ts < F.date_add(F.lit(str(end)).cast("date"), 1))
    return out


def form_of_mode(mode: Column) -> Column:
    return F.when(F.lower(mode) == "annual", "10-K").when(F.lower(mode) == "quarterly", "10-Q")
