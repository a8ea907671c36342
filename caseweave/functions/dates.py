"""Dates, day distances and inclusive date ranges as column expressions.

A range is ``struct<start: date, end: date>`` and holds both its ends. Its end may be open
(built from a null), in which case it is stored as ``OPEN_END``. It is empty when start > end.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

OPEN_END = "9999-12-31"


def days_between(earlier, later) -> Column:
    """Whole days from ``earlier`` to ``later``; negative when the order is reversed."""
    return F.datediff(later, earlier)


def day_number(date) -> Column:
    """Days since 1970-01-01, so that day arithmetic and range frames use plain integers."""
    return F.unix_date(date)


def year_of(date) -> Column:
    return F.year(date).cast("long")


def date_range(start, end) -> Column:
    """Inclusive range; a null end is open."""
    return F.struct(
        F.to_date(start).alias("start"),
        F.coalesce(F.to_date(end), F.lit(OPEN_END).cast("date")).alias("end"),
    )


def range_is_empty(r: Column) -> Column:
    return r["start"] > r["end"]


def range_intersection(*ranges: Column) -> Column:
    """Common part of the ranges; empty when they share no day."""
    return F.struct(
        F.greatest(*[r["start"] for r in ranges]).alias("start"),
        F.least(*[r["end"] for r in ranges]).alias("end"),
    )


def ranges_overlap(*ranges: Column) -> Column:
    """True when all ranges share a day. An empty range overlaps nothing."""
    return ~range_is_empty(range_intersection(*ranges))
