"""Date arithmetic with warehouse semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_crossed(start: Column, end: Column) -> Column:
    """Hour boundaries crossed between two timestamps; NULL if either is NULL."""
    return F.datediff(end, start) * 24 + F.hour(end) - F.hour(start)


def days_between(start: Column, end: Column) -> Column:
    """Calendar days from ``start`` to ``end``; times of day are ignored."""
    return F.datediff(end, start)


def shift_days(day: Column, days: int) -> Column:
    """``day`` moved by a fixed number of days."""
    return F.date_add(day, days)


def week_ending_sunday(day: Column) -> Column:
    """The date itself on a Sunday, else the next Sunday."""
    day = day.cast("date")
    return F.when(F.dayofweek(day) == 1, day).otherwise(F.next_day(day, "Sunday"))


def month_cohort(day: Column) -> Column:
    """Year and month as 'YYYYMM'."""
    return F.date_format(day, "yyyyMM")
