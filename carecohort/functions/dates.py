"""Date arithmetic with the counting rules the cohort definitions rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_gap(start: Column, end: Column) -> Column:
    """Midnights between two dates or timestamps (23:00 to 01:00 is one day)."""
    return F.date_diff(F.to_date(end), F.to_date(start))


def year_gap(start: Column, end: Column) -> Column:
    """New-Year boundaries between two dates: 31 Dec to 1 Jan is one year."""
    return F.year(end) - F.year(start)


def plus_years(day: Column, years: int) -> Column:
    """Same day ``years`` later; 29 February becomes the 28th."""
    return F.add_months(day, 12 * years)


def within_lookback(day: Column, visit: Column, days: int) -> Column:
    """``day`` lies 0 to ``days`` days before ``visit`` (same day included)."""
    return day_gap(day, visit).between(0, days)


def not_after(onset: Column, visit: Column) -> Column:
    """Onset known and not later than the visit, as 0/1.

    A date counts as its midnight, so an onset at 10:00 on the visit day is later.
    """
    return F.when(onset <= visit, 1).otherwise(0)


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Date from three text parts; NULL when a part is missing or impossible."""
    return F.try_to_date(F.concat(year, F.lit("/"), month, F.lit("/"), day), "y/M/d")
