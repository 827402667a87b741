"""Quarter arithmetic. ``today`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRACE_DAYS = 7  #: works that start up to so many days before their quarter belong to it


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter")


def shift_quarters(d: Column, n: int) -> Column:
    return F.add_months(d, 3 * n)


def season_window(today: Column) -> tuple[Column, Column]:
    """First and last day, both included, of the quarters before, of and after ``today``'s."""
    q = quarter_start(today)
    return F.date_sub(shift_quarters(q, -1), GRACE_DAYS), F.date_sub(shift_quarters(q, 2), 1)


def quarter_window(d: Column) -> tuple[Column, Column]:
    """First day, included, and end, excluded, of the quarter of ``d``; neighbours share the days of grace."""
    q = quarter_start(d)
    return F.date_sub(q, GRACE_DAYS), shift_quarters(q, 1)


def years_close(a: Column, b: Column, most: int = 1) -> Column:
    """Whether two years differ by ``most`` at most; an unknown year is close to none."""
    return F.coalesce(F.abs(a - b) <= most, F.lit(False))
