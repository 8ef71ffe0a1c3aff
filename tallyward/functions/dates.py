"""Date arithmetic relative to an explicit reference day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_years(birth_date: Column, as_of: Column) -> Column:
    """Whole 365-day years since birth (not calendar age); a death date does not stop the count."""
    return F.floor(F.datediff(as_of, birth_date) / 365)


def hours_between(start: Column, stop: Column) -> Column:
    """Whole seconds between two timestamps as hours, two decimals, negative when reversed."""
    return F.round((F.unix_timestamp(stop) - F.unix_timestamp(start)) / 3600, 2)


def month_start(year: str, month: str) -> Column:
    return F.make_date(F.col(year), F.col(month), F.lit(1))
