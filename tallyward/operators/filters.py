"""Typed predicates: a filter value is always data, never query text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eq_filters(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows equal to every given value; a missing or empty value puts no condition."""
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == F.lit(value))
    return df


def in_filters(df: DataFrame, **wanted: Iterable[str] | None) -> DataFrame:
    """Rows whose columns are among the given values; an empty selection puts no condition."""
    for column, values in wanted.items():
        values = list(values or ())
        if values:
            df = df.where(F.col(column).isin(values))
    return df


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named dimensions are all present."""
    for column in columns:
        df = df.where(F.col(column).isNotNull())
    return df


def check_limit(limit: int, low: int, high: int) -> int:
    if not low <= limit <= high:
        raise ValueError(f"limit must be between {low} and {high}, not {limit}")
    return limit
