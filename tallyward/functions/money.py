"""Aggregates over exact decimals.

Sums of decimals do not depend on the order in which partitions arrive, so every figure is
reproducible; results leave as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def total(column: str, scale: int) -> Column:
    return F.round(F.sum(column), scale).cast("double")


def mean(column: str, scale: int) -> Column:
    """Rounded mean over the non-NULL values of an amount or a count; NULL on empty input.

    Only the finished sum is widened, so a total of the same column shares its accumulator.
    """
    exact = F.sum(column).cast("decimal(28,2)")
    return F.round(F.try_divide(exact, F.count(column)), scale).cast("double")


def ratio_pct(part: str, whole: str, scale: int = 1) -> Column:
    """Ratio of sums in percent; NULL when the whole adds up to nothing."""
    ratio = F.try_divide(F.sum(part).cast("double"), F.sum(whole).cast("double"))
    return F.round(ratio * 100, scale)


def mean_ratio_pct(part: str, whole: str, scale: int = 1) -> Column:
    """Mean of the row ratios in percent; rows whose whole is zero drop out."""
    ratio = F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))
    return F.round(F.avg(ratio) * 100, scale)


def as_double(df: DataFrame) -> DataFrame:
    """Turn every decimal column into a double, for results that leave the engine."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ])
