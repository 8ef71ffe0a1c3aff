"""One row per key, chosen the same way every time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row_per_key(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keep the smallest row of each key (columns compared left to right, NULLs first).

    A minimum combines on the map side, so a key that holds a third of the table still sends
    one row per map task over the network, where a ranked window would gather all its copies in
    one task. Rows with a NULL key are dropped first, before the shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    known = df.where(F.col(keys[0]).isNotNull())
    for key in keys[1:]:
        known = known.where(F.col(key).isNotNull())
    if not rest:
        return known.distinct()
    smallest = known.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return smallest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])
