"""Exploding of arrays that are costly to compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, columns, array: Column | str, element: str,
             position: str | None = None) -> DataFrame:
    """One row per element. For an inner explode the optimizer adds a filter on the size of the
    array, and so computes it twice (and below a shuffle); the outer form computes it once."""
    if position is None:
        rows = df.select(*columns, F.explode_outer(array).alias(element))
        return rows.where(F.col(element).isNotNull())
    rows = df.select(*columns, F.posexplode_outer(array).alias(position, element))
    return rows.where(F.col(position).isNotNull())
