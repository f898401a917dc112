"""Unfolding computed arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, keep: Sequence[str | Column], array: Column, out: str, position: str | None = None) -> DataFrame:
    """One row per array element, none for an empty or null array.

    A plain ``explode`` of a computed array computes it twice: Spark adds a filter on its size and
    pushes that below the projection. The outer form has no such filter, and the null rows it adds
    go right after. Elements must not be null.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position or "_pos", out)).filter(F.col(position or "_pos").isNotNull())
    return rows if position else rows.drop("_pos")
