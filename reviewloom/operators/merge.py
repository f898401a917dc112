"""Union and incremental merge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.keys import row_digest
from reviewloom.operators.dedup import dedup


def union_datasets(*frames: DataFrame, strict: bool = True) -> DataFrame:
    """Concatenate by column name. ``strict`` raises when an input's columns or types differ."""
    if not frames:
        raise ValueError("nothing to union")
    want = dict(frames[0].dtypes)
    for number, frame in enumerate(frames[1:], 2):
        if strict and dict(frame.dtypes) != want:
            raise ValueError(f"input {number} has columns {frame.dtypes}, expected {frames[0].dtypes}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=not strict), frames)


def _tagged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    fresh = new.withColumn("_is_new", F.lit(1))
    return fresh if old is None else union_datasets(old.withColumn("_is_new", F.lit(0)), fresh)


def merge_append_dedup(
    old: DataFrame | None, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """Old and new rows with one row per key; old rows win, then ``order`` decides.

    The first run has no old rows; then the new rows come back as they are, duplicates included.
    """
    if old is None:
        return new
    return dedup(_tagged(old, new), keys, ["_is_new", *order]).drop("_is_new")


def merge_stats(old: DataFrame | None, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: old rows, new rows, duplicates a merge removes. Only digests are shuffled."""
    per_key = (
        _tagged(old, new)
        .groupBy(row_digest(keys).alias("_k"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_is_new").alias("_new"))
    )
    removed = F.lit(0) if old is None else F.sum(F.col("_n") - 1)
    return per_key.agg(
        F.coalesce(F.sum(F.col("_n") - F.col("_new")), F.lit(0)).cast("bigint").alias("old_rows"),
        F.coalesce(F.sum("_new"), F.lit(0)).cast("bigint").alias("new_rows"),
        F.coalesce(removed, F.lit(0)).cast("bigint").alias("duplicates_removed"),
    )
