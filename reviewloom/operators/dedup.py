"""De-duplication. Copies are dropped map-side first, so a hot group of copies never meets in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.functions.keys import row_digest

REVIEW_USER = ("Review", "Username")
USER_CLEAN_DATE = ("Username", "Cleaned_Review", "Date")


def dedup_exact(df: DataFrame) -> DataFrame:
    """Drop rows equal in every column."""
    return df.dropDuplicates()


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row per key by ``order`` (null keys are equal to each other).

    ``row_number() = 1`` is planned with a group limit before the exchange, so each map task passes
    on at most one row per key. The 64-bit hash leads the sort so that long keys are compared only
    on a hash tie.
    """
    window = W.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def duplicate_count(df: DataFrame, keys: Sequence[str], out: str = "duplicates") -> DataFrame:
    """Rows that repeat an earlier key. Only digests are shuffled."""
    per_key = df.groupBy(row_digest(keys).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(out))
