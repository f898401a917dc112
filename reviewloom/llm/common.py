"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast sides stay below this many rows of a few numbers each; larger ones join by shuffle.
BROADCAST_ROWS = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_remainder(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % divisor


def small_enough(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it is counted to have at most ``rows`` rows, else as it is.

    ``side`` should be a written table: it is counted first.
    """
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side
