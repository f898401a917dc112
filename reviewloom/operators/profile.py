"""Counts and proportions. Every shuffle carries pre-aggregated counts only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.merge import union_datasets


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, nulls left out. Sort by ``n`` where an ordered report is needed."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def rating_distribution(df: DataFrame, rating: str = "Rating") -> DataFrame:
    return value_counts(df, rating).orderBy(rating)


def class_proportions(df: DataFrame, label: str) -> DataFrame:
    """Count and percentage per class."""
    counts = value_counts(df, label)
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select(label, "n", (F.col("n") * 100.0 / total).alias("pct"))


def class_balance_check(df: DataFrame, label: str) -> DataFrame:
    """One row: are all class counts equal?"""
    return value_counts(df, label).agg(
        F.count(F.lit(1)).alias("classes"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        (F.min("n") == F.max("n")).alias("balanced"),
    )


def dataset_overview(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, number of columns and column names of each input."""
    parts = [
        frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("dataset"),
            "n_rows",
            F.lit(len(frame.columns)).alias("n_columns"),
            F.lit(",".join(frame.columns)).alias("columns"),
        )
        for name, frame in frames.items()
    ]
    return union_datasets(*parts)
