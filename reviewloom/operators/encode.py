"""Label codes: alphabetical, starting at 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.bounded import bounded, broadcast_bounded

MAX_CLASSES = 10_000


def fit_label_map(df: DataFrame, label: str) -> DataFrame:
    """``(label, label_idx)`` for every distinct non-null label.

    A label set is small by nature; more than ``MAX_CLASSES`` labels raise, which also bounds the
    table so that joins may broadcast it.
    """
    distinct = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    classes = bounded(distinct, MAX_CLASSES, "labels").agg(F.sort_array(F.collect_list("label")).alias("_all"))
    return classes.select(F.posexplode("_all").alias("label_idx", "label")).select("label", "label_idx")


def _codes(label_map: DataFrame) -> DataFrame:
    renamed = label_map.select(F.col("label").alias("_label"), F.col("label_idx").alias("_idx"))
    return broadcast_bounded(renamed, MAX_CLASSES, "labels")


def label_encode(df: DataFrame, col: str, label_map: DataFrame, out: str = "label_idx") -> DataFrame:
    """Add the code of ``col``. A label the map does not know raises; null stays null."""
    codes = _codes(label_map)
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col(col))).cast("int")
    code = F.when(F.col(col).isNotNull() & F.col("_idx").isNull(), unseen).otherwise(F.col("_idx"))
    joined = df.join(codes, F.col(col) == F.col("_label"), "left")
    return joined.withColumn("_code", code).drop("_label", "_idx").withColumnRenamed("_code", out)


def label_decode(df: DataFrame, col: str, label_map: DataFrame, out: str = "label") -> DataFrame:
    """Add the label of code ``col``. An unknown code raises; null stays null."""
    codes = _codes(label_map)
    unseen = F.raise_error(F.concat(F.lit("unseen code: "), F.col(col).cast("string"))).cast("string")
    name = F.when(F.col(col).isNotNull() & F.col("_label").isNull(), unseen).otherwise(F.col("_label"))
    joined = df.join(codes, F.col(col).cast("int") == F.col("_idx"), "left")
    return joined.withColumn("_name", name).drop("_label", "_idx").withColumnRenamed("_name", out)
