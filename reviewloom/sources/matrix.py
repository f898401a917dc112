"""Document-term matrices and labels as parquet."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

FEATURES, LABELS = "features.parquet", "labels.parquet"


def write_sparse_matrix(tf: DataFrame, labels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``(doc, term, weight)`` and ``(doc, label)``."""
    tf.write.mode(mode).parquet(os.path.join(path, FEATURES))
    labels.write.mode(mode).parquet(os.path.join(path, LABELS))


def read_sparse_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read both tables back; raises at once when either is missing."""
    try:
        return tuple(spark.read.parquet(os.path.join(path, name)) for name in (FEATURES, LABELS))
    except AnalysisException as error:
        raise FileNotFoundError(f"no complete matrix under {path}") from error
