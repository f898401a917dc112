"""Broadcasting with a checked size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def bounded(df: DataFrame, limit: int, what: str) -> DataFrame:
    """``df`` itself, but the job fails if it has more than ``limit`` rows.

    No row is dropped: the limit only stops reading once the check is bound to fail.
    """
    packed = df.limit(limit + 1).agg(F.collect_list(F.struct(*df.columns)).alias("_rows"))
    failed = F.raise_error(F.lit(f"{what}: more than {limit} rows"))
    return packed.select(F.inline(F.when(F.size("_rows") > limit, failed).otherwise(F.col("_rows"))))


def broadcast_bounded(df: DataFrame, limit: int, what: str) -> DataFrame:
    """A broadcast side whose row count is checked at run time."""
    return F.broadcast(bounded(df, limit, what))


def few_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Collect a table that must be small; more than ``limit`` rows raise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def small_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A table of driver-side rows. Through Arrow it becomes a local relation, whose size Spark knows."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)
