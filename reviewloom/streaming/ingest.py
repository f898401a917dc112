"""Incremental ingest of review files."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from reviewloom.functions.keys import row_digest
from reviewloom.operators.dedup import dedup
from reviewloom.operators.models import SentimentModel
from reviewloom.session import cut_lineage

KEY, BATCH, BUCKET = "review_key", "batch_id", "key_bucket"
COUNT = "_buckets"  # beside the data: readers pass over names that start with an underscore


def stored_bucket_count(spark: SparkSession, target: str, buckets: int) -> int:
    """The table's own number of buckets; a new table gets ``buckets``."""
    path = os.path.join(target, COUNT)
    try:
        return spark.read.schema("n int").parquet(path).first()["n"]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    spark.range(1).select(F.lit(buckets).alias("n")).write.mode("overwrite").parquet(path)
    return buckets


def stream_ingest_reviews(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[Column | str],
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    file_filter: str = "*.parquet",
    max_files: int | None = None,
    model: SentimentModel | None = None,
    text: str = "review",
    buckets: int = 64,
) -> StreamingQuery:
    """Append reviews with a key not stored yet, as files arrive; stored rows win over new ones.

    ``prepare`` is the stateless part (clean, label, tag); a ``model`` adds its label and confidence for ``text`` to
    the rows that are kept. The target is laid out by buckets of the key's hash, and a micro-batch reads the keys of
    its own buckets only. Its rows go to partitions (bucket, batch): replaying a batch after a failure
    ignores and overwrites its partitions, so nothing is lost or doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        count = stored_bucket_count(spark, target, buckets)
        rows = dedup(prepare(batch).withColumn(KEY, row_digest(keys)), [KEY], list(order))
        rows = cut_lineage(rows.withColumn(BUCKET, F.pmod(F.xxhash64(KEY), F.lit(count)).cast("int")))
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        rows = rows.join(stored_keys(spark, target, touched, batch_id, rows.schema[KEY].dataType), KEY, "left_anti")
        if model is not None:
            asked = rows.select(F.col(KEY).alias(model.id_col), F.col(text).alias(model.text))
            rows = rows.join(model.score(asked).withColumnRenamed(model.id_col, KEY), KEY)
        whole = rows.withColumn(BATCH, F.lit(batch_id))
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, BATCH).parquet(target)

    stored_bucket_count(spark, target, buckets)  # without any row the target is an empty table
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_filter)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        reader.parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_keys(spark: SparkSession, target: str, touched: Sequence[int], batch_id: int, kind: T.DataType) -> DataFrame:
    """The keys stored by other batches in some buckets: only the files of these partitions are read."""
    schema = T.StructType([T.StructField(KEY, kind), T.StructField(BUCKET, T.IntegerType()), T.StructField(BATCH, T.LongType())])
    stored = spark.read.schema(schema).parquet(target)
    return stored.filter(F.col(BUCKET).isin(list(touched)) & (F.col(BATCH) != batch_id)).select(KEY)
