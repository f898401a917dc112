"""Stored review and metric tables on parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.operators.store import replace_reviews

BUCKET = "bucket"
COUNT = "_buckets"  # beside the data: readers pass over names that start with an underscore


def with_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_review_table(df: DataFrame, path: str, key: str = "product_id", buckets: int = 64) -> None:
    """Create a review table partitioned by product bucket. Their number is stored with the table."""
    with_bucket(df, key, buckets).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    df.sparkSession.range(1).select(F.lit(buckets).alias("n")).write.mode("overwrite").parquet(f"{path}/{COUNT}")


def stored_buckets(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/{COUNT}").first()["n"]


def replace_reviews_in_table(
    spark: SparkSession, path: str, batch: DataFrame, key: str = "product_id", buckets: int | None = None
) -> None:
    """Replace all stored rows of the batch's products, those of a null product too.

    The table's own number of buckets is used; another one that is asked for raises.

    Only the buckets that hold those products are read and rewritten; the others stay as they are.
    The new files replace the old ones when the job commits, so a lost executor leaves the table whole;
    a driver lost during that commit can leave buckets half replaced, and the same call mends them.
    """
    own = stored_buckets(spark, path)
    if buckets not in (None, own):
        raise ValueError(f"the table has {own} buckets, not {buckets}")
    buckets = own
    stored = spark.read.parquet(path)
    incoming = with_bucket(batch, key, buckets).select(*stored.columns)
    # At most ``buckets`` numbers reach the driver: they become a partition filter.
    touched = [r[0] for r in incoming.select(BUCKET).distinct().limit(buckets).collect()]
    merged = replace_reviews(stored.filter(F.col(BUCKET).isin(touched)), incoming, key)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric rows; rows of the same analysis replace each other, so a retry adds nothing."""
    (
        metrics.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("analysis_id")
        .parquet(path)
    )


# ---------------------------------------------------------------- analyses and models
ANALYSES, METRICS, MODELS, COMMITS = "analyses", "metrics", "models", "commits"


def record_analysis(metrics: DataFrame, path: str, analysis_id: str, user_email: str) -> None:
    """Store the metrics of one run and, last, its analysis row, which they refer to.

    Metrics without their analysis row are not seen by :func:`stored_metrics`, so a run that broke off
    leaves nothing behind; the same run again replaces itself.
    """
    rows = metrics.drop("analysis_id").withColumn("analysis_id", F.lit(analysis_id))
    append_metrics(rows, f"{path}/{METRICS}")
    note = metrics.sparkSession.range(1).select(F.lit(user_email).alias("user_email"), F.lit(analysis_id).alias("analysis_id"))
    append_metrics(note, f"{path}/{ANALYSES}")


def stored_analyses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_email string, analysis_id string").parquet(f"{path}/{ANALYSES}")


def stored_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of completed analyses."""
    metrics = spark.read.parquet(f"{path}/{METRICS}").withColumn("analysis_id", F.col("analysis_id").cast("string"))
    return metrics.join(stored_analyses(spark, path), "analysis_id")


def register_models(registry: DataFrame, path: str, version: int) -> None:
    """Store one version of the model registry (a row per model), then commit it; the same version again
    replaces itself."""
    def put(rows: DataFrame, name: str) -> None:
        rows.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{path}/{name}")

    put(registry.drop("is_active", "version"), MODELS)
    put(registry.sparkSession.range(1).select(F.lit(True).alias("committed")), COMMITS)


def registered_models(spark: SparkSession, path: str) -> DataFrame:
    """All committed versions; ``is_active`` marks the last committed version of each model."""
    commits = spark.read.schema("committed boolean, version int").parquet(f"{path}/{COMMITS}").select("version")
    rows = spark.read.parquet(f"{path}/{MODELS}").join(commits, "version", "left_semi")
    last = F.max("version").over(Window.partitionBy("model_name"))
    return rows.withColumn("is_active", F.col("version") == last)
