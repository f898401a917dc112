"""CSV in the reference dialect: header, quoted text with line breaks, quotes doubled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.constants import URL_COLUMN_NAMES

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("Source_URL", "Username", "Review", "Cleaned_Review", "Rating", "Date", "Sentiment")
    ]
)
DIALECT = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_reviews_csv(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA) -> DataFrame:
    """Reviews from CSV with a fixed schema. Empty fields come back as null.

    Quoted line breaks make a single file unsplittable, so a large data set should arrive as many
    files, and be kept as parquet after this step. A byte-order mark at the start is ignored.
    """
    return spark.read.schema(schema).options(**DIALECT, multiLine=True, enforceSchema=True).csv(path)


def write_reviews_csv(df: DataFrame, path: str, bom: bool = False, mode: str = "overwrite") -> None:
    """Write CSV, one file per partition. ``bom=True`` marks each file as UTF-8 for spreadsheets."""
    options = dict(DIALECT, escapeQuotes=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    out = df
    if bom:
        first, *rest = df.columns
        out = df.select(F.col(first).alias("﻿" + first), *rest)
    out.write.mode(mode).options(**options).csv(path)


def load_url_list(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """``(url)`` from a CSV: the first column with a known name, else the first column; only values
    that start with ``http``."""
    table = spark.read.options(**DIALECT, multiLine=True).csv(path)
    return select_urls(table, names)


def select_urls(table: DataFrame, names: list[str] | None = None) -> DataFrame:
    known = URL_COLUMN_NAMES if names is None else names
    found = [c for c in table.columns if c.lstrip("﻿").lower() in known]
    column = (found or table.columns)[0]
    return table.select(F.col(f"`{column}`").alias("url")).filter(F.col("url").startswith("http"))


def seed_urls(table: DataFrame, url: str = "url") -> DataFrame:
    """Distinct non-empty URLs of a seed table."""
    return table.select(F.col(url).alias("url")).filter(F.col("url") != "").distinct()
