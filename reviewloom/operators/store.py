"""Effects on the stored tables (products, brands, reviews, metrics), as DataFrame → DataFrame steps.

Ids are derived from the natural key, so a re-run gives the same ids and no counter is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import clean_product_name, derive_brand
from reviewloom.operators.bounded import broadcast_bounded
from reviewloom.operators.dedup import dedup

MAX_MODELS = 100_000


def stable_id(col: str):
    return F.md5(F.col(col))


def anti_new_rows(candidates: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates whose key is not stored yet. Only the stored keys are read."""
    return candidates.join(existing.select(*keys), list(keys), "left_anti")


def upsert_brands(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Stored brands ``(brand_id, name)`` plus one new row per brand name not stored yet."""
    names = candidates.select(derive_brand("name").alias("name")).distinct()
    fresh = anti_new_rows(names, existing, ["name"]).select(stable_id("name").alias("brand_id"), "name")
    return existing.unionByName(fresh)


def upsert_products(existing: DataFrame, candidates: DataFrame, order: Sequence[str] = ("name",)) -> DataFrame:
    """Stored products ``(product_id, url, name, brand_id)`` plus one new row per URL not stored yet.

    When new candidates repeat a URL the first by ``order`` creates the product.
    """
    fresh = dedup(anti_new_rows(candidates, existing, ["url"]), ["url"], list(order))
    rows = fresh.withColumn("_brand", derive_brand("name")).select(
        stable_id("url").alias("product_id"),
        "url",
        clean_product_name("name").alias("name"),
        stable_id("_brand").alias("brand_id"),
    )
    return existing.unionByName(rows)


def replace_reviews(existing: DataFrame, batch: DataFrame, key: str = "product_id") -> DataFrame:
    """Stored reviews, with all rows of the batch's products replaced by the batch."""
    gone = batch.select(F.col(key).alias("_gone")).distinct()
    kept = existing.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
    return kept.unionByName(batch)


def lookup_product_by_url(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """Candidates with the stored ``product_id`` and name, null where the URL is unknown."""
    stored = products.select("url", "product_id", F.col("name").alias("stored_name"))
    return candidates.join(stored, "url", "left")


def lookup_user_by_email(requests: DataFrame, users: DataFrame, email: str = "user_email") -> DataFrame:
    """Requests of known users; the others are dropped."""
    return requests.join(users.select(F.col("email").alias(email)), email, "left_semi")


def lookup_model_by_name(requests: DataFrame, models: DataFrame, name: str = "model_name") -> DataFrame:
    """Requests whose model is registered; the others are dropped. Few names hold all requests, so
    the registry is broadcast and they are not shuffled."""
    registered = broadcast_bounded(models.select(name).distinct(), MAX_MODELS, "registered models")
    return requests.join(registered, name, "left_semi")


def drop_empty_candidates(candidates: DataFrame, reviews: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates with at least one review. The reviews shrink to their distinct keys map-side."""
    return candidates.join(reviews.select(*keys).distinct(), list(keys), "left_semi")


def metric_rows(results: DataFrame, analysis_id: str, model_name: str) -> DataFrame:
    """Metric rows of one run: score (stored twice, as two named measures), verdict, summary."""
    return results.select(
        F.lit(analysis_id).alias("analysis_id"),
        F.lit(model_name).alias("model_name"),
        "product",
        F.col("general_score").alias("general_sentiment"),
        F.col("general_score").alias("compatibility_score"),
        "verdict",
        F.array("description").alias("top_keywords"),
    )
