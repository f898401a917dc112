"""From reviews to product results, rankings and a winner per request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.constants import ASPECT_KEYWORDS, POSITIVE
from reviewloom.functions.text import preprocess_serve
from reviewloom.operators.aspects import Lexicon, aspect_tag, product_results, product_sums
from reviewloom.operators.models import SentimentModel
from reviewloom.operators.ranking import bucketed_row_number
from reviewloom.operators.store import metric_rows

ORDER_CHUNK = 65_536


def review_scoring(
    reviews: DataFrame,
    text: str = "review",
    sentiment: str = "sentiment",
    lexicon: Lexicon = ASPECT_KEYWORDS,
    prepared: str | None = None,
    confidence: str | None = None,
) -> DataFrame:
    """Stored form of each review: POSITIVE or NEGATIVE (neutral too), confidence, keywords, aspects.

    Without a confidence column the confidence is 1.
    """
    return stored_form(aspect_tag(reviews, text, lexicon, prepared), sentiment, confidence)


def stored_form(tagged: DataFrame, sentiment: str, confidence: str | None) -> DataFrame:
    """Add the stored sentiment and the confidence."""
    level = F.coalesce(F.col(confidence), F.lit(1.0)) if confidence else F.lit(1.0)
    stored = F.when(F.col(sentiment) == POSITIVE, "POSITIVE").otherwise("NEGATIVE")
    return tagged.withColumn("stored_sentiment", stored).withColumn("confidence", level)


def label_reviews(reviews: DataFrame, model: SentimentModel, text: str = "review") -> DataFrame:
    """Add the model's label and confidence to every review, from its raw text."""
    return reviews.join(model.score(reviews.withColumnRenamed(text, model.text)), model.id_col)


def score_raw_reviews(reviews: DataFrame, model: SentimentModel, text: str = "review", lexicon: Lexicon = ASPECT_KEYWORDS) -> DataFrame:
    """Stored form of each review from its raw text: the model's label and confidence, and the keywords found in the
    raw or the prepared text."""
    # Keywords come first: the prepared text stays where it is.
    tagged = aspect_tag(reviews.withColumn("_ready", preprocess_serve(text)), text, lexicon, "_ready").drop("_ready")
    return stored_form(label_reviews(tagged, model, text), model.out, "confidence")


def score_products(
    reviews: DataFrame,
    by: Sequence[str],
    text: str = "review",
    sentiment: str = "sentiment",
    lexicon: Lexicon = ASPECT_KEYWORDS,
    prepared: str | None = None,
    model: SentimentModel | None = None,
) -> DataFrame:
    """One result row per product: a narrow pass over the reviews and one shuffle of sums.

    With a ``model`` the sentiment is its label for the raw text, and keywords are searched in the raw and the
    prepared text. Texts stay where they are: the label joins rows of ids and aspects.
    """
    if model is None:
        return product_results(product_sums(aspect_tag(reviews, text, lexicon, prepared), by, lexicon, sentiment), by)
    tagged = aspect_tag(reviews.withColumn("_ready", preprocess_serve(text)), text, lexicon, "_ready").select(model.id_col, *by, "aspects")
    labelled = tagged.join(model.score(reviews.withColumnRenamed(text, model.text)), model.id_col)
    return product_results(product_sums(labelled, by, lexicon, model.out), by)


def product_metrics(results: DataFrame, analysis_id: str, model_name: str) -> DataFrame:
    return metric_rows(results, analysis_id, model_name)


def rank_products(
    scored: DataFrame, by: str, order: str, score: str = "general_score", out: str = "rank", giant: bool = False
) -> DataFrame:
    """Rank the candidates of each request by score, best first; ties keep request order.

    One window per request. ``giant=True`` is for requests that one task should not order: rows fall into
    whole-percent buckets and runs of request positions first, which costs several exchanges.
    """
    best = [-F.round(F.col(score), 9), F.col(order)]
    if not giant:
        return scored.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*best)).cast("bigint"))
    # Within a whole percent the score still decides before the position does.
    buckets = [-F.floor(score), best[0], F.floor(F.col(order) / ORDER_CHUNK)]
    return bucketed_row_number(scored, [by], buckets, [F.col(order)], out)


def winners(ranked: DataFrame, by: str, name: str, rank: str = "rank") -> DataFrame:
    """The first-ranked candidate of each request."""
    return ranked.filter(F.col(rank) == 1).select(by, F.col(name).alias("winning_product"))


def recommend(
    reviews: DataFrame,
    candidates: DataFrame,
    lexicon: Lexicon = ASPECT_KEYWORDS,
    text: str = "review",
    sentiment: str = "sentiment",
    prepared: str | None = None,
    model: SentimentModel | None = None,
) -> DataFrame:
    """Result of every candidate with reviews, its rank, and its request's winner.

    With a ``model`` the reviews are raw text and unique ids; without one they carry a ``sentiment``.

    ``candidates`` is ``(request_id, candidate_order, name, url)``; ``reviews`` carries
    ``request_id`` and ``url``. Candidates without reviews are left out; a request none of whose
    candidates has reviews has no rows.
    """
    results = score_products(reviews, ["request_id", "url"], text, sentiment, lexicon, prepared, model)
    ranked = rank_products(candidates.join(results, ["request_id", "url"]), "request_id", "candidate_order")
    whole = Window.partitionBy("request_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranked.withColumn("winning_product", F.first("name").over(whole))


def responses(recommended: DataFrame) -> DataFrame:
    """Nested response per request: winner, and details in request order.

    The details are one array per request, as the response format asks: for requests as users send
    them, with candidate lists that fit one message. Larger ones stay in the flat form.
    """
    detail = F.struct(
        "candidate_order", "name", "url", "general_score", "aspect_scores", "total_reviews",
        "positive_count", "negative_count", "verdict", "description",
    )
    # Maps cannot be compared, so the order is restored through the position alone.
    ordered = F.array_sort(
        F.collect_list(detail), lambda a, b: (a["candidate_order"] - b["candidate_order"]).cast("int")
    )
    return recommended.groupBy("request_id", "winning_product").agg(
        F.lit("ASPECT_BASED").alias("analysis_type"), ordered.alias("details")
    )
