"""Queries: training, prediction, grid search, persistence, and what a trained model does in the plans.

Settings are the reference's: all terms in scenarios 1 and 2, 2,000 in scenario 3, 100 rounds of depth 6, a grid of 72
points over 3 folds. What SQL can state about a model is in ``model_contract`` and ``scored_reviews``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.constants import GRID
from reviewloom.operators import encode
from reviewloom.operators import models as M
from reviewloom.operators.sampling import stratified_kfold
from reviewloom.plans import recommend as P
from reviewloom.plans import training as T
from reviewloom.session import cut_lineage, scratch_path
from reviewloom.sources.models import load_model as load
from reviewloom.sources.models import save_model as save
from reviewloom.workload.base import LEXICON, query, view
from reviewloom.workload.features import matrix_of
from reviewloom.workload.scoring import CR, R, WORDS, request_reviews, sql_list
from reviewloom.workload.text import sql_stem, sql_stop

BASELINE = M.ResampleSelectClassifier(k=None, resample=False)


def parts(spark, d):
    """Training and test rows, and the label map."""
    return T.model_rows(matrix_of(spark, d))


def shown(predicted, label_map):
    named = encode.label_decode(predicted, "prediction", label_map, "predicted")
    return named.select("review_id", F.col("sentiment").alias("actual"), "predicted")


@query("train_baseline")
def train_baseline(spark, d):
    train, test, label_map = parts(spark, d)
    return T.scenario_report(M.train_baseline(train).transform(test))


@query("predict")
def predict(spark, d):
    train, test, label_map = parts(spark, d)
    return shown(M.train_baseline(train).transform(test), label_map)


@query("predict_confidence")
def predict_confidence(spark, d):
    train, test, label_map = parts(spark, d)
    scored = M.train_baseline(train).transform(test)
    return scored.select("review_id", "prediction", F.round(M.predict_confidence(F.col("probability")), 6).alias("confidence"))


def searched(spark, d):
    train, test, _ = parts(spark, d)
    folds = cut_lineage(stratified_kfold(train, "label_idx", "review_id", 3))
    return M.grid_search(folds, GRID), test


@query("grid_search")
def grid_search(spark, d):
    search, test = searched(spark, d)
    return T.scenario_report(search.bestModel.transform(test))


@query("best_params")
def best_params(spark, d):
    search, _ = searched(spark, d)
    return M.best_params(spark, search).select("rank", F.round("macro_f1", 6).alias("macro_f1"), F.to_json("params").alias("params"))


@query("resample_select_classify")
def resample_select_classify(spark, d):
    train, test, label_map = parts(spark, d)
    return shown(M.ResampleSelectClassifier().fit(train).transform(test), label_map)


def served(spark, d):
    """The serving artefact of the baseline scenario."""
    matrix = matrix_of(spark, d)
    train, _, label_map = T.model_rows(matrix)
    return M.fit_sentiment(train, label_map, matrix.idf, BASELINE.copy())


@query("save_model")
def save_model(spark, d):
    path = scratch_path(spark, "model")
    save(served(spark, d), path)
    return spark.read.parquet(f"{path}/trees").select("tree", "node", "feature", "threshold", "left", "right", F.round("value", 9).alias("value"))


@query("load_model")
def load_model(spark, d):
    path = scratch_path(spark, "model")
    save(served(spark, d), path)
    rows = view(spark, d, "reviews")
    return load(path).score(rows).select("review_id", "predicted", F.round("confidence", 6).alias("confidence"))


@query(
    "model_contract",
    "SELECT review_id, true AS label_known, true AS confidence_in_range, true AS loaded_is_fitted, "
    "(SELECT count(DISTINCT sentiment) FROM reviews) AS labels, true AS confidence_varies FROM reviews",
    R,
)
def model_contract(spark, d):
    """What holds for every review, whatever the model has learned: the loaded artefact gives the fitted one's label and
    confidence, the label is one of the training labels, and the confidence lies between chance and certainty."""
    fitted, path = served(spark, d), scratch_path(spark, "model")
    save(fitted, path)
    rows, loaded = view(spark, d, "reviews"), load(path)
    own = cut_lineage(fitted.score(rows))
    again = loaded.score(rows).select("review_id", F.col("predicted").alias("p"), F.col("confidence").alias("c"))
    spread = own.agg(F.count_distinct(F.round("confidence", 6)).alias("n")).first()["n"]
    n = len(fitted.labels)
    return own.join(again, "review_id").select(
        "review_id", F.col("predicted").isin(loaded.labels).alias("label_known"), F.col("confidence").between(1 / n - 1e-9, 1.0).alias("confidence_in_range"),
        ((F.col("p") == F.col("predicted")) & (F.col("c") == F.col("confidence"))).alias("loaded_is_fitted"), F.lit(n).cast("long").alias("labels"), F.lit(spread > 1).alias("confidence_varies"),
    )


PREPARED = f"ready AS MATERIALIZED (SELECT review_id, review, lower(review) AS low, {sql_stem(sql_stop('lower(review)'))} AS prepared FROM reviews)"
EITHER_TEXT = f"list_filter({sql_list(WORDS)}, lambda k: contains(low, k) OR contains(prepared, k))"


@query("scored_reviews", f"WITH {PREPARED} SELECT review_id, review AS content, array_to_string({EITHER_TEXT}, '|') AS keywords, true AS labelled FROM ready", R)
def scored_reviews(spark, d):
    """Stored reviews from raw text: keywords of the raw or the prepared text, a label and a confidence on each."""
    rows = P.score_raw_reviews(view(spark, d, "reviews"), served(spark, d), lexicon=LEXICON)
    labelled = F.col("stored_sentiment").isin("POSITIVE", "NEGATIVE") & F.col("confidence").between(0.3, 1.0)
    return rows.select("review_id", F.col("review").alias("content"), F.array_join("keywords", "|").alias("keywords"), labelled.alias("labelled"))


@query("review_scoring_with_model")
def review_scoring_with_model(spark, d):
    rows = P.score_raw_reviews(view(spark, d, "reviews"), served(spark, d), lexicon=LEXICON)
    return rows.select("review_id", F.col("stored_sentiment").alias("sentiment"), F.round("confidence", 6).alias("confidence"), F.array_join("keywords", "|").alias("keywords"))


def model_recommended(spark, d):
    return P.recommend(request_reviews(spark, d).drop("sentiment"), view(spark, d, "candidates"), LEXICON, model=served(spark, d))


@query("recommend_with_model")
def recommend_with_model(spark, d):
    return model_recommended(spark, d).select(
        "request_id", "candidate_order", "name", "url", F.round("general_score", 6).alias("general_score"), "total_reviews", "positive_count", "negative_count", "verdict", "description", "rank", "winning_product"
    )


@query(
    "recommend_with_model_requests",
    "SELECT c.request_id, c.url, count(*) AS total_reviews, true AS sums_up, true AS winner_is_best FROM candidates c JOIN reviews r ON r.lang = c.request_id AND r.product = c.url GROUP BY c.request_id, c.url",
    CR,
)
def recommend_with_model_requests(spark, d):
    """What SQL can state of the model's recommendation: every candidate with its reviews, and that the winner scores best."""
    rows = cut_lineage(model_recommended(spark, d))
    top = rows.groupBy("request_id").agg(F.max("general_score").alias("top"))
    own = rows.filter("name = winning_product").groupBy("request_id").agg(F.max("general_score").alias("won"))
    joined = rows.join(top, "request_id").join(own, "request_id")
    return joined.select("request_id", "url", "total_reviews", (F.col("positive_count") + F.col("negative_count") == F.col("total_reviews")).alias("sums_up"), (F.col("won") == F.col("top")).alias("winner_is_best"))


@query("smote_sparse_report")
def smote_sparse_report(spark, d):
    from reviewloom.operators.smote import smote_report, smote_sparse

    train, _, _ = parts(spark, d)
    rows = smote_sparse(train, "label_idx", "review_id", "weights")
    return smote_report(train, rows, "label_idx")
