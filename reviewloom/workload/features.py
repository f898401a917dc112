"""Queries: text features, selection and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.operators import features as X
from reviewloom.plans import training as T
from reviewloom.plans.training import build_matrix
from reviewloom.session import cut_lineage, scratch_path
from reviewloom.sources import matrix
from reviewloom.workload.base import STOP_WORDS, query, sql_list, view
from reviewloom.workload.prepare import SPLIT_SQL

R = ("reviews",)
TOKENS = r"regexp_extract_all(lower(review), '[\p{L}\p{N}_]{2,}')"
COUNTS = f"""toks AS (SELECT review_id, sentiment, unnest({TOKENS}) AS term FROM split WHERE split = 'train'),
cnt AS (SELECT review_id, sentiment, term, count(*) AS n FROM toks GROUP BY ALL)"""
IDF = """idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM split WHERE split = 'train'))::DOUBLE / (1 + count(*))) + 1 AS idf FROM cnt GROUP BY term)"""
WEIGHTS = """raw AS (SELECT review_id, sentiment, term, n * idf AS w FROM cnt JOIN idf USING (term)),
norm AS (SELECT review_id, sqrt(sum(w * w)) AS s FROM raw GROUP BY review_id),
tf AS (SELECT raw.review_id, sentiment, term, w / s AS weight FROM raw JOIN norm USING (review_id))"""
CHI2 = """share AS (SELECT sentiment, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM split WHERE split = 'train' GROUP BY sentiment),
obs AS (SELECT term, sentiment, sum(weight) AS o FROM tf GROUP BY ALL),
tot AS (SELECT term, sum(o) AS t FROM obs GROUP BY term),
cells AS (SELECT t.term, s.sentiment, s.p * t.t AS e, coalesce(o.o, 0) AS o FROM tot t CROSS JOIN share s LEFT JOIN obs o ON o.term = t.term AND o.sentiment = s.sentiment),
chi AS (SELECT term, sum((o - e) * (o - e) / e) AS chi2 FROM cells GROUP BY term),
best AS (SELECT term, chi2 FROM chi ORDER BY round(chi2, 9) DESC, term DESC LIMIT 1000)"""
TRAIN = f"WITH {SPLIT_SQL}, {COUNTS}, {IDF}, {WEIGHTS}"


def matrix_of(spark, d):
    """The split reviews with their counts, idf and weights."""
    return build_matrix(split_reviews(spark, d), "sentiment", "review_id", "review")


def split_reviews(spark, d):
    return T.split_reviews(view(spark, d, "reviews").select("review_id", "username", "review", "sentiment"), "sentiment", "review_id", ["username", "review"])


def train_scores(spark, d):
    docs, weights = matrix_of(spark, d).part("train")
    return X.chi2_scores(weights, docs, "review_id", "sentiment")


@query("tokenize", f"SELECT review_id, term, count(*) AS n FROM (SELECT review_id, unnest({TOKENS}) AS term FROM reviews) GROUP BY ALL", R)
def tokenize(spark, d):
    tokens = X.tokenize(view(spark, d, "reviews"), "review_id", "review")
    return tokens.groupBy("review_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("term_counts", f"SELECT review_id, sentiment, term, count(*) AS n FROM (SELECT review_id, sentiment, unnest({TOKENS}) AS term FROM reviews) GROUP BY ALL", R)
def term_counts(spark, d):
    return X.term_counts(view(spark, d, "reviews"), "review_id", "review", keep=["sentiment"])


@query("term_document_frequency", f"SELECT term, count(DISTINCT review_id) AS df FROM (SELECT review_id, unnest({TOKENS}) AS term FROM reviews) GROUP BY term", R)
def term_document_frequency(spark, d):
    return X.term_document_frequency(X.term_counts(view(spark, d, "reviews"), "review_id", "review"))


@query("vocabulary", f"SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx FROM (SELECT DISTINCT unnest({TOKENS}) AS term FROM reviews)", R)
def vocabulary(spark, d):
    return X.vocabulary(X.tokenize(view(spark, d, "reviews"), "review_id", "review"))


@query("tfidf_fit", f"WITH {SPLIT_SQL}, {COUNTS}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf", R)
def tfidf_fit(spark, d):
    return matrix_of(spark, d).idf.withColumn("idf", F.round("idf", 6))


# The test part, weighted with the vocabulary of the training part.
TEST_TF = f"""{TRAIN}, ttoks AS (SELECT review_id, unnest({TOKENS}) AS term FROM split WHERE split = 'test'),
tcnt AS (SELECT review_id, term, count(*) AS n FROM ttoks GROUP BY ALL),
traw AS (SELECT review_id, term, n * idf AS w FROM tcnt JOIN idf USING (term)),
tnorm AS (SELECT review_id, sqrt(sum(w * w)) AS s FROM traw GROUP BY review_id)
SELECT review_id, 'test' AS part, term, round(w / s, 6) AS weight FROM traw JOIN tnorm USING (review_id)
UNION ALL SELECT review_id, 'train', term, round(weight, 6) FROM tf"""


@query("tfidf_transform", TEST_TF, R)
def tfidf_transform(spark, d):
    weights = matrix_of(spark, d).weights
    return weights.select("review_id", F.col("split").alias("part"), "term", F.round("weight", 6).alias("weight"))


@query("chi2_scores", f"{TRAIN}, {CHI2} SELECT term, round(chi2, 6) AS chi2 FROM chi", R)
def chi2_scores(spark, d):
    return train_scores(spark, d).withColumn("chi2", F.round("chi2", 6))


@query("select_k_best", f"{TRAIN}, {CHI2} SELECT term, round(chi2, 6) AS chi2 FROM best", R)
def select_k_best(spark, d):
    scores = train_scores(spark, d)
    return X.select_k_best(scores, 1000).withColumn("chi2", F.round("chi2", 6))


@query(
    "selection_shape_report",
    f"{TRAIN}, {CHI2} SELECT 'before' AS stage, count(*) AS n_features FROM chi UNION ALL SELECT 'after', count(*) FROM best",
    R,
)
def selection_shape_report(spark, d):
    scores = cut_lineage(train_scores(spark, d))
    return X.selection_shape_report(scores, X.select_k_best(scores, 1000))


@query(
    "top_keywords",
    f"""WITH toks AS (SELECT product, review_id, unnest({TOKENS}) AS term FROM reviews),
        df AS (SELECT term, count(DISTINCT review_id) AS df FROM toks GROUP BY term),
        idf AS (SELECT term, ln((1 + (SELECT count(*) FROM reviews))::DOUBLE / (1 + df)) + 1 AS idf FROM df),
        w AS (SELECT product, term, count(*) * any_value(idf) AS weight FROM toks JOIN idf USING (term) GROUP BY product, term)
        SELECT product, CAST(rank AS INT) AS rank, term, round(weight, 6) AS weight FROM
        (SELECT *, row_number() OVER (PARTITION BY product ORDER BY round(weight, 9) DESC, term) AS rank FROM w) WHERE rank <= 5""",
    R,
)
def top_keywords(spark, d):
    docs = view(spark, d, "reviews")
    counts = cut_lineage(X.term_counts(docs, "review_id", "review", keep=["product"]))
    return X.top_keywords(counts, cut_lineage(X.tfidf_fit(counts, docs)), "product").withColumn("weight", F.round("weight", 6))


def words_sql(source: str) -> str:
    return f"""WITH {source} SELECT sentiment, term, n, CAST(rank AS INT) AS rank FROM
      (SELECT sentiment, term, count(*) AS n, row_number() OVER (PARTITION BY sentiment ORDER BY count(*) DESC, term) AS rank
       FROM toks GROUP BY sentiment, term) WHERE rank <= 100"""


@query("word_frequencies", words_sql(f"toks AS (SELECT sentiment, term FROM (SELECT sentiment, unnest({TOKENS}) AS term FROM reviews) WHERE NOT list_contains({sql_list(STOP_WORDS)}, term))"), R)
def word_frequencies(spark, d):
    return X.word_frequencies(view(spark, d, "reviews"), "sentiment", "review", stop=STOP_WORDS)


@query(
    "word_pair_frequencies",
    words_sql(
        f"""lists AS (SELECT sentiment, list_filter({TOKENS}, lambda t: NOT list_contains({sql_list(STOP_WORDS)}, t)) AS l FROM reviews),
        toks AS (SELECT sentiment, concat(l[i], ' ', l[i + 1]) AS term FROM (SELECT sentiment, l, unnest(range(1, len(l))) AS i FROM lists))"""
    ),
    R,
)
def word_pair_frequencies(spark, d):
    return X.word_frequencies(view(spark, d, "reviews"), "sentiment", "review", stop=STOP_WORDS, ngram=2)


def stored_matrix(spark, d):
    path = scratch_path(spark, "matrix")
    docs, weights = matrix_of(spark, d).part("train")
    matrix.write_sparse_matrix(weights, docs.select("review_id", "sentiment"), path)
    return matrix.read_sparse_matrix(spark, path)


@query("write_sparse_matrix", f"WITH {SPLIT_SQL} SELECT review_id, sentiment FROM split WHERE split = 'train'", R)
def write_sparse_matrix(spark, d):
    return stored_matrix(spark, d)[1]


@query("read_sparse_matrix", f"{TRAIN} SELECT review_id, term, round(weight, 6) AS weight FROM tf", R)
def read_sparse_matrix(spark, d):
    return stored_matrix(spark, d)[0].withColumn("weight", F.round("weight", 6)).select("review_id", "term", "weight")


@query("to_sparse_vectors", f"{TRAIN}, {CHI2} SELECT review_id, CAST(count(*) AS INTEGER) AS non_zero, round(sum(weight), 6) AS weight_sum FROM tf JOIN best USING (term) GROUP BY review_id", R)
def to_sparse_vectors(spark, d):
    from pyspark.ml.functions import vector_to_array

    docs, weights = matrix_of(spark, d).kept().part("train")
    best = cut_lineage(X.select_k_best(X.chi2_scores(weights, docs, "review_id", "sentiment"), 1000))
    vectors = X.to_sparse_vectors(weights, X.vocabulary(best), 1000, "review_id")
    dense = vector_to_array("features")
    return vectors.select(
        "review_id",
        F.size(F.filter(dense, lambda x: x != 0)).alias("non_zero"),
        F.round(F.aggregate(dense, F.lit(0.0), lambda a, x: a + x), 6).alias("weight_sum"),
    )
