"""Queries: aspects, verdicts, rankings, recommendations, and evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.operators import aspects as A
from reviewloom.operators import evaluate as E
from reviewloom.operators.store import drop_empty_candidates
from reviewloom.plans import recommend as P
from reviewloom.workload.base import LEXICON, query, sql_list, view

R = ("reviews",)
WORDS = sorted({w for group in LEXICON.values() for w in group})
HITS = f"list_filter({sql_list(WORDS)}, lambda k: contains(lower(review), k))"
LEX = "lex AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS aspect, {i} AS aspect_order, unnest({sql_list(ws)}) AS keyword" for i, (a, ws) in enumerate(LEXICON.items())
) + ")"
NAMES = "names AS (SELECT DISTINCT aspect, aspect_order FROM lex)"
TAGS = f"""{LEX}, {NAMES}, found AS (SELECT review_id, product, lang, sentiment, unnest({HITS}) AS keyword FROM reviews),
tags AS (SELECT DISTINCT review_id, product, lang, sentiment, aspect, aspect_order FROM found JOIN lex USING (keyword))"""
STATS = f"""{TAGS}, products AS (SELECT DISTINCT product FROM reviews),
stats AS (SELECT p.product, n.aspect, n.aspect_order, count(t.review_id) AS total, count(CASE WHEN t.sentiment = 'positif' THEN 1 END) AS positive
  FROM products p CROSS JOIN names n LEFT JOIN tags t ON t.product = p.product AND t.aspect = n.aspect GROUP BY ALL),
scores AS (SELECT *, CASE WHEN total > 0 THEN round_even(positive / total * 100, 1) ELSE 0.0::DOUBLE END AS score FROM stats)"""
PCT = "count(CASE WHEN sentiment = 'positif' THEN 1 END) / count(*) * 100"
BEST = """seen AS (SELECT * FROM scores WHERE total > 0),
best AS (SELECT product, aspect AS best_aspect, score AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY score DESC, aspect_order) AS r FROM seen) WHERE r = 1),
worst AS (SELECT product, aspect AS worst_aspect, score AS worst_score FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY score, aspect_order) AS r FROM seen) WHERE r = 1)"""
SUMMARY = """CASE WHEN best_aspect IS NULL THEN 'Ulasan umum tidak spesifik membahas aspek teknis tertentu.'
  ELSE concat('Produk ini sangat unggul pada aspek ', upper(best_aspect), '.',
    CASE WHEN worst_score < 60 THEN concat(' Namun, pengguna sering mengeluhkan ', upper(worst_aspect), '.') ELSE '' END) END"""
VERDICT = "CASE WHEN {0} > 80 THEN 'Sangat Direkomendasikan' WHEN {0} > 60 THEN 'Layak Dipertimbangkan' ELSE 'Kurang Disarankan' END"


def reviews(spark, d):
    return view(spark, d, "reviews")


def tagged(spark, d):
    return A.aspect_tag(reviews(spark, d), "review", LEXICON)


def stats(spark, d):
    return A.aspect_stats(tagged(spark, d), ["product"], LEXICON)


def scores(spark, d):
    return A.aspect_scores(stats(spark, d))


@query("aspect_keyword_match", "SELECT review_id, contains(lower(review), 'ram') OR contains(lower(review), 'und') AS matched FROM reviews", R)
def aspect_keyword_match(spark, d):
    low = F.lower("review")
    hit = A.aspect_keyword_match("ram", low, F.lit("")) | A.aspect_keyword_match("und", low, F.lit(""))
    return reviews(spark, d).select("review_id", hit.alias("matched"))


ASPECT_JOIN = "coalesce((SELECT string_agg(aspect, ',' ORDER BY aspect_order) FROM tags t WHERE t.review_id = r.review_id), '')"


@query("aspect_tag", f"WITH {TAGS} SELECT review_id, array_to_string({HITS}, ',') AS keywords, {ASPECT_JOIN} AS aspects FROM reviews r", R)
def aspect_tag(spark, d):
    return tagged(spark, d).select(
        "review_id", F.array_join("keywords", ",").alias("keywords"), F.array_join("aspects", ",").alias("aspects")
    )


# Hundreds of more keywords, none of which occurs.
LARGE_LEXICON = LEXICON | {"garansi": [*LEXICON["garansi"], *(f"kata{i}tak" for i in range(400))]}


@query("aspect_tag_large_lexicon", f"WITH {TAGS} SELECT review_id, array_to_string({HITS}, ',') AS keywords, {ASPECT_JOIN} AS aspects FROM reviews r", R)
def aspect_tag_large_lexicon(spark, d):
    rows = A.aspect_tag(reviews(spark, d), "review", LARGE_LEXICON)
    return rows.select(
        "review_id", F.array_join("keywords", ",").alias("keywords"), F.array_join("aspects", ",").alias("aspects")
    )


# Raw text or prepared text: here the prepared text is the lower-cased text backwards.
EITHER = f"list_filter({sql_list(WORDS)}, lambda k: contains(lower(review), k) OR contains(reverse(lower(review)), k))"


@query("aspect_tag_prepared", f"SELECT review_id, array_to_string({EITHER}, ',') AS keywords FROM reviews", R)
def aspect_tag_prepared(spark, d):
    rows = reviews(spark, d).withColumn("prepared", F.reverse(F.lower("review")))
    return A.aspect_tag(rows, "review", LEXICON, "prepared").select("review_id", F.array_join("keywords", ",").alias("keywords"))


@query("rank_products_giant_request", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 101 DESC, doc_id) AS rank FROM documents WHERE lang IS NOT NULL")
def rank_products_giant_request(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").filter("lang is not null").select("doc_id", "lang", (F.col("n_chars") % 101).alias("score"))
    return P.rank_products(rows, "lang", "doc_id", "score", giant=True).select("doc_id", "rank")


@query("keywords_array", f"SELECT review_id, len({HITS}) AS n_keywords, array_to_string({HITS}, '|') AS keywords FROM reviews", R)
def keywords_array(spark, d):
    rows = tagged(spark, d)
    return rows.select("review_id", F.size("keywords").cast("bigint").alias("n_keywords"), F.array_join("keywords", "|").alias("keywords"))


@query("sentiment_pct", f"SELECT product, count(*) AS total_reviews, count(CASE WHEN sentiment = 'positif' THEN 1 END) AS positive_count, count(CASE WHEN sentiment <> 'positif' THEN 1 END) AS negative_count, round({PCT}, 6) AS general_score FROM reviews GROUP BY product", R)
def sentiment_pct(spark, d):
    return A.sentiment_pct(reviews(spark, d), ["product"]).withColumn("general_score", F.round("general_score", 6))


@query("aspect_stats", f"WITH {STATS} SELECT product, aspect, CAST(aspect_order AS INT) AS aspect_order, total, positive FROM stats", R)
def aspect_stats(spark, d):
    return stats(spark, d)


@query("aspect_scores", f"WITH {STATS} SELECT product, aspect, score FROM scores", R)
def aspect_scores(spark, d):
    return scores(spark, d).select("product", "aspect", "score")


@query("aspect_scores_map", f"WITH {STATS} SELECT product, aspect, score FROM scores", R)
def aspect_scores_map(spark, d):
    maps = A.aspect_scores_map(scores(spark, d), ["product"])
    return maps.select("product", F.explode("aspect_scores").alias("aspect", "score"))


@query("valid_aspects", f"WITH {STATS} SELECT product, aspect, total, score FROM scores WHERE total > 0", R)
def valid_aspects(spark, d):
    return A.valid_aspects(scores(spark, d)).select("product", "aspect", "total", "score")


@query("best_worst_aspect", f"WITH {STATS}, {BEST} SELECT product, best_aspect, best_score, worst_aspect, worst_score FROM best JOIN worst USING (product)", R)
def best_worst_aspect(spark, d):
    return A.best_worst_aspect(scores(spark, d), ["product"])


@query("verdict_summary", f"WITH {STATS}, {BEST} SELECT product, {SUMMARY} AS description FROM products LEFT JOIN best USING (product) LEFT JOIN worst USING (product)", R)
def verdict_summary(spark, d):
    picked = A.best_worst_aspect(scores(spark, d), ["product"])
    products = reviews(spark, d).select("product").distinct()
    text = A.verdict_summary(F.col("best_aspect"), F.col("worst_aspect"), F.col("worst_score"))
    return products.join(picked, "product", "left").select("product", text.alias("description"))


@query("verdict_label", f"SELECT product, {VERDICT.format(PCT)} AS verdict FROM reviews GROUP BY product", R)
def verdict_label(spark, d):
    from reviewloom.functions.labels import verdict_label as label

    return A.sentiment_pct(reviews(spark, d), ["product"]).select("product", label("general_score").alias("verdict"))


@query(
    "review_scoring",
    f"SELECT review_id, CASE WHEN sentiment = 'positif' THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment, 1.0::DOUBLE AS confidence, array_to_string({HITS}, '|') AS keywords FROM reviews",
    R,
)
def review_scoring(spark, d):
    rows = P.review_scoring(reviews(spark, d), lexicon=LEXICON)
    return rows.select("review_id", F.col("stored_sentiment").alias("sentiment"), "confidence", F.array_join("keywords", "|").alias("keywords"))


METRICS = f"""{STATS}, {BEST}, general AS (SELECT product, {PCT} AS pct FROM reviews GROUP BY product)
SELECT 'run-1' AS analysis_id, 'baseline' AS model_name, product, round(pct, 6) AS general_sentiment, round(pct, 6) AS compatibility_score,
  {VERDICT.format('pct')} AS verdict, {SUMMARY} AS top_keywords FROM general LEFT JOIN best USING (product) LEFT JOIN worst USING (product)"""


def metric_rows(spark, d):
    results = P.score_products(reviews(spark, d), ["product"], lexicon=LEXICON)
    return P.product_metrics(results, "run-1", "baseline")


def shown_metrics(df):
    return df.select(
        "analysis_id", "model_name", "product", F.round("general_sentiment", 6).alias("general_sentiment"),
        F.round("compatibility_score", 6).alias("compatibility_score"), "verdict", F.array_join("top_keywords", "|").alias("top_keywords"),
    )


@query("product_metrics", f"WITH {METRICS}", R)
def product_metrics(spark, d):
    return shown_metrics(metric_rows(spark, d))


@query("append_metrics", f"WITH {METRICS}", R)
def append_metrics(spark, d):
    from reviewloom.session import scratch_path
    from reviewloom.sources.tables import append_metrics as append

    path = scratch_path(spark, "metrics")
    rows = metric_rows(spark, d)
    append(rows, path)
    append(rows, path)  # a retry of the same run adds nothing
    return shown_metrics(spark.read.parquet(path).select(*rows.columns))


@query(
    "record_analyses",
    f"""WITH {STATS}, {BEST}, general AS (SELECT product, {PCT} AS pct FROM reviews GROUP BY product),
    runs AS (SELECT 'run-1' AS analysis_id, 'a@example.com' AS user_email UNION ALL SELECT 'run-2', 'b@example.com')
    SELECT analysis_id, user_email, product, round(pct, 6) AS general_sentiment, {VERDICT.format('pct')} AS verdict FROM general, runs""",
    R,
)
def record_analyses(spark, d):
    """Two runs, one of them stored twice, and one that broke off before its analysis row."""
    from reviewloom.session import scratch_path
    from reviewloom.sources import tables

    path = scratch_path(spark, "analyses")
    rows = metric_rows(spark, d)
    for run, user in (("run-1", "a@example.com"), ("run-2", "b@example.com"), ("run-1", "a@example.com")):
        tables.record_analysis(rows, path, run, user)
    tables.append_metrics(rows.withColumn("analysis_id", F.lit("broken")), f"{path}/{tables.METRICS}")
    kept = tables.stored_metrics(spark, path)
    return kept.select("analysis_id", "user_email", "product", F.round("general_sentiment", 6).alias("general_sentiment"), "verdict")


CR = ("candidates", "reviews")
PER_REQUEST = f"SELECT lang AS request_id, product AS url, count(*) AS total_reviews, count(CASE WHEN sentiment = 'positif' THEN 1 END) AS positive_count, {PCT} AS pct FROM reviews GROUP BY ALL"
RANK_SQL = f"""general AS ({PER_REQUEST}),
ranked AS (SELECT c.*, g.total_reviews, g.positive_count, g.pct, row_number() OVER (PARTITION BY c.request_id ORDER BY round(pct, 9) DESC, candidate_order) AS rank FROM candidates c JOIN general g USING (request_id, url))"""


def request_reviews(spark, d):
    return reviews(spark, d).withColumnRenamed("lang", "request_id").withColumnRenamed("product", "url")


@query("rank_products", f"WITH {RANK_SQL} SELECT request_id, url, candidate_order, round(pct, 6) AS general_score, rank FROM ranked", CR)
def rank_products(spark, d):
    general = A.sentiment_pct(request_reviews(spark, d), ["request_id", "url"])
    listed = view(spark, d, "candidates").join(general, ["request_id", "url"])
    ranked = P.rank_products(listed, "request_id", "candidate_order")
    return ranked.select("request_id", "url", "candidate_order", F.round("general_score", 6).alias("general_score"), "rank")


@query(
    "drop_empty_candidates",
    "SELECT c.request_id, c.candidate_order, c.url FROM candidates c WHERE EXISTS (SELECT 1 FROM reviews r WHERE r.lang = c.request_id AND r.product = c.url AND r.sentiment = 'netral')",
    CR,
)
def drop_empty_candidates_query(spark, d):
    some = request_reviews(spark, d).filter(F.col("sentiment") == "netral")
    kept = drop_empty_candidates(view(spark, d, "candidates"), some, ["request_id", "url"])
    return kept.select("request_id", "candidate_order", "url")


RECOMMEND = f"""WITH {RANK_SQL}, {TAGS},
stats AS (SELECT r.request_id, r.url, n.aspect, n.aspect_order, count(t.review_id) AS total, count(CASE WHEN t.sentiment = 'positif' THEN 1 END) AS positive
  FROM ranked r CROSS JOIN names n LEFT JOIN tags t ON t.product = r.url AND t.lang = r.request_id AND t.aspect = n.aspect GROUP BY ALL),
scores AS (SELECT *, CASE WHEN total > 0 THEN round_even(positive / total * 100, 1) ELSE 0.0::DOUBLE END AS score FROM stats),
seen AS (SELECT * FROM scores WHERE total > 0),
best AS (SELECT request_id, url, aspect AS best_aspect FROM (SELECT *, row_number() OVER (PARTITION BY request_id, url ORDER BY score DESC, aspect_order) AS r FROM seen) WHERE r = 1),
worst AS (SELECT request_id, url, aspect AS worst_aspect, score AS worst_score FROM (SELECT *, row_number() OVER (PARTITION BY request_id, url ORDER BY score, aspect_order) AS r FROM seen) WHERE r = 1),
maps AS (SELECT request_id, url, string_agg(concat(aspect, '=', CAST(CAST(score * 10 AS BIGINT) AS VARCHAR)), ',' ORDER BY aspect_order) AS aspect_scores FROM scores GROUP BY ALL)
SELECT r.request_id, r.candidate_order, r.name, r.url, round(r.pct, 6) AS general_score, m.aspect_scores, r.total_reviews, r.positive_count,
  r.total_reviews - r.positive_count AS negative_count, {VERDICT.format('r.pct')} AS verdict, {SUMMARY} AS description, r.rank, w.name AS winning_product
FROM ranked r JOIN maps m USING (request_id, url) LEFT JOIN best USING (request_id, url) LEFT JOIN worst USING (request_id, url)
JOIN (SELECT request_id, name FROM ranked WHERE rank = 1) w ON w.request_id = r.request_id"""


def recommended(spark, d):
    return P.recommend(request_reviews(spark, d), view(spark, d, "candidates"), LEXICON)


@query("recommend", RECOMMEND, CR)
def recommend(spark, d):
    entries = F.transform(
        F.map_entries("aspect_scores"),
        lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10).cast("bigint").cast("string")),
    )
    return recommended(spark, d).select(
        "request_id", "candidate_order", "name", "url", F.round("general_score", 6).alias("general_score"),
        F.array_join(entries, ",").alias("aspect_scores"), "total_reviews", "positive_count", "negative_count",
        "verdict", "description", "rank", "winning_product",
    )


@query(
    "recommend_responses",
    f"""WITH {RANK_SQL} SELECT request_id, 'ASPECT_BASED' AS analysis_type, max(CASE WHEN rank = 1 THEN name END) AS winning_product,
        string_agg(name, '|' ORDER BY candidate_order) AS products, count(*) AS n_details FROM ranked GROUP BY request_id""",
    CR,
)
def recommend_responses(spark, d):
    return P.responses(recommended(spark, d)).select(
        "request_id", "analysis_type", "winning_product", F.array_join("details.name", "|").alias("products"),
        F.size("details").cast("bigint").alias("n_details"),
    )


# --- evaluation -------------------------------------------------------------------------------
PR = ("predictions",)
CONF = """labs AS (SELECT DISTINCT unnest([actual, {p}]) AS label FROM predictions),
conf AS (SELECT a.label AS actual, b.label AS predicted, (SELECT count(*) FROM predictions x WHERE x.actual = a.label AND x.{p} = b.label) AS n FROM labs a, labs b)"""
REPORT = """per AS (SELECT l.label, (SELECT sum(n) FROM conf WHERE actual = l.label) AS support, (SELECT sum(n) FROM conf WHERE predicted = l.label) AS guessed,
  (SELECT sum(n) FROM conf WHERE actual = l.label AND predicted = l.label) AS tp FROM labs l),
m AS (SELECT label, CAST(support AS DOUBLE) AS support, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN guessed + support > 0 THEN 2.0 * tp / (guessed + support) ELSE 0 END AS f1, tp FROM per),
rep AS (SELECT label, 'precision' AS metric, precision AS value FROM m UNION ALL SELECT label, 'recall', recall FROM m UNION ALL SELECT label, 'f1', f1 FROM m
  UNION ALL SELECT label, 'support', support FROM m UNION ALL SELECT 'accuracy', 'accuracy', sum(tp) / sum(support) FROM m
  UNION ALL SELECT 'macro avg', 'precision', avg(precision) FROM m UNION ALL SELECT 'macro avg', 'recall', avg(recall) FROM m
  UNION ALL SELECT 'macro avg', 'f1', avg(f1) FROM m UNION ALL SELECT 'macro avg', 'support', sum(support) FROM m
  UNION ALL SELECT 'weighted avg', 'precision', sum(precision * support) / sum(support) FROM m
  UNION ALL SELECT 'weighted avg', 'recall', sum(recall * support) / sum(support) FROM m
  UNION ALL SELECT 'weighted avg', 'f1', sum(f1 * support) / sum(support) FROM m UNION ALL SELECT 'weighted avg', 'support', sum(support) FROM m)"""
RULES = ["by_length", "by_hash", "by_lang"]


def predictions(spark, d):
    return view(spark, d, "predictions")


def report(spark, d, rule):
    return E.classification_report(E.confusion_matrix(predictions(spark, d), "actual", rule))


@query("confusion_matrix", f"WITH {CONF.format(p='by_length')} SELECT actual, predicted, n FROM conf", PR)
def confusion_matrix(spark, d):
    return E.confusion_matrix(predictions(spark, d), "actual", "by_length")


@query("classification_report", f"WITH {CONF.format(p='by_length')}, {REPORT} SELECT label, metric, CAST(round(value, 6) AS DOUBLE) AS value FROM rep", PR)
def classification_report(spark, d):
    return report(spark, d, "by_length").withColumn("value", F.round("value", 6))


def scenario_sql(rule: str) -> str:
    pick = "(SELECT CAST(round(value, 6) AS DOUBLE) FROM rep WHERE label = '{}' AND metric = '{}')"
    cols = [pick.format("accuracy", "accuracy") + " AS accuracy", pick.format("macro avg", "f1") + " AS macro_f1"]
    cols += [pick.format(c, m) + f" AS {m}_{c}" for c in ("negatif", "netral") for m in ("f1", "recall")]
    return f"(WITH {CONF.format(p=rule)}, {REPORT} SELECT '{rule}' AS scenario, {', '.join(cols)})"


@query("compare_scenarios", "SELECT * FROM (" + " UNION ALL ".join(scenario_sql(r) for r in RULES) + ")", PR)
def compare_scenarios(spark, d):
    wide = E.compare_scenarios({rule: report(spark, d, rule) for rule in RULES}, ["negatif", "netral"])
    return wide.select("scenario", *[F.round(c, 6).alias(c) for c in wide.columns[1:]])


def registry(spark, d):
    named = predictions(spark, d).withColumn("model_name", F.col("lang"))
    confusion = E.confusion_matrix(named, "actual", "by_hash", by=["model_name"])
    return E.model_registry(E.classification_report(confusion, ["model_name"]), "negatif", "netral")


REGISTRY = """labs AS (SELECT DISTINCT unnest([actual, by_hash]) AS label FROM predictions),
models AS (SELECT DISTINCT lang FROM predictions),
per AS (SELECT m.lang, l.label, count(CASE WHEN p.actual = l.label THEN 1 END) AS support, count(CASE WHEN p.by_hash = l.label THEN 1 END) AS guessed,
  count(CASE WHEN p.actual = l.label AND p.by_hash = l.label THEN 1 END) AS tp FROM models m CROSS JOIN labs l LEFT JOIN predictions p ON p.lang = m.lang GROUP BY ALL),
f AS (SELECT *, CASE WHEN guessed + support > 0 THEN 2.0::DOUBLE * tp / (guessed + support) ELSE 0 END AS f1 FROM per),
registry AS (SELECT lang AS model_name, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, max(CASE WHEN label = 'negatif' THEN f1 END) AS f1_negative,
  max(CASE WHEN label = 'netral' THEN f1 END) AS f1_neutral, true AS is_active FROM f GROUP BY lang)"""


@query(
    "model_registry",
    f"WITH {REGISTRY} SELECT model_name, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(f1_negative, 6) AS f1_negative, round(f1_neutral, 6) AS f1_neutral, is_active FROM registry",
    PR,
)
def model_registry(spark, d):
    rows = registry(spark, d)
    return rows.select("model_name", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "f1_negative", "f1_neutral")], "is_active")


@query(
    "model_registry_versions",
    f"""WITH {REGISTRY}, v AS (SELECT 1 AS version, * FROM registry UNION ALL SELECT 2, * FROM registry WHERE accuracy > 0.5)
    SELECT version, model_name, round(accuracy, 6) AS accuracy, version = max(version) OVER (PARTITION BY model_name) AS is_active FROM v""",
    PR,
)
def model_registry_versions(spark, d):
    """Two committed versions, the second with fewer models and stored twice; a third that was never committed."""
    from reviewloom.session import cut_lineage, scratch_path
    from reviewloom.sources import tables

    path, rows = scratch_path(spark, "registry"), cut_lineage(registry(spark, d))
    better = rows.filter(F.col("accuracy") > 0.5)
    for version, part in ((1, rows), (2, better), (2, better)):
        tables.register_models(part, path, version)
    rows.drop("is_active").withColumn("version", F.lit(3)).write.mode("append").partitionBy("version").parquet(f"{path}/{tables.MODELS}")
    return tables.registered_models(spark, path).select("version", "model_name", F.round("accuracy", 6).alias("accuracy"), "is_active")


@query(
    "lookup_model_by_name",
    f"WITH {REGISTRY} SELECT review_id, lang AS model_name FROM reviews WHERE lang IN (SELECT model_name FROM registry WHERE accuracy > 0.5)",
    ("predictions", "reviews"),
)
def lookup_model_by_name(spark, d):
    from reviewloom.operators.store import lookup_model_by_name as lookup

    requests = reviews(spark, d).select("review_id", F.col("lang").alias("model_name"))
    return lookup(requests, registry(spark, d).filter(F.col("accuracy") > 0.5)).select("review_id", "model_name")
