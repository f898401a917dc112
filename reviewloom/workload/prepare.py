"""Queries: profiling, de-duplication, merging, balancing and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.operators import dedup as D
from reviewloom.operators import merge as M
from reviewloom.operators import profile as P
from reviewloom.operators import sampling as S
from reviewloom.operators.smote import smote, smote_report
from reviewloom.session import cut_lineage
from reviewloom.workload.base import query, table, view
from reviewloom.workload.text import sql_clean
from reviewloom.functions.text import clean_text

R = ("reviews",)
RC = ("reviews", "chats")


def reviews(spark, d):
    return view(spark, d, "reviews")


def chats(spark, d):
    return view(spark, d, "chats")


# --- filters and profiling --------------------------------------------------------------------
@query("drop_null_text", f"SELECT review_id, cleaned FROM (SELECT review_id, {sql_clean('review')} AS cleaned FROM chats) WHERE cleaned <> ''", ("chats",))
def drop_null_text(spark, d):
    rows = chats(spark, d).select("review_id", F.nullif(clean_text("review"), F.lit("")).alias("cleaned"))
    return rows.na.drop(subset=["cleaned"])


@query("filter_class", "SELECT review_id, sentiment FROM reviews WHERE sentiment = 'netral'", R)
def filter_class(spark, d):
    return reviews(spark, d).filter(F.col("sentiment") == "netral").select("review_id", "sentiment")


@query("value_counts", "SELECT sentiment, count(*) AS n FROM reviews WHERE sentiment IS NOT NULL GROUP BY sentiment", R)
def value_counts(spark, d):
    return P.value_counts(reviews(spark, d), "sentiment")


@query("rating_distribution", "SELECT rating, count(*) AS n FROM reviews WHERE rating IS NOT NULL GROUP BY rating", R)
def rating_distribution(spark, d):
    return P.rating_distribution(reviews(spark, d), "rating")


@query("class_proportions", "SELECT sentiment, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM reviews), 6) AS pct FROM reviews GROUP BY sentiment", R)
def class_proportions(spark, d):
    return P.class_proportions(reviews(spark, d), "sentiment").withColumn("pct", F.round("pct", 6))


@query("class_balance_check", "SELECT count(*) AS classes, min(n) AS smallest, max(n) AS largest, min(n) = max(n) AS balanced FROM (SELECT count(*) AS n FROM reviews GROUP BY sentiment)", R)
def class_balance_check(spark, d):
    return P.class_balance_check(reviews(spark, d), "sentiment")


@query(
    "dataset_overview",
    """SELECT 'reviews' AS dataset, count(*) AS n_rows, 8 AS n_columns, 'review_id,product,lang,review,username,rating,review_date,sentiment' AS columns FROM reviews
       UNION ALL SELECT 'chats', count(*), 6, 'review_id,product,review,username,rating,review_date' FROM chats""",
    RC,
)
def dataset_overview(spark, d):
    return P.dataset_overview({"reviews": reviews(spark, d), "chats": chats(spark, d)})


# --- de-duplication ---------------------------------------------------------------------------
@query("dedup_exact", "SELECT DISTINCT product, username, rating, review FROM reviews", R)
def dedup_exact(spark, d):
    return D.dedup_exact(reviews(spark, d).select("product", "username", "rating", "review"))


def first_sql(keys: str) -> str:
    return f"SELECT review_id, product, username, rating, md5(review) AS review_md5 FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY review_id) AS rn FROM {{src}}) WHERE rn = 1"


def shown(df):
    return df.select("review_id", "product", "username", "rating", F.md5("review").alias("review_md5"))


@query("dedup_review_user", first_sql("review, username").format(src="reviews"), R)
def dedup_review_user(spark, d):
    return shown(D.dedup(reviews(spark, d), ["review", "username"], ["review_id"]))


@query("dedup_user_clean_date", first_sql("username, cleaned, review_date").format(src=f"(SELECT *, {sql_clean('review')} AS cleaned FROM reviews)"), R)
def dedup_user_clean_date(spark, d):
    rows = reviews(spark, d).withColumn("cleaned", clean_text("review"))
    return shown(D.dedup(rows, ["username", "cleaned", "review_date"], ["review_id"]))


@query("dedup_record", "SELECT DISTINCT product, username, review, rating, review_date FROM chats", ("chats",))
def dedup_record(spark, d):
    return chats(spark, d).select("product", "username", "review", "rating", "review_date").dropDuplicates()


@query("duplicate_count", "SELECT count(*) - count(DISTINCT (review, username)) AS duplicates FROM reviews", R)
def duplicate_count(spark, d):
    return D.duplicate_count(reviews(spark, d), ["review", "username"])


# --- union and merge --------------------------------------------------------------------------
COMMON = "review_id, product, review, username, rating, review_date"
COMMON_COLS = COMMON.split(", ")
BENCH_SQL = "SELECT item_id AS review_id, 'bench' AS product, text AS review, 'curator' AS username, '5' AS rating, 'Unknown' AS review_date FROM benchmark"


def bench_rows(spark, d):
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("review_id"),
        F.lit("bench").alias("product"),
        F.col("text").alias("review"),
        F.lit("curator").alias("username"),
        F.lit("5").alias("rating"),
        F.lit("Unknown").alias("review_date"),
    )


@query("union_datasets", f"SELECT {COMMON} FROM reviews UNION ALL SELECT {COMMON} FROM chats UNION ALL {BENCH_SQL}", RC)
def union_datasets(spark, d):
    return M.union_datasets(reviews(spark, d).select(COMMON_COLS), chats(spark, d).select(COMMON_COLS), bench_rows(spark, d))


# The stored rows are the English reviews; the new ones are all reviews and all chats.
OLD_NEW = f"""rows_all AS (SELECT 0 AS is_new, {COMMON} FROM reviews WHERE lang = 'en'
  UNION ALL SELECT 1, {COMMON} FROM reviews UNION ALL SELECT 1, {COMMON} FROM chats)"""
MERGE_KEYS = ["username", "review", "review_date"]


def old_and_new(spark, d):
    every = reviews(spark, d)
    old = every.filter(F.col("lang") == "en").select(COMMON_COLS)
    new = M.union_datasets(every.select(COMMON_COLS), chats(spark, d).select(COMMON_COLS))
    return old, new


@query(
    "merge_append_dedup",
    f"""WITH {OLD_NEW} SELECT review_id, product, username, rating, md5(review) AS review_md5 FROM
        (SELECT *, row_number() OVER (PARTITION BY username, review, review_date ORDER BY is_new, review_id) AS rn FROM rows_all) WHERE rn = 1""",
    RC,
)
def merge_append_dedup(spark, d):
    old, new = old_and_new(spark, d)
    return shown(M.merge_append_dedup(old, new, MERGE_KEYS, ["review_id"]))


@query(
    "merge_stats",
    f"""WITH {OLD_NEW} SELECT CAST(sum(1 - is_new) AS BIGINT) AS old_rows, CAST(sum(is_new) AS BIGINT) AS new_rows,
        count(*) - count(DISTINCT (username, review, review_date)) AS duplicates_removed FROM rows_all""",
    RC,
)
def merge_stats(spark, d):
    old, new = old_and_new(spark, d)
    return M.merge_stats(old, new, MERGE_KEYS)


# --- balancing and splitting ------------------------------------------------------------------
HASHED = "hashed AS (SELECT *, md5(concat('42|', CAST(review_id AS VARCHAR))) AS h FROM reviews)"
RANKED = f"{HASHED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY sentiment ORDER BY h, review_id) - 1 AS r FROM hashed)"


@query("exact_rank_by_hash", f"WITH {RANKED} SELECT review_id, sentiment, r AS rank FROM ranked", R)
def exact_rank_by_hash(spark, d):
    from reviewloom.operators.ranking import exact_rank_by_hash as rank

    return rank(reviews(spark, d).select("review_id", "sentiment"), "sentiment", "review_id")


@query(
    "undersample_majority",
    f"WITH {RANKED} SELECT review_id, sentiment FROM ranked WHERE sentiment <> 'positif' OR r < (SELECT count(*) FROM reviews WHERE sentiment <> 'positif')",
    R,
)
def undersample_majority(spark, d):
    return S.undersample_majority(reviews(spark, d).select("review_id", "sentiment"), "sentiment", "positif", "review_id")


@query("shuffle_rows", f"WITH {HASHED} SELECT review_id, h AS order_key FROM hashed", R)
def shuffle_rows(spark, d):
    return S.shuffle_rows(reviews(spark, d).select("review_id"), "review_id")


# De-duplicated on the text columns (first row stays), then split 80/20 per class.
SPLIT_SQL = """uniq AS (SELECT review_id, review, sentiment FROM (SELECT *, row_number() OVER (PARTITION BY username, review ORDER BY review_id) AS rn FROM reviews) WHERE rn = 1),
sizes AS (SELECT sentiment, count(*) AS n FROM uniq GROUP BY sentiment),
total AS (SELECT CAST(ceil(round(sum(n) * 0.2::DOUBLE, 6)) AS BIGINT) AS t, CAST(sum(n) AS BIGINT) AS every FROM sizes),
exact AS (SELECT sentiment, n * t / every::DOUBLE AS e, CAST(floor(n * t / every::DOUBLE) AS BIGINT) AS f, t FROM sizes, total),
quota AS (SELECT sentiment, f + CASE WHEN row_number() OVER (ORDER BY round(e - f, 9) DESC, sentiment) <= t - sum(f) OVER () THEN 1 ELSE 0 END AS q FROM exact),
placed AS (SELECT u.*, row_number() OVER (PARTITION BY u.sentiment ORDER BY md5(concat('42|', CAST(review_id AS VARCHAR))), review_id) AS r FROM uniq u),
split AS (SELECT p.review_id, p.review, p.sentiment, CASE WHEN p.r <= q THEN 'test' ELSE 'train' END AS split FROM placed p JOIN quota USING (sentiment))"""


def split_rows(spark, d, *cols):
    """The de-duplicated reviews, tagged train or test."""
    rows = reviews(spark, d)
    uniq = D.dedup(rows.select("review_id", "username", "review", "sentiment"), ["username", "review"], ["review_id"])
    uniq = cut_lineage(uniq.select("review_id", "sentiment", *cols))  # read for counts, for cuts and for placing
    return S.stratified_split(uniq, "sentiment", "review_id")


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT review_id, sentiment, split FROM split", R)
def stratified_split(spark, d):
    return split_rows(spark, d)


@query("split_report", f"WITH {SPLIT_SQL} SELECT split, sentiment, count(*) AS n FROM split GROUP BY split, sentiment", R)
def split_report(spark, d):
    return S.split_report(split_rows(spark, d), "sentiment")


@query(
    "stratified_kfold",
    f"""WITH {RANKED}, sizes AS (SELECT sentiment, count(*) AS n FROM reviews GROUP BY sentiment),
        froms AS (SELECT sentiment, n, sum(n) OVER (ORDER BY sentiment) - n AS s FROM sizes),
        folds AS (SELECT sentiment, unnest(range(3)) AS i, s, n FROM froms),
        cnt AS (SELECT sentiment, i, floor((s + n + 2 - i) / 3) - floor((s + 2 - i) / 3) AS c FROM folds),
        cum AS (SELECT sentiment, i, sum(c) OVER (PARTITION BY sentiment ORDER BY i) AS upto, c FROM cnt)
        SELECT r.review_id, r.sentiment, CAST(c.i AS INT) AS fold FROM ranked r JOIN cum c ON r.sentiment = c.sentiment AND r.r < c.upto AND r.r >= c.upto - c.c""",
    R,
)
def stratified_kfold(spark, d):
    return S.stratified_kfold(reviews(spark, d).select("review_id", "sentiment"), "sentiment", "review_id")


# --- neighbours and oversampling --------------------------------------------------------------
KNN_SQL = """vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT a.label, a.vec_id, b.vec_id AS nn_id, round(list_distance(a.v, b.v), 9) AS d FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id <> b.vec_id),
knn AS (SELECT label, vec_id, nn_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, nn_id) AS nn_rank FROM near QUALIFY nn_rank <= 5)"""


@query("knn_same_class", f"WITH {KNN_SQL} SELECT label, vec_id, CAST(nn_rank AS INT) AS nn_rank, nn_id, round(d, 6) AS distance FROM knn")
def knn_same_class(spark, d):
    from reviewloom.operators.neighbors import blocked_knn

    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return blocked_knn(rows, "label", "vec_id", "v").withColumn("distance", F.round("distance", 6))


HASH32 = "('0x' || substr(md5({}), 1, 8))::BIGINT"
SMOTE_SQL = f"""{KNN_SQL},
sizes AS (SELECT label, count(*) AS n, max(count(*)) OVER () - count(*) AS deficit FROM vecs GROUP BY label),
placed AS (SELECT v.*, n, deficit, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', CAST(vec_id AS VARCHAR))), vec_id) - 1 AS r FROM vecs v JOIN sizes USING (label)),
bases AS (SELECT *, deficit // n + CASE WHEN r < deficit % n THEN 1 ELSE 0 END AS copies FROM placed),
drawn AS (SELECT vec_id, label, v, n, unnest(range(copies)) AS j FROM bases WHERE copies > 0),
picked AS (SELECT *, {HASH32.format("concat('42|', CAST(vec_id AS VARCHAR), '|', CAST(j AS VARCHAR), '|nn')")} % least(5, n - 1) + 1 AS pick,
  {HASH32.format("concat('42|', CAST(vec_id AS VARCHAR), '|', CAST(j AS VARCHAR), '|u')")} / 4294967296.0::DOUBLE AS u FROM drawn),
fresh AS (SELECT concat(CAST(p.vec_id AS VARCHAR), '#', CAST(j AS VARCHAR)) AS row_id, p.label, p.v AS x, o.v AS y, u FROM picked p
  JOIN knn k ON p.vec_id = k.vec_id AND p.pick = k.nn_rank JOIN vecs o ON k.nn_id = o.vec_id),
long AS (SELECT row_id, label, true AS synthetic, unnest(range(len(x))) AS i, unnest(x) AS a, unnest(y) AS b, u FROM fresh
  UNION ALL SELECT CAST(vec_id AS VARCHAR), label, false, unnest(range(len(v))), unnest(v), unnest(v), 0.0 FROM vecs)"""


def smote_rows(spark, d):
    return smote(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("smote", f"WITH {SMOTE_SQL} SELECT row_id, label, synthetic, CAST(i AS INT) AS i, round(a + u * (b - a), 6) AS value FROM long")
def smote_query(spark, d):
    long = smote_rows(spark, d).select("row_id", "label", "synthetic", F.posexplode("embedding").alias("i", "value"))
    return long.withColumn("value", F.round("value", 6))


@query(
    "smote_report",
    """WITH sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
       SELECT 'before' AS stage, label, n FROM sizes UNION ALL SELECT 'after', label, (SELECT max(n) FROM sizes) FROM sizes""",
)
def smote_report_query(spark, d):
    return smote_report(table(spark, d, "embeddings"), smote_rows(spark, d), "label")
