"""Queries: scalar text and label functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.functions import labels as L
from reviewloom.functions import text as X
from reviewloom.operators import encode
from reviewloom.workload.base import STOP_WORDS, query, sql_list, table, view

R = ("reviews",)
# DuckDB counterparts of the text expressions.
SPACES = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), ' ', chr(133), chr(160), chr(5760), chr(8192), chr(8193), chr(8194), chr(8195), chr(8196), chr(8197), chr(8198), chr(8199), chr(8200), chr(8201), chr(8202), chr(8232), chr(8233), chr(8239), chr(8287), chr(12288))"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {SPACES})"


def sql_clean(expr: str) -> str:
    no_punct = rf"regexp_replace({expr}, '[^\p{{L}}\p{{N}}_\t-\r\x1c-\x20\x{{85}}\p{{Z}}]', '', 'g')"
    return sql_strip(rf"lower(regexp_replace({no_punct}, '\p{{Nd}}+', '', 'g'))")


def sql_stop(expr: str, words=STOP_WORDS) -> str:
    return f"array_to_string(list_filter(string_split({expr}, ' '), lambda t: NOT list_contains({sql_list(words)}, t)), ' ')"


def sql_stem(expr: str) -> str:
    """The same published affix rules, written out as one CASE per step."""
    keep = "[a-z0-9-]*[aiueo][a-z0-9-]*[aiueo][a-z0-9-]*"
    base = f"trim(regexp_replace(regexp_replace(lower({expr}), '[^a-z0-9 -]', ' ', 'g'), ' +', ' ', 'g'), ' ')"
    one = f"list_transform(string_split({base}, ' '), lambda t: regexp_replace(regexp_replace(t, '^({keep})(?:kah|lah|pun)$', '\\1'), '^({keep})(?:nya|ku|mu)$', '\\1'))"
    two = (
        f"list_transform({one}, lambda w: struct_pack(w := w, b := CASE "
        f"WHEN regexp_matches(w, '^(?:meny|peny)([aiueo][^aiueo]*[aiueo].*)$') THEN regexp_replace(w, '^(?:meny|peny)([aiueo][^aiueo]*[aiueo].*)$', 's\\1') "
        f"WHEN regexp_matches(w, '^(?:mem|pem)([aiueo][^aiueo]*[aiueo].*)$') THEN regexp_replace(w, '^(?:mem|pem)([aiueo][^aiueo]*[aiueo].*)$', 'p\\1') "
        f"ELSE regexp_replace(w, '^(?:meng|peng|men|pen|mem|pem|me|di|ter|ke)({keep})$', '\\1') END))"
    )
    three = (
        f"list_transform({two}, lambda p: CASE "
        f"WHEN regexp_matches(p.b, '^({keep})kan$') AND NOT regexp_matches(p.w, '^(?:ke|peng)') THEN regexp_replace(p.b, '^({keep})kan$', '\\1') "
        f"WHEN regexp_matches(p.b, '^({keep})an$') AND NOT regexp_matches(p.w, '^(?:di|meng|ter)') THEN regexp_replace(p.b, '^({keep})an$', '\\1') "
        f"WHEN regexp_matches(p.b, '^({keep})i$') AND NOT regexp_matches(p.w, '^(?:ber|ke|peng)') THEN regexp_replace(p.b, '^({keep})i$', '\\1') "
        f"ELSE p.b END)"
    )
    four = f"list_transform({three}, lambda s: regexp_replace(s, '^(?:ber|bel|be|per|pel|pe)({keep})$', '\\1'))"
    return f"array_to_string({four}, ' ')"


@query("clean_text", f"SELECT review_id, {sql_clean('review')} AS cleaned FROM reviews", R)
def clean_text(spark, d):
    return view(spark, d, "reviews").select("review_id", X.clean_text("review").alias("cleaned"))


@query("lower_text", "SELECT review_id, lower(review) AS lowered FROM reviews", R)
def lower_text(spark, d):
    return view(spark, d, "reviews").select("review_id", X.lower_text("review").alias("lowered"))


@query("remove_stopwords", f"SELECT review_id, {sql_stop('lower(review)')} AS kept FROM reviews", R)
def remove_stopwords(spark, d):
    rows = view(spark, d, "reviews")
    return rows.select("review_id", X.remove_stopwords(F.lower("review"), STOP_WORDS).alias("kept"))


@query("stem_text", f"SELECT review_id, {sql_stem('review')} AS stemmed FROM reviews", R)
def stem_text(spark, d):
    return view(spark, d, "reviews").select("review_id", X.stem_text("review").alias("stemmed"))


@query("stem_text_by_table", f"SELECT review_id, {sql_stem('review')} AS stemmed FROM reviews", R)
def stem_text_by_table(spark, d):
    """With a table made by the rules, the table gives what the rules give."""
    from reviewloom.operators.stems import stem_table, stem_with_table, surfaces

    rows = view(spark, d, "reviews").select("review_id", "review")
    table = stem_table(surfaces(rows, "review_id", "review"))
    return stem_with_table(rows, "review_id", "review", table).select("review_id", "stemmed")


@query("preprocess_train", f"SELECT review_id, {sql_stem(sql_stop(sql_clean('review')))} AS prepared FROM reviews", R)
def preprocess_train(spark, d):
    rows = view(spark, d, "reviews")
    return rows.select("review_id", X.preprocess_train(X.clean_text("review"), STOP_WORDS).alias("prepared"))


@query("preprocess_serve", f"SELECT review_id, {sql_stem(sql_stop('lower(review)'))} AS prepared FROM reviews", R)
def preprocess_serve(spark, d):
    return view(spark, d, "reviews").select("review_id", X.preprocess_serve("review", STOP_WORDS).alias("prepared"))


SQL_NAME = sql_strip("regexp_replace(name, '【[^\\n]*?】', '', 'g')")


@query("clean_product_name", f"SELECT p_partkey, {SQL_NAME} AS clean_name FROM part_names", ("part_names",))
def clean_product_name(spark, d):
    return view(spark, d, "part_names").select("p_partkey", X.clean_product_name("name").alias("clean_name"))


SQL_BRAND = (
    f"CASE WHEN {sql_strip('name')} = '' THEN 'Unknown' ELSE "
    + sql_strip(f"regexp_replace(string_split({sql_strip('name')}, ' ')[1], '【[^\\n]*?】', '', 'g')")
    + " END"
)


@query("derive_brand", f"SELECT p_partkey, {SQL_BRAND} AS brand FROM part_names", ("part_names",))
def derive_brand(spark, d):
    return view(spark, d, "part_names").select("p_partkey", X.derive_brand("name").alias("brand"))


@query("normalize_label", f"SELECT c_custkey, {sql_strip('lower(c_mktsegment)')} AS label FROM (SELECT c_custkey, concat('  ', c_mktsegment, chr(10)) AS c_mktsegment FROM customer)")
def normalize_label(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), "c_mktsegment", F.lit("\n")).alias("raw"))
    return rows.select("c_custkey", L.normalize_label("raw").alias("label"))



@query(
    "rating_to_sentiment",
    """WITH raw AS (SELECT l_orderkey, l_linenumber, l_quantity, TRY_CAST(CASE WHEN l_linenumber = 3 THEN 'abc' WHEN l_linenumber = 5 THEN NULL
              ELSE CAST(1 + CAST(l_quantity AS BIGINT) % 9 / 2.0 AS VARCHAR) END AS DOUBLE) AS r FROM lineitem)
       SELECT CASE WHEN r IS NULL THEN NULL WHEN r >= 4 THEN 'positif' WHEN r = 3 THEN 'netral' ELSE 'negatif' END AS sentiment,
              r AS rating, count(*) AS n FROM raw GROUP BY ALL""",
)
def rating_to_sentiment(spark, d):
    half = F.lit(1) + F.col("l_quantity").cast("bigint") % 9 / F.lit(2.0)
    raw = F.when(F.col("l_linenumber") == 3, "abc").when(F.col("l_linenumber") != 5, half.cast("string"))
    rows = table(spark, d, "lineitem").select(raw.alias("raw"))
    labelled = rows.select(L.rating_to_sentiment("raw").alias("sentiment"), F.col("raw").try_cast("double").alias("rating"))
    return labelled.groupBy("sentiment", "rating").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fill_empty_text",
    "SELECT e.event_id, coalesce(l.text, '') AS text FROM events e LEFT JOIN documents l ON e.event_id = l.doc_id * 7",
)
def fill_empty_text(spark, d):
    texts = table(spark, d, "documents").select((F.col("doc_id") * 7).alias("event_id"), "text")
    rows = table(spark, d, "events").select("event_id").join(texts, "event_id", "left")
    return rows.select("event_id", X.fill_empty_text("text").alias("text"))


@query("round_score", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 8 * 5, 1) AS score FROM lineitem")
def round_score(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", L.round_score(F.col("l_quantity") / 8 * 5).alias("score"))


CODES = "codes AS (SELECT sentiment AS label, CAST(dense_rank() OVER (ORDER BY sentiment) - 1 AS INT) AS label_idx FROM (SELECT DISTINCT sentiment FROM reviews))"


@query("label_encode", f"WITH {CODES} SELECT review_id, sentiment, label_idx FROM reviews JOIN codes ON sentiment = label", R)
def label_encode(spark, d):
    rows = view(spark, d, "reviews").select("review_id", "sentiment")
    return encode.label_encode(rows, "sentiment", encode.fit_label_map(rows, "sentiment"))


@query("label_decode", f"WITH {CODES} SELECT review_id, c.label_idx, c.label FROM reviews r JOIN codes c ON r.sentiment = c.label", R)
def label_decode(spark, d):
    rows = view(spark, d, "reviews").select("review_id", "sentiment")
    codes = encode.fit_label_map(rows, "sentiment")
    coded = encode.label_encode(rows, "sentiment", codes).drop("sentiment")
    return encode.label_decode(coded, "label_idx", codes)
