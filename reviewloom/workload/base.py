"""Registry of the queries, and the views they read. Each view is the same query in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewloom.constants import ASPECT_KEYWORDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Test values: the given texts are not Indonesian, so words that occur in them join the lexicon. The
# last aspect has no hits.
EXTRA_KEYWORDS = {
    "performa": ["with", "this"],
    "layar": ["und", "die"],
    "baterai": ["que", "des"],
    "harga": ["los", "por", "una"],
    "garansi": ["price"],
}
LEXICON = {a: [*ASPECT_KEYWORDS.get(a, []), *words] for a, words in EXTRA_KEYWORDS.items()}
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "la", "el", "de", "que", "los", "und", "die", "der", "le", "les", "des"]
MARKERS = ["the ", "que ", "und ", " de "]

# Views as SQL that both engines run unchanged.
REVIEWS = """
SELECT doc_id AS review_id, source AS product, lang, text AS review,
       concat('user', CAST(n_chars % 97 AS VARCHAR(8))) AS username,
       CASE n_chars % 10 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4' ELSE '5' END AS rating,
       concat(CAST(n_chars % 30 AS VARCHAR(8)), ' hari lalu') AS review_date,
       CASE n_chars % 10 WHEN 0 THEN 'negatif' WHEN 1 THEN 'negatif' WHEN 2 THEN 'netral' ELSE 'positif' END AS sentiment
FROM documents"""
CHATS = """
SELECT conv_id * 1000 + turn AS review_id, role AS product, text AS review,
       concat('user', CAST(conv_id % 97 AS VARCHAR(8))) AS username,
       CAST(1 + length(text) % 5 AS VARCHAR(8)) AS rating,
       concat(CAST(turn % 30 AS VARCHAR(8)), ' hari lalu') AS review_date
FROM conversations"""
CANDIDATES = """
SELECT DISTINCT lang AS request_id, CAST(substr(source, 4) AS INT) AS candidate_order,
       concat('Brand', substr(source, 4), ' Laptop ', source) AS name, source AS url
FROM documents"""
PART_NAMES = """
SELECT p_partkey,
       CASE p_size % 5
            WHEN 0 THEN concat('【', p_type, '】 ', p_brand, ' ', p_name)
            WHEN 1 THEN concat('【', p_type, ' ', p_brand, '】', p_name)
            WHEN 2 THEN concat('  ', p_brand, ' ', p_name, '【', p_type, '】')
            WHEN 3 THEN concat(p_brand, ' ', p_name)
            ELSE '   ' END AS name,
       concat('https://shop.example.com/', p_brand, '/', CAST(p_size AS VARCHAR(8)), '/', p_name) AS url,
       p_size
FROM part"""
PREDICTIONS = """
SELECT d.doc_id,
       CASE WHEN l.toxic = 1 THEN 'negatif' WHEN l.quality = 1 THEN 'positif' ELSE 'netral' END AS actual,
       CASE WHEN d.n_chars < 150 THEN 'netral' WHEN d.text LIKE '%http%' THEN 'negatif' ELSE 'positif' END AS by_length,
       CASE WHEN d.n_chars % 11 = 0 THEN 'negatif' WHEN d.n_chars % 5 = 0 THEN 'netral' ELSE 'positif' END AS by_hash,
       CASE WHEN d.lang <> 'en' THEN 'netral' ELSE 'positif' END AS by_lang,
       d.lang
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
VIEWS = {
    "reviews": REVIEWS,
    "chats": CHATS,
    "candidates": CANDIDATES,
    "part_names": PART_NAMES,
    "predictions": PREDICTIONS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS over the parquet tables."""
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in sql.replace("\n", " ")}
    named = sql
    for t in used:
        named = named.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(named, **used)


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL with the named views in front."""
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if not heads:
        return sql
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register a query, and its DuckDB equivalent where there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views)
        return fn

    return register


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
