"""Exact duplicates by deterministic block naming.

Every normalised text is cut into blocks of ``BLOCK`` characters. The distinct blocks are sorted and
get integers as names; then adjacent pairs of names are named in the same way, again and again, until one
name is left of each text. Two texts have the same (level, name) exactly if they are equal: no hash
decides, so nothing can collide.

A name is the place of a key in its sorted partition of the distinct keys. Keys that hold a thousandth of
all rows are at most a thousand; they are named apart and broadcast, so copies never meet in one task.
Each level is written to the shared folder: a lost executor repeats its own tasks only.

Defined results: a null text counts as empty; all empty texts are one group. Of equal texts the row with
the most characters stays, then the smallest id, null ids last. Rows that repeat an id and a text are each
returned, counted, and kept or dropped together. Only ``id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.arrays import unfold
from reviewloom.llm.common import documents, text_or_empty
from reviewloom.operators.skew import join_by_weight
from reviewloom.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
BLOCK = 1024
HOT_SHARE = 1000  # a key with more than 1/HOT_SHARE of the rows is hot
HOT_LEAST = 1000  # fewer rows than this never burden a task
NO_SECOND = -(1 << 63)


def name_rows(rows: DataFrame, keys: Sequence[str], total: int, out: str = "_name") -> DataFrame:
    """``rows`` with their key columns replaced by an integer that equal keys share and others do not."""
    keys = list(keys)
    tag = F.xxhash64(*keys)
    counts = rows.groupBy(tag.alias("_tag")).count()
    hot = [r["_tag"] for r in counts.filter(F.col("count") > max(HOT_LEAST, total // HOT_SHARE)).select("_tag").collect()]

    def named(part: DataFrame, first: DataFrame, number) -> DataFrame:
        return part.join(first.select(*keys, number.alias(out)), keys).drop(*keys)

    light = rows.filter(~tag.isin(hot)) if hot else rows
    sorted_keys = light.select(*keys).distinct().sortWithinPartitions(*keys)
    found = named(light, sorted_keys, F.monotonically_increasing_id())
    if hot:
        heavy = rows.filter(tag.isin(hot))
        few = heavy.select(*keys).distinct().coalesce(1).sortWithinPartitions(*keys)
        found = found.unionByName(named(heavy, F.broadcast(few), -1 - F.monotonically_increasing_id()))
    return found


def normalised_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, chars of the text, tag, text_sha256 and number of blocks of its normalised form, written."""
    plain = F.regexp_replace(text_or_empty(text), SPACE, "")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.length(text_or_empty(text)).alias("chars"), plain.alias("_text"))
    blocks = F.greatest(F.ceil(F.length("_text") / BLOCK), F.lit(1)).cast("long")
    return cut_lineage(rows.select("doc_id", "chars", F.xxhash64("_text").alias("tag"), F.sha2("_text", 256).alias("text_sha256"), blocks.alias("blocks")))


def identities(docs: DataFrame, rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tag, level, name: one row for each pair of id and normalised text; ``rows`` are their
    ``normalised_rows``.

    ``tag`` only tells apart rows that share an id; (level, name) is the identity of the text.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_replace(text_or_empty(text), SPACE, "").alias("_text"))
    cut = F.when(F.col("_text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    arrays = plain.select("doc_id", F.xxhash64("_text").alias("tag"), cut.alias("_blocks"))
    sizes = rows.agg(F.sum("blocks").alias("rows"), F.max("blocks").alias("most")).first()
    if not sizes["rows"]:
        return plain.select("doc_id", F.lit(0).cast("long").alias("tag"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("name")).limit(0)
    keep = [F.col("doc_id"), F.col("tag"), F.size("_blocks").alias("_left")]
    blocks = unfold(arrays, keep, F.col("_blocks"), "_block", "_at")
    named = cut_lineage(name_rows(blocks, ["_block"], sizes["rows"]))
    level, most = 0, sizes["most"]
    done = [named.filter("_left = 1")]
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        even = F.col("_at") % 2 == 0
        pairs = named.filter("_left > 1").groupBy("doc_id", "tag", ((F.col("_left") + 1) / 2).cast("int").alias("_left"), F.floor(F.col("_at") / 2).cast("int").alias("_at"))
        pairs = cut_lineage(pairs.agg(F.max(F.when(even, F.col("_name"))).alias("_first"), F.coalesce(F.max(F.when(~even, F.col("_name"))), F.lit(NO_SECOND)).alias("_second")))
        named = name_rows(pairs, ["_first", "_second"], pairs.count())
        named = cut_lineage(named) if most > 1 else named
        done.append(named.filter("_left = 1"))
    found = None
    for k, part in enumerate(done):
        one = part.select("doc_id", "tag", F.lit(k).alias("level"), F.col("_name").alias("name"))
        one = one.distinct() if k == 0 else one  # repeated rows have become one from the first pairing on
        found = one if found is None else found.unionByName(one)
    return found


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    rows = normalised_rows(docs, doc_id, text)
    known = identities(docs, rows, doc_id, text).withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    placed = rows.join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    placed = cut_lineage(placed.select("doc_id", "chars", "text_sha256", "level", "name"))
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("id")))
    groups = cut_lineage(placed.groupBy("level", "name").agg(best["id"].alias("keep_id"), F.count("*").alias("group_size")).withColumn("_weight", F.col("group_size")))
    found = join_by_weight(placed, groups, ["level", "name"], "_weight")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": r"""
WITH plain AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
ranked AS (
  SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size
  FROM plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM ranked"""
}
