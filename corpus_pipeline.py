"""From raw documents to training shards: the corpus operators as stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewloom.llm import decontaminate, language_id, mixing, sharding, simhash
from reviewloom.llm.common import id_remainder, small_enough, text_or_empty
from reviewloom.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Texts without a letter go, null ones too, and those whose best
    language stays below the calibrated threshold. Learns from the rows outside the held-out quarter."""
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs.filter(id_remainder(4) != 2))
    return language_id.identify(docs, model).filter(~F.col("_lang.rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link at 3 or fewer differing bits,
    directly or over others: the row of the smallest id (null ids last; among rows that share the id, the
    smallest text hash; of repeated rows, the first by source and language). Null and empty texts share
    fingerprint zero, so one of them stays; an empty table gives none."""
    docs = docs.select(*COLUMNS)
    tag = F.xxhash64(text_or_empty("text"))
    rows = simhash.near_duplicates(docs, words=3, distance=3, keep=[tag.alias("_tag")], roots=True)
    # Who leads a group follows from sums over rows; only one row of each group is joined.
    lead = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_tag")))
    stays = cut_lineage(rows.groupBy("root").agg(lead.alias("l")).select(F.col("l.doc_id").alias("_id"), F.col("l._tag").alias("_tag")))
    kept = docs.withColumn("_own", tag).join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_tag")))
    first = F.row_number().over(Window.partitionBy("_id", "_tag").orderBy("source", "lang"))  # of repeated rows
    return kept.withColumn("_first", first).filter("_first = 1").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither word by word nor with other slots."""
    docs = docs.select(*COLUMNS)
    tag = F.sha2(text_or_empty("text"), 256)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.occurrences(docs.select(tag.alias("doc_id"), "text"), benchmark)
    leaking = cut_lineage(found.select(F.col("doc_id").alias("_tag")).distinct())
    return docs.withColumn("_own", tag).join(small_enough(leaking), F.col("_own") == F.col("_tag"), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, dealt to the mix's shards and shuffled inside them."""
    docs = docs.select(*COLUMNS)
    plan = mixing.plan_mix(cut_lineage(mixing.slim_rows(docs, "doc_id", "text", "source")))
    rows = docs.withColumn("key", mixing.row_key("doc_id", "text")).withColumn("size", text_or_empty("text").rlike(mixing.WORD).cast("long"))
    drawn = mixing.draw(plan.apply(rows))
    # A shard is several files, so that their number follows the cluster and not the number of shards.
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // mixing.SHARDS)
    dealt = drawn.repartition(mixing.SHARDS * files, "shard", F.pmod("_order", F.lit(files)))
    return dealt.sortWithinPartitions("shard", "_order").select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there; shards are near equal in bytes and keep equal texts together."""
    return sharding.shard_documents(docs.select(*COLUMNS), carry=["text", "lang", "source", "n_chars"])


STAGES = [
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("shard", shard),
]
ORACLE_SQL = None  # language model, fingerprints and hypergeometric draws are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
