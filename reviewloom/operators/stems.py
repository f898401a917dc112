"""Stemming by a table of (surface, stem): the distinct words are looked up once and mapped back to the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.arrays import unfold
from reviewloom.functions.text import stem_input, stem_tokens
from reviewloom.operators.skew import join_by_weight
from reviewloom.session import cut_lineage


def surfaces(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """surface, n: the distinct words of a text column and how often they occur."""
    return unfold(df, [id_col], stem_input(text), "surface").groupBy("surface").agg(F.count(F.lit(1)).alias("n"))


def stem_table(words: DataFrame) -> DataFrame:
    """(surface, stem) by the affix rules, one row per distinct surface."""
    return words.select("surface", F.get(stem_tokens(F.array("surface")), F.lit(0)).alias("stem"))


def stem_with_table(df: DataFrame, id_col: str, text: str, table: DataFrame, out: str = "stemmed", rules: bool = False) -> DataFrame:
    """Add ``out``: every word replaced by its stem in ``table`` (surface, stem; a surface once), in order.

    A word the table does not have stays as it is, or goes by the affix rules with ``rules``. The words of a
    text meet their stems in a join that broadcasts the frequent ones and shuffles the rest, so no word of a
    language collects its occurrences in one task. Ids must be unique; a null text gives a null.
    """
    words = cut_lineage(unfold(df, [id_col], stem_input(text), "surface", "_pos"))
    counted = words.groupBy("surface").agg(F.count(F.lit(1)).alias("_n"))
    own = F.get(stem_tokens(F.array("surface")), F.lit(0)) if rules else F.col("surface")
    known = cut_lineage(counted.join(table.select("surface", "stem"), "surface", "left").select("surface", F.coalesce("stem", own).alias("stem"), "_n"))
    placed = join_by_weight(words, known, ["surface"], "_n")
    texts = placed.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_pos", "stem"))).alias("_all"))
    joined = F.array_join(F.transform("_all", lambda w: w["stem"]), " ")
    rows = df.join(texts, id_col, "left")
    return rows.withColumn(out, F.when(F.col(text).isNotNull(), F.coalesce(joined, F.lit("")))).drop("_all")
