"""Sparse text features in long form: one row per (document, term). The vocabulary never becomes
columns and never reaches the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.arrays import unfold
from reviewloom.functions.html import let
from reviewloom.functions.text import token_array
from reviewloom.operators.bounded import broadcast_bounded
from reviewloom.operators.skew import join_by_weight
from reviewloom.session import cut_lineage

MAX_CLASSES = 10_000
TASK_PAIRS = 2_000_000  # (document, term) pairs that one task gathers
TIE_DIGITS = 9  # scores are compared after rounding, so that summation order cannot reorder ties


def tokenize(df: DataFrame, id_col: str, text: str, min_len: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """One row per token occurrence."""
    return unfold(df, [id_col, *keep], token_array(text, min_len), "term")


def term_counts(df: DataFrame, id_col: str, text: str, min_len: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Occurrences per (document, term). A document sits in one task, so counting is finished
    map-side and only distinct pairs are shuffled."""
    return (
        tokenize(df, id_col, text, min_len, keep)
        .groupBy(id_col, *keep, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own. Only ids are shuffled."""
    again = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col(id_col).isNull() | (F.col("_n") > 1))
    return again.isEmpty()


def count_array(text: Column | str, min_len: int = 2) -> Column:
    """The distinct terms of a text as a sorted array of (term, n), null without any. The row's own tokens are sorted and
    their runs counted, so nothing is shuffled."""

    def runs(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        ends = lambda at, i, j: F.coalesce(F.get(at, j + 1), F.size(words)) - i
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(words, i).alias("term"), ends(at, i, j).cast("long").alias("n"))))

    return let(F.sort_array(token_array(text, min_len)), lambda words: F.when(F.size(words) > 0, runs(words)))


def packed_weights(counts: DataFrame, idf: DataFrame, id_col: str) -> DataFrame:
    """``(id, _e, _norm)``: the (term, weight) entries of every id with known terms, and their L2 norm.

    The entries meet once, in tasks of at most about ``TASK_PAIRS`` of them whatever the size of the table.
    """
    weighted = tfidf_weights(counts, idf).select(id_col, "term", "weight")
    pairs = idf.agg(F.sum("df").alias("n")).first()["n"] or 0
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS))
    entries = F.collect_list(F.struct("term", "weight")).alias("_e")
    return weighted.repartition(parts, id_col).groupBy(id_col).agg(entries, F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))


def term_document_frequency(counts: DataFrame) -> DataFrame:
    """Documents per term. Reading ``n`` keeps the plan of ``counts`` equal to its other uses in a
    job, so Spark computes that exchange once."""
    return counts.groupBy("term").agg(F.count(F.when(F.col("n") > 0, 1)).alias("df"))


def vocabulary(counts: DataFrame, out: str = "term_idx") -> DataFrame:
    """Distinct terms with their 0-based alphabetical index.

    The terms are dealt to ranges of equal size, sorted there and written; an index is the place in the
    range plus the sizes of the ranges before it, a table of one row per range.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = counts.select("term").distinct().repartitionByRange(parts, "term").sortWithinPartitions("term")
    # The upper bits of this id are the range, the lower 33 the place in it.
    placed = cut_lineage(terms.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row per range
    return numbered.select("term", (F.col("_offset") + place).cast("long").alias(out))


def tfidf_fit(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """``(term, df, idf)`` with idf = ln((1 + n) / (1 + df)) + 1.

    ``docs`` are the training documents: those without any token count too.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return term_document_frequency(counts).select(
        "term", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf")
    )


def tfidf_weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """Add ``weight = n * idf``; terms the fit has not seen drop out.

    Term frequencies are Zipf-distributed: a plain join on the term would send the rows of "the" to
    one task. The frequent terms are few and join by broadcast, the rest by shuffle without skew.
    """
    joined = join_by_weight(counts, idf.select("term", "df", "idf"), ["term"], "df")
    return joined.withColumn("weight", F.col("n") * F.col("idf"))


def tfidf_transform(counts: DataFrame, idf: DataFrame, id_col: str) -> DataFrame:
    """L2-normalised TF-IDF rows. A document without known terms has no rows."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(id_col)))
    return tfidf_weights(counts, idf).withColumn("weight", F.col("weight") / norm).drop("n", "idf")


def chi2_scores(tf: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """Chi-square of each term against the class, on sums of weights.

    Observed o = weight per class, expected e = class share p times total weight t. Over all
    classes, those without the term included, sum((o - e)^2 / e) = sum(o^2 / p) / t - t, so absent
    (term, class) pairs need no rows. ``tf`` may carry the label; then no join is needed. A term whose
    weights sum to 0 has a null score and is selected last.
    """
    counted = labels.filter(F.col(label).isNotNull())
    total = counted.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = counted.groupBy(label).agg((F.count(F.lit(1)) / total).alias("share"))
    labelled = tf.filter(F.col(label).isNotNull()) if label in tf.columns else tf.join(counted.select(id_col, label), id_col)
    observed = labelled.groupBy("term", label).agg(F.sum("weight").alias("observed"))
    per_term = (
        observed.join(broadcast_bounded(share, MAX_CLASSES, "classes"), label)
        .groupBy("term")
        .agg(
            F.sum("observed").alias("t"),
            F.sum(F.col("observed") * F.col("observed") / F.col("share")).alias("s"),
        )
    )
    return per_term.select("term", (F.try_divide("s", "t") - F.col("t")).alias("chi2"))


def select_k_best(scores: DataFrame, k: int | None) -> DataFrame:
    """The ``k`` best terms; on equal scores the alphabetically last win. ``None`` or a k above the
    number of terms keeps all. Planned as a distributed top-k."""
    if k is None:
        return scores
    return scores.orderBy(F.desc_nulls_last(F.round("chi2", TIE_DIGITS)), F.desc("term")).limit(k)


def apply_selection(tf: DataFrame, selected: DataFrame, k: int | None) -> DataFrame:
    """Rows of the selected terms. With a k the table has at most k rows and is broadcast."""
    terms = selected.select("term")
    return tf.join(terms if k is None else F.broadcast(terms), "term", "left_semi")


def selection_shape_report(before: DataFrame, selected: DataFrame) -> DataFrame:
    """Number of features before and after selection."""
    stages = [("before", before), ("after", selected)]
    parts = [
        frame.select("term").distinct().agg(F.count(F.lit(1)).alias("n_features")).select(F.lit(stage).alias("stage"), "n_features")
        for stage, frame in stages
    ]
    return parts[0].unionByName(parts[1])


def _top_per_group(df: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per group; the group limit is applied map-side, before the exchange."""
    window = W.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def top_keywords(counts: DataFrame, idf: DataFrame, by: str, n: int = 5) -> DataFrame:
    """Top terms of each group's concatenated texts by TF-IDF. ``counts`` must carry ``by``.

    The L2 norm is the same for all terms of a group and does not change their order.
    """
    summed = counts.groupBy(by, "term").agg(F.sum("n").alias("n"))
    weighted = tfidf_weights(summed, idf)
    top = _top_per_group(weighted, by, [F.desc(F.round("weight", TIE_DIGITS)), F.col("term")], n)
    return top.select(by, "rank", "term", "weight")


def word_frequencies(
    df: DataFrame, by: str, text: str, n: int = 100, stop: Sequence[str] = (), ngram: int = 1
) -> DataFrame:
    """The ``n`` most frequent words (or ``ngram``-word phrases) per group."""
    tokens = token_array(text)
    if stop:
        words = list(stop)
        tokens = F.filter(tokens, lambda t: ~t.isin(words))
    if ngram > 1:
        base = df.select(by, tokens.alias("_tokens"))
        starts = F.when(F.size("_tokens") >= ngram, F.sequence(F.lit(1), F.size("_tokens") - ngram + 1))
        grams = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get("_tokens", i + (j - 1)) for j in range(ngram)]))
        terms = unfold(base, [by], grams, "term")
    else:
        terms = unfold(df, [by], tokens, "term")
    counts = terms.filter(F.col(by).isNotNull()).groupBy(by, "term").agg(F.count(F.lit(1)).alias("n"))
    return _top_per_group(counts, by, [F.desc("n"), F.col("term")], n)


def to_sparse_vectors(tf: DataFrame, index: DataFrame, size: int, id_col: str, out: str = "features") -> DataFrame:
    """One ML sparse vector per document, built without leaving the JVM.

    ``index`` is ``(term, term_idx)`` for at most ``size`` selected terms, which is checked. The vector is parsed from
    its struct form, which is how Spark itself stores it.
    """
    entries = (
        tf.join(broadcast_bounded(index.select("term", "term_idx"), size, "selected terms"), "term")
        .groupBy(id_col)
        .agg(F.sort_array(F.collect_list(F.struct(F.col("term_idx").cast("int").alias("i"), F.col("weight").alias("w")))).alias("_e"))
    )
    return entries.select(id_col, vector_from_entries(F.col("_e"), size).alias(out))


def vector_from_entries(entries: Column, size: int) -> Column:
    """Sparse vector from a sorted array of (i, w) structs."""
    raw = F.struct(
        F.lit(0).alias("type"),
        F.lit(size).alias("size"),
        F.transform(entries, lambda e: e["i"]).alias("indices"),
        F.transform(entries, lambda e: e["w"]).alias("values"),
    )
    holder = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(raw.alias("v"))), holder)["v"]
