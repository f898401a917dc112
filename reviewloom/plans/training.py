"""From reviews to trained and evaluated sentiment models: the three scenarios.

Intermediate tables (split, counts, idf) are written to the shared folder, as each is read several
times: recomputing them would tokenise the whole corpus once per use.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators import dedup, evaluate, features, sampling
from reviewloom.operators.encode import fit_label_map, label_encode
from reviewloom.session import cut_lineage

ENTRIES = "array<struct<term:string,weight:double>>"


@dataclass
class Matrix:
    """TF-IDF rows of the training and the test part, fitted on the training part only."""

    docs: DataFrame  # (id, label, split)
    counts: DataFrame  # (id, split, label, term, n)
    idf: DataFrame  # (term, df, idf)
    weights: DataFrame  # (id, split, label, term, weight); the label saves chi-square a join
    id_col: str
    label: str
    rows: DataFrame | None = None  # (id, label, split, weights) with the entries of a document in its row, where ids are unique

    def kept(self) -> Matrix:
        """The same with its weights written, for several uses."""
        if self.rows is None:
            return replace(self, weights=cut_lineage(self.weights))
        rows = cut_lineage(self.rows)
        long = rows.select(self.id_col, "split", self.label, F.inline("weights"))
        return replace(self, rows=rows, weights=long.select("term", self.id_col, "split", self.label, "weight"))

    def part(self, name: str) -> tuple[DataFrame, DataFrame]:
        """Documents and weights of one part."""
        inside = F.col("split") == name
        return self.docs.filter(inside), self.weights.filter(inside).drop("split")


def split_reviews(
    reviews: DataFrame, label: str, id_col: str, keys: list[str], test: float = 0.2, seed: int = 42
) -> DataFrame:
    """De-duplicated reviews, written once, and tagged train or test by a map-side comparison."""
    unique = cut_lineage(dedup.dedup(reviews, keys, [id_col]))
    return sampling.stratified_split(unique, label, id_col, test, seed)


def build_matrix(split: DataFrame, label: str, id_col: str, text: str) -> Matrix:
    """Tokenise once, fit on train, transform both parts.

    Where every row has an id of its own, its terms are counted in the row, and (document, term) pairs are shuffled once
    (rare terms twice, for their idf). Rows that share an id are one document, whose counts have to be added up first.
    """
    docs = split.select(id_col, label, "split")
    if features.unique_ids(docs, id_col):
        return _matrix_of_unique(split, docs, label, id_col, text)
    counts = cut_lineage(features.term_counts(split, id_col, text, keep=["split", label]))
    train = counts.filter(F.col("split") == "train")
    idf = cut_lineage(features.tfidf_fit(train, docs.filter(F.col("split") == "train")))
    weights = features.tfidf_transform(counts, idf, id_col)
    return Matrix(docs, counts, idf, weights, id_col, label)


def _matrix_of_unique(split: DataFrame, docs: DataFrame, label: str, id_col: str, text: str) -> Matrix:
    counted = cut_lineage(split.select(id_col, "split", label, features.count_array(text).alias("_counts")))
    counts = counted.select(id_col, "split", label, F.inline("_counts"))
    idf = cut_lineage(features.tfidf_fit(counts.filter(F.col("split") == "train"), docs.filter(F.col("split") == "train")))
    packed = features.packed_weights(counts.select(id_col, "term", "n"), idf, id_col)
    ids = counted.select(id_col, label, "split")
    long = ids.join(packed, id_col).select(id_col, "split", label, "_norm", F.inline("_e"))
    weights = long.select("term", id_col, "split", label, (F.col("weight") / F.col("_norm")).alias("weight"))
    unit = F.transform(F.sort_array("_e"), lambda e: F.struct(e["term"].alias("term"), (e["weight"] / F.col("_norm")).alias("weight")))
    rows = ids.join(packed, id_col, "left").select(id_col, label, "split", F.coalesce(unit, F.array().cast(ENTRIES)).alias("weights"))
    return Matrix(docs, counts, idf, weights, id_col, label, rows)


def entry_rows(docs: DataFrame, weights: DataFrame, id_col: str, out: str = "weights") -> DataFrame:
    """One row per document with its term-sorted (term, weight) array; empty for documents without
    known terms."""
    packed = weights.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias(out))
    empty = F.array().cast(ENTRIES)
    return docs.join(packed, id_col, "left").withColumn(out, F.coalesce(out, empty))


def model_rows(matrix: Matrix) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows and test rows ``(id, label, label_idx, weights)``, written once, and the label map
    of the training part. A label that only the test part has raises."""
    label_map = cut_lineage(fit_label_map(matrix.part("train")[0], matrix.label))
    rows = matrix.rows if matrix.rows is not None else entry_rows(matrix.docs, matrix.weights.drop("split"), matrix.id_col)
    packed = cut_lineage(rows)
    coded = label_encode(packed, matrix.label, label_map)
    train = coded.filter(F.col("split") == "train").drop("split")
    return train, coded.filter(F.col("split") == "test").drop("split"), label_map


def scenario_report(predicted: DataFrame, actual: str = "label_idx", guess: str = "prediction") -> DataFrame:
    """Classification report of predicted codes."""
    named = predicted.select(F.col(actual).cast("int").cast("string").alias("a"), F.col(guess).cast("int").cast("string").alias("p"))
    return evaluate.classification_report(evaluate.confusion_matrix(named, "a", "p"))
