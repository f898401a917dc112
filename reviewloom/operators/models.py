"""Sentiment models: boosted trees on sparse TF-IDF rows, selection and resampling inside ``fit``, grid search, and
one artefact that turns raw text into label and confidence.

Everything covers all rows: vocabulary, idf, resampling, selection, trees, search, prediction, evaluation. Few entries are
one task's fit, and the points and folds of a search are spread over the tasks; from ``TASK_ENTRIES`` on, terms are dealt to
tasks that grow the same trees together. Only a caller who names a number of rows (``fit_rows``, ``search_rows``) gets a fit
on that many, with every class at its share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.constants import GRID
from reviewloom.functions.text import preprocess_serve
from reviewloom.operators import boosting
from reviewloom.operators.boosting import BASELINE, Sparse, Trees
from reviewloom.operators.bounded import few_rows, small_table
from reviewloom.operators.encode import MAX_CLASSES
from reviewloom.operators.features import chi2_scores, count_array, select_k_best, term_counts, tfidf_weights, unique_ids
from reviewloom.operators.peers import Peers, slots
from reviewloom.operators.ranking import HashOrder
from reviewloom.operators.sampling import split_quotas, stratified_kfold
from reviewloom.operators.smote import smote_sparse
from reviewloom.session import cut_lineage, scratch_path

TASK_ENTRIES = 250_000  # (row, term) entries that a fit has a task for, as far as there are tasks
SEARCH_ENTRIES = 1_000_000  # entries up to which each point of a search is one task's fit
SCENARIO_3_TERMS = 2000
NODE = "node int, feature long, threshold double, absent_left boolean, left int, right int, value double"
MAX_NODES = 1_000_000


# ---------------------------------------------------------------- rows that a task can fit


def bounded_rows(rows: DataFrame, label: str, id_col: str, limit: int, seed: int = 42) -> DataFrame:
    """All rows, or exactly ``limit`` of them in seeded hash order with every class at its share."""
    order = HashOrder(rows, label, id_col, seed)
    total = sum(order.sizes.values())
    if total <= limit:
        return rows.filter(F.col(label).isNotNull())
    quotas = split_quotas(order.sizes, limit / total)
    placed = order.place(rows.filter(F.col(label).isNotNull()), order.cuts({v: [q] for v, q in quotas.items()}), "_cut")
    return placed.filter(F.col("_cut") == 0).drop("_cut")


def packed(rows: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep``, the weights, and ``_f``: 64-bit names of the terms."""
    return rows.select(*keep, F.transform("weights", lambda e: F.xxhash64(e["term"])).alias("_f"), F.transform("weights", lambda e: e["weight"]).alias("_w"))


def fitted_rows(rows: DataFrame, label: str, id_col: str, limit: int | None, seed: int) -> DataFrame:
    """All labelled rows, or as many as the caller asked for."""
    return rows.filter(F.col(label).isNotNull()) if limit is None else bounded_rows(rows, label, id_col, limit, seed)


def entries_of(rows: DataFrame) -> int:
    """Number of (row, term) entries."""
    return rows.agg(F.sum(F.greatest(F.size("weights"), F.lit(0)))).first()[0] or 0


def term_columns(rows: DataFrame, label: str, id_col: str, tasks: int) -> tuple[DataFrame, list[int]]:
    """Entries ``(_row, _f, _w)`` with task t's terms in partition t, in the order of their names, and the rows of each class.

    Rows are numbered by label, id and what they hold, so their labels follow from the sizes of the classes.
    """
    wide = rows.select(F.col(label).cast("int").alias("_label"), F.col(id_col).cast("string").alias("_id"), F.xxhash64("weights").alias("_tie"), "weights")
    # The upper bits of this id are the sorted range, the lower 33 the place in it.
    placed = cut_lineage(wide.orderBy("_label", "_id", "_tie").withColumn("_at", F.monotonically_increasing_id()).drop("_id", "_tie"))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row per range
    long = numbered.select((F.col("_offset") + place).cast("int").alias("_row"), F.inline("weights"))
    named = long.select("_row", F.xxhash64("term").alias("_f"), F.col("weight").cast("double").alias("_w"))
    share = F.floor((F.col("_f") / F.lit(2.0**64) + 0.5) * tasks).cast("int")  # names are hashes: ranges of equal width hold about as many
    sizes = {r["_label"]: r["n"] for r in few_rows(placed.groupBy("_label").agg(F.count(F.lit(1)).alias("n")), MAX_CLASSES, "classes")}
    return named.repartitionById(tasks, F.least(F.greatest(share, F.lit(0)), F.lit(tasks - 1))), [sizes.get(c, 0) for c in range(max(sizes, default=0) + 1)]


def _joined(batches, rows: int) -> Sparse:
    """The entries that one task of ``term_columns`` has."""
    none = pd.DataFrame({"_row": np.zeros(0, np.int32), "_f": np.zeros(0, np.int64), "_w": np.zeros(0)})
    frame = pd.concat([none, *batches], ignore_index=True)
    return Sparse.long(rows, *(frame[c].to_numpy() for c in ("_row", "_f", "_w")))


def _sparse(frame: pd.DataFrame) -> Sparse:
    return Sparse.of(frame["_f"].tolist(), frame["_w"].tolist())


def _trees_of(nodes: pd.DataFrame, classes: int, rounds: int, first: Sequence[int]) -> Trees:
    columns = {c: nodes[c].to_numpy() for c in ("feature", "threshold", "absent_left", "left", "right", "value")}
    return Trees(classes, rounds, np.array(first, dtype=np.int64), **columns)


# ---------------------------------------------------------------- estimators


class BoostedTrees(Estimator):
    """Softmax boosting on rows ``(id, label_idx, weights)``; parameters go by the reference's names."""

    def __init__(self, params: Mapping[str, float] | None = None, id_col: str = "review_id", fit_rows: int | None = None, seed: int = 42):
        super().__init__()
        self.settings = {**BASELINE, **(params or {})}
        self.id_col, self.fit_rows, self.fit_seed = id_col, fit_rows, seed

    def _fit(self, dataset: DataFrame) -> "BoostedTreesModel":
        rows = fitted_rows(dataset, "label_idx", self.id_col, self.fit_rows, self.fit_seed)
        classes = int((dataset.agg(F.max("label_idx").alias("m")).first()["m"] or 0)) + 1
        settings, seed, spark = self.settings, self.fit_seed, dataset.sparkSession
        tasks = min(slots(spark.sparkContext), -(-entries_of(rows) // TASK_ENTRIES))

        def nodes_of(trees: Trees) -> pd.DataFrame:
            nodes = pd.DataFrame(trees.rows())
            nodes["first"] = np.isin(nodes["node"], trees.tree)
            return nodes

        def train(frame: pd.DataFrame) -> pd.DataFrame:
            labels = frame["label_idx"].to_numpy()
            order = np.lexsort((frame["_id"].to_numpy().astype(str), labels))  # the same rows in the same order
            frame = frame.iloc[order]
            return nodes_of(boosting.fit(_sparse(frame), frame["label_idx"].to_numpy(), classes, settings, seed, threads=classes))

        if tasks <= 1:
            one = packed(rows, "label_idx", F.col(self.id_col).cast("string").alias("_id")).withColumn("_all", F.lit(0))
            found = one.groupBy("_all").applyInPandas(train, f"{NODE}, first boolean")  # at most TASK_ENTRIES entries
        else:
            columns, sizes = term_columns(rows, "label_idx", self.id_col, tasks)
            folder = scratch_path(spark, "peers")

            def train_together(batches):
                peers = Peers(folder)
                trees = boosting.fit(_joined(batches, sum(sizes)), np.repeat(np.arange(len(sizes)), sizes), classes, settings, seed, peers=peers)
                if peers.place == 0:  # all of them have the same trees
                    yield nodes_of(trees)

            found = cut_lineage(columns.mapInPandas(train_together, f"{NODE}, first boolean", barrier=True))
        nodes = found.limit(MAX_NODES + 1).toPandas().sort_values("node")
        if len(nodes) > MAX_NODES:
            raise ValueError(f"more than {MAX_NODES} nodes")
        first = nodes["node"][nodes["first"].astype(bool)].tolist()
        rounds = int(settings["n_estimators"]) if len(nodes) else 0
        return BoostedTreesModel(_trees_of(nodes, classes, rounds, first))


def boosted_trees(params: Mapping[str, float] | None = None, seed: int = 42) -> BoostedTrees:
    return BoostedTrees(params, seed=seed)


class BoostedTreesModel(Model):
    """Adds ``probability`` (per class), ``prediction`` and ``confidence`` to rows with ``weights``: a narrow pass."""

    def __init__(self, trees: Trees):
        super().__init__()
        self.trees = trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = self.trees

        @F.pandas_udf("array<double>")
        def score(features: pd.Series, weights: pd.Series) -> pd.Series:
            return pd.Series(list(boosting.probabilities(trees.margins(Sparse.of(features.tolist(), weights.tolist())))))

        names = F.transform("weights", lambda e: F.xxhash64(e["term"]))
        rows = dataset.withColumn("probability", score(names, F.transform("weights", lambda e: e["weight"].cast("double"))))
        best = F.array_position("probability", F.array_max("probability")) - 1
        return rows.withColumn("prediction", best.cast("double")).withColumn("confidence", predict_confidence(F.col("probability")))

    def node_table(self, spark: SparkSession) -> DataFrame:
        """The nodes of all trees; ``tree`` numbers the trees by their first nodes."""
        rows = [r | {"tree": int(np.searchsorted(self.trees.tree, r["node"], side="right")) - 1} for r in self.trees.rows()]
        return small_table(spark, rows, T._parse_datatype_string(f"{NODE}, tree int"))


def predict_confidence(probability: Column) -> Column:
    """Highest class probability; 1 when there is none."""
    return F.coalesce(F.array_max(probability), F.lit(1.0))


class _SelectParams(Params):
    k = Param(Params._dummy(), "k", "number of terms to keep; none keeps all", lambda v: None if v is None else TypeConverters.toInt(v))
    resample = Param(Params._dummy(), "resample", "oversample minority classes in fit", TypeConverters.toBoolean)
    neighbors = Param(Params._dummy(), "neighbors", "neighbours used by oversampling", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(k=SCENARIO_3_TERMS, resample=True, neighbors=5, seed=42)


class ResampleSelectClassifier(Estimator, _SelectParams):
    """Oversample → k best terms by chi-square → boosted trees, on rows ``(id, label_idx, weights)``.

    Resampling and selection happen in ``fit`` on the rows given, so a search fits them on the training
    folds only; the fitted model selects and predicts, and never adds rows.
    """

    @keyword_only
    def __init__(self, *, classifier: BoostedTrees | None = None, idCol: str = "review_id", k: int | None = SCENARIO_3_TERMS, resample: bool = True, neighbors: int = 5, seed: int = 42):
        super().__init__()
        self.classifier = classifier or boosted_trees(seed=seed)
        self.idCol = idCol
        self._set(resample=resample, neighbors=neighbors, seed=seed)
        self.terms = k  # none is no value that Spark's parameters know
        if k is not None:
            self._set(k=k)

    def prepare(self, dataset: DataFrame) -> tuple[DataFrame, list[str] | None]:
        """Resampled rows with the selected terms only, and these terms (none: all)."""
        rows = dataset.select(F.col(self.idCol).cast("string").alias("row_id"), F.col("label_idx").cast("int").alias("label_idx"), "weights")
        if self.getOrDefault(self.resample):
            rows = cut_lineage(smote_sparse(rows, "label_idx", "row_id", "weights", self.getOrDefault(self.neighbors), self.getOrDefault(self.seed)).drop("synthetic"))
        if self.terms is None:
            return rows, None
        rows = cut_lineage(rows) if not self.getOrDefault(self.resample) else rows
        long = rows.select("row_id", "label_idx", F.inline("weights"))
        best = select_k_best(chi2_scores(long, rows, "row_id", "label_idx"), self.terms)
        # At most k terms, a number the caller chose.
        terms = sorted(r["term"] for r in few_rows(best.select("term"), self.terms, "selected terms"))
        return rows.withColumn("weights", F.filter("weights", lambda e: e["term"].isin(terms))), terms

    def _fit(self, dataset: DataFrame) -> "ResampleSelectModel":
        rows, terms = self.prepare(dataset)
        trees = BoostedTrees(self.classifier.settings, "row_id", self.classifier.fit_rows, self.classifier.fit_seed).fit(rows)
        return self._copyValues(ResampleSelectModel(trees, terms))


class ResampleSelectModel(Model, _SelectParams):
    """Selected terms (none: all) and the fitted trees, which read selected terms only."""

    def __init__(self, trees: BoostedTreesModel, terms: Sequence[str] | None):
        super().__init__()
        self.trees, self.terms = trees, terms

    @property
    def size(self) -> int | None:
        return None if self.terms is None else len(self.terms)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.trees.transform(dataset)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        write_trees(spark, self.trees, path)
        terms = [{"term": t, "term_idx": i} for i, t in enumerate(self.terms or [])]
        small_table(spark, terms, T._parse_datatype_string("term string, term_idx int")).write.mode("overwrite").parquet(f"{path}/terms")
        write_manifest(spark, path, {"kind": "select", "terms": -1 if self.terms is None else len(self.terms)} | tree_facts(self.trees))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ResampleSelectModel":
        facts = read_manifest(spark, path, "select")
        terms = [r["term"] for r in spark.read.parquet(f"{path}/terms").orderBy("term_idx").collect()]
        if facts["terms"] not in (-1, len(terms)):
            raise ValueError(f"{path}: {len(terms)} of {facts['terms']} terms")
        return ResampleSelectModel(read_trees(spark, path, facts), None if facts["terms"] == -1 else terms)


def train_baseline(rows: DataFrame, params: Mapping[str, float] | None = None, k: int | None = None, id_col: str = "review_id", seed: int = 42) -> ResampleSelectModel:
    """Boosted trees on TF-IDF without resampling, on every term unless ``k`` is given."""
    stage = ResampleSelectClassifier(classifier=boosted_trees(params, seed), idCol=id_col, k=k, resample=False, seed=seed)
    return stage.fit(rows)


# ---------------------------------------------------------------- evaluation and search


class MacroF1Evaluator(Evaluator):
    """Unweighted mean of the per-class F1. (Spark's own "f1" weights by class size.)"""

    def __init__(self, labelCol: str = "label_idx", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol, self.predictionCol = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.groupBy(
            F.col(self.labelCol).cast("int").alias("actual"), F.col(self.predictionCol).cast("int").alias("predicted")
        ).agg(F.count(F.lit(1)).alias("n"))
        # The confusion table has one row per pair of classes.
        cells = few_rows(pairs, MAX_CLASSES, "pairs of classes")
        return macro_f1({(r["actual"], r["predicted"]): r["n"] for r in cells})

    def isLargerBetter(self) -> bool:
        return True


def macro_f1(cells: Mapping[tuple[int, int], int]) -> float:
    classes = {c for pair in cells for c in pair}
    scores = []
    for value in classes:
        hit = sum(n for (a, p), n in cells.items() if a == p == value)
        seen = sum(n * ((a == value) + (p == value)) for (a, p), n in cells.items())
        scores.append(2.0 * hit / seen if seen else 0.0)
    return sum(scores) / len(scores) if scores else 0.0


def param_grid(stage: BoostedTrees, grid: Mapping[str, Sequence[float]] = GRID) -> list[dict[str, float]]:
    """All combinations of the grid over the stage's own settings."""
    return [{**stage.settings, **dict(zip(grid, values))} for values in product(*grid.values())]


@dataclass
class Search:
    """Scores of a grid search, best first, and the model refitted with the best settings."""

    scores: list[tuple[float, dict[str, float]]]
    bestModel: ResampleSelectModel

    @property
    def best(self) -> dict[str, float]:
        return self.scores[0][1]


def grid_scores(rows: DataFrame, grid: Mapping[str, Sequence[float]], stage: ResampleSelectClassifier, fold: str, folds: int, search_rows: int | None = None) -> list[tuple[float, dict[str, float]]]:
    """(mean macro F1, combination) of every combination, best first; ties keep the grid's order.

    All labelled rows take part, unless ``search_rows`` names a number. Folds are prepared once each, and the first rounds of
    a long fit are the short fit, so a combination that differs in its number of rounds only is read off the same trees.
    Up to ``SEARCH_ENTRIES`` entries each point and fold is a group of its own; above, all tasks fit one after the other.
    """
    taken = cut_lineage(fitted_rows(rows, "label_idx", stage.idCol, search_rows, stage.classifier.fit_seed))
    if fold not in taken.columns:
        taken = cut_lineage(stratified_kfold(taken, "label_idx", stage.idCol, folds, out=fold))
    names = [n for n in grid if n != "n_estimators"]
    rounds = sorted(int(r) for r in grid.get("n_estimators", [stage.classifier.settings["n_estimators"]]))
    points = [dict(zip(names, values)) for values in product(*(grid[n] for n in names))]
    settings = [{**stage.classifier.settings, **p, "n_estimators": rounds[-1]} for p in points]
    classes = int(taken.agg(F.max("label_idx").alias("m")).first()["m"] or 0) + 1
    seed, parts = stage.classifier.fit_seed, []
    for k in range(folds):
        train, terms = stage.prepare(taken.filter(F.col(fold) != k))
        train = train.select("label_idx", F.col("row_id").alias("_id"), "weights", F.lit(True).alias("_train"))
        valid = taken.filter(F.col(fold) == k)
        if terms is not None:
            valid = valid.withColumn("weights", F.filter("weights", lambda e: e["term"].isin(terms)))  # noqa: B023
        valid = valid.select(F.col("label_idx").cast("int").alias("label_idx"), F.col(stage.idCol).cast("string").alias("_id"), "weights", F.lit(False).alias("_train"))
        parts.append(cut_lineage(train.unionByName(valid)))
    tasks = slots(rows.sparkSession.sparkContext)
    if tasks > 1 and max(entries_of(p) for p in parts) > SEARCH_ENTRIES:
        scored = [r for k, p in enumerate(parts) for r in _scores_together(p, settings, k, classes, rounds, seed, tasks)]
    else:
        scored = _scores_apart(parts, settings, classes, rounds, seed)
    means: dict[tuple[int, int], float] = {}
    for r in sorted(scored, key=lambda r: r["fold"]):
        means[r["point"], r["rounds"]] = means.get((r["point"], r["rounds"]), 0.0) + r["macro_f1"] / folds
    place = {tuple(p.items()): i for i, p in enumerate(points)}
    found = []
    for combination in param_grid(stage.classifier, grid):
        own = {n: combination[n] for n in grid}
        score_ = means[place[tuple((n, own[n]) for n in names)], int(combination["n_estimators"])]
        found.append((float(score_), own))
    return sorted(found, key=lambda s: -round(s[0], 9))


SCORES = "point int, fold int, rounds int, macro_f1 double"


def _scores_of(point: int, fold: int, actual: np.ndarray, margins: Mapping[int, np.ndarray]) -> pd.DataFrame:
    """A row per number of rounds."""
    found = []
    for n, margin in margins.items():
        cells: dict[tuple[int, int], int] = {}
        for pair in zip(actual.tolist(), margin.argmax(axis=1).tolist()):
            cells[pair] = cells.get(pair, 0) + 1
        found.append((point, fold, n, macro_f1(cells)))
    return pd.DataFrame(found, columns=["point", "fold", "rounds", "macro_f1"])


def _scores_apart(parts: Sequence[DataFrame], settings: Sequence[Mapping[str, float]], classes: int, rounds: Sequence[int], seed: int) -> list:
    """Each point and fold in a task of its own."""

    def score(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.iloc[np.lexsort((frame["_id"].to_numpy().astype(str), frame["label_idx"].to_numpy()))]
        labels, held = frame["label_idx"].to_numpy(), ~frame["_train"].to_numpy()
        _, margins = boosting.fit_and_hold(_sparse(frame), labels, classes, settings[key[0]], seed, held=held, stops=rounds)
        return _scores_of(key[0], key[1], labels[held], margins)

    each = [packed(p, "label_idx", "_id", "_train").withColumn("_fold", F.lit(k)) for k, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, each).withColumn("_point", F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))))
    # As many partitions as groups: each is the work of minutes.
    spread = every.repartition(len(settings) * len(parts), "_point", "_fold")
    return spread.groupBy("_point", "_fold").applyInPandas(score, SCORES).collect()


def _scores_together(part: DataFrame, settings: Sequence[Mapping[str, float]], fold: int, classes: int, rounds: Sequence[int], seed: int, tasks: int) -> list:
    """The points of a fold one after the other, each fitted by all tasks."""
    coded = part.withColumn("_code", F.col("label_idx") * 2 + (~F.col("_train")).cast("int"))
    columns, sizes = term_columns(coded, "_code", "_id", tasks)
    folder = scratch_path(part.sparkSession, "peers")

    def score(batches):
        peers, codes = Peers(folder), np.repeat(np.arange(len(sizes)), sizes)
        data, held = _joined(batches, len(codes)), codes % 2 == 1
        for point, params in enumerate(settings):
            _, margins = boosting.fit_and_hold(data, codes // 2, classes, params, seed, held=held, stops=rounds, peers=peers)
            if peers.place == 0:  # all of them have the same trees
                yield _scores_of(point, fold, codes[held] // 2, margins)

    return cut_lineage(columns.mapInPandas(score, SCORES, barrier=True)).collect()


def grid_search(
    rows: DataFrame,
    grid: Mapping[str, Sequence[float]] = GRID,
    fold: str = "fold",
    folds: int = 3,
    estimator: ResampleSelectClassifier | None = None,
    search_rows: int | None = None,
) -> Search:
    """Cross-validated search by macro F1, and the best settings fitted on all rows."""
    stage = estimator or ResampleSelectClassifier(k=None, resample=False)
    scores = grid_scores(rows, grid, stage, fold, folds, search_rows)
    own = stage.classifier
    stage.classifier = BoostedTrees({**own.settings, **scores[0][1]}, own.id_col, own.fit_rows, own.fit_seed)
    return Search(scores, stage.fit(rows))


def best_params(spark: SparkSession, search: Search) -> DataFrame:
    """One row per combination: its parameters, mean macro F1, and rank."""
    rows = [{"rank": i, "macro_f1": s, "params": [(n, str(v)) for n, v in p.items()]} for i, (s, p) in enumerate(search.scores, 1)]
    return small_table(spark, rows, T._parse_datatype_string("rank int, macro_f1 double, params map<string,string>"))


# ---------------------------------------------------------------- one artefact for serving


class SentimentModel(Model, MLWritable, MLReadable):
    """Raw text → label and confidence: idf table, label map and trees in one stage.

    It is written and read as a whole: the manifest comes last and counts the parts, and a model with a missing or
    incomplete part does not load. The vocabulary may be of any size: tokens meet their idf by the join that splits
    frequent terms from rare ones.
    """

    def __init__(self, idf: DataFrame, labels: Sequence[str], trees: BoostedTreesModel, id_col: str = "review_id", text: str = "review", out: str = "predicted"):
        super().__init__()
        self.idf, self.labels, self.trees = idf, list(labels), trees
        self.id_col, self.text, self.out = id_col, text, out

    def score(self, reviews: DataFrame) -> DataFrame:
        """id, label, confidence of every row; ids are unique. Texts are not shuffled, only terms are."""
        prepared = reviews.select(self.id_col, preprocess_serve(self.text).alias("_prepared"))
        if unique_ids(reviews, self.id_col):  # terms are counted in the row, and read twice below
            counts = cut_lineage(prepared.select(self.id_col, count_array("_prepared").alias("_counts"))).select(self.id_col, F.inline("_counts"))
        else:
            counts = term_counts(prepared, self.id_col, "_prepared")
        weighted = tfidf_weights(counts, self.idf)
        entry = F.struct("term", "weight")
        used = self._used(reviews.sparkSession)
        if used is not None:
            marked = weighted.join(used, F.xxhash64("term") == F.col("_name"), "left")
            entry = F.when(F.col("_name").isNotNull(), entry)  # the norm needs all terms, the trees need theirs
        else:
            marked = weighted
        packed_ = marked.groupBy(self.id_col).agg(F.sort_array(F.collect_list(entry)).alias("_e"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
        ids = reviews.select(self.id_col)
        rows = ids.join(packed_, self.id_col, "left")
        unit = F.transform("_e", lambda e: F.struct(e["term"].alias("term"), (e["weight"] / F.col("_norm")).alias("weight")))
        none = F.array().cast("array<struct<term:string,weight:double>>")
        scored = self.trees.transform(rows.select(self.id_col, F.coalesce(unit, none).alias("weights")))
        label = F.element_at(F.lit(self.labels), F.col("prediction").cast("int") + 1)
        return scored.select(self.id_col, label.alias(self.out), "confidence")

    def _used(self, spark: SparkSession) -> DataFrame | None:
        names = [{"_name": int(n)} for n in self.trees.trees.used()]  # at most a name per node
        return F.broadcast(small_table(spark, names, T._parse_datatype_string("_name long")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.join(self.score(dataset), self.id_col)

    def write(self) -> MLWriter:
        return _SentimentWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SentimentReader()


class _SentimentWriter(MLWriter):
    def __init__(self, model: SentimentModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, spark = self.model, self.model.idf.sparkSession
        model.idf.select("term", "df", "idf").write.parquet(f"{path}/idf")
        labels = [{"label": v, "label_idx": i} for i, v in enumerate(model.labels)]
        small_table(spark, labels, T._parse_datatype_string("label string, label_idx int")).write.parquet(f"{path}/labels")
        write_trees(spark, model.trees, path)
        facts = {"kind": "sentiment", "terms": spark.read.parquet(f"{path}/idf").count(), "labels": len(labels), "id_col": model.id_col, "text": model.text, "out": model.out}
        write_manifest(spark, path, facts | tree_facts(model.trees))


class _SentimentReader(MLReader):
    def load(self, path: str) -> SentimentModel:
        spark = self.sparkSession
        facts = read_manifest(spark, path, "sentiment")
        try:
            idf = spark.read.parquet(f"{path}/idf")
            labels = [r["label"] for r in spark.read.parquet(f"{path}/labels").orderBy("label_idx").collect()]
            counted = idf.count()
        except Exception as error:
            raise ValueError(f"{path}: a part of the model is missing") from error
        if counted != facts["terms"] or len(labels) != facts["labels"]:
            raise ValueError(f"{path}: {counted} of {facts['terms']} terms, {len(labels)} of {facts['labels']} labels")
        return SentimentModel(idf, labels, read_trees(spark, path, facts), facts["id_col"], facts["text"], facts["out"])


FACTS = "kind string, terms long, labels int, nodes long, trees int, classes int, rounds int, id_col string, text string, out string"


def tree_facts(model: BoostedTreesModel) -> dict:
    t = model.trees
    return {"nodes": len(t.left), "trees": len(t.tree), "classes": t.classes, "rounds": t.rounds}


def write_trees(spark: SparkSession, model: BoostedTreesModel, path: str) -> None:
    model.node_table(spark).write.mode("overwrite").parquet(f"{path}/trees")


def read_trees(spark: SparkSession, path: str, facts: Mapping) -> BoostedTreesModel:
    try:
        nodes = spark.read.parquet(f"{path}/trees").limit(MAX_NODES + 1).toPandas().sort_values("node")
    except Exception as error:
        raise ValueError(f"{path}: the trees are missing") from error
    if len(nodes) != facts["nodes"] or nodes["tree"].nunique() != facts["trees"]:
        raise ValueError(f"{path}: {len(nodes)} of {facts['nodes']} nodes")
    return BoostedTreesModel(_trees_of(nodes, facts["classes"], facts["rounds"], nodes.groupby("tree")["node"].min().sort_index().tolist()))


def write_manifest(spark: SparkSession, path: str, facts: Mapping) -> None:
    """The last part: a model without it was not written to the end."""
    schema = T._parse_datatype_string(FACTS)
    small_table(spark, [{n: facts.get(n) for n in schema.names}], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str, kind: str) -> dict:
    try:
        facts = spark.read.parquet(f"{path}/manifest").first().asDict()
    except Exception as error:
        raise FileNotFoundError(f"no whole model under {path}") from error
    if facts["kind"] != kind:
        raise ValueError(f"{path} holds a model of kind {facts['kind']}")
    return facts


def fit_sentiment(train: DataFrame, label_map: DataFrame, idf: DataFrame, stage: ResampleSelectClassifier, text: str = "review", out: str = "predicted") -> SentimentModel:
    """The artefact of a stage fitted on training rows ``(id, label_idx, weights)`` and their idf."""
    fitted = stage.fit(train)
    labels = [r["label"] for r in few_rows(label_map.orderBy("label_idx"), MAX_CLASSES, "labels")]
    return SentimentModel(idf, labels, fitted.trees, stage.idCol, text, out)
