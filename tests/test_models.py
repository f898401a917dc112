"""Boosted trees against a plain reading of the rules, bounded fits, search, and the serving artefact."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import boosting as B
from reviewloom.operators import models as M
from reviewloom.operators.encode import fit_label_map, label_encode
from reviewloom.operators.features import term_counts, tfidf_fit, tfidf_transform
from reviewloom.plans.training import entry_rows
from reviewloom.session import cut_lineage
from reviewloom.sources import models as stored


def plain_tree(rows, g, h, depth, rate):
    """Leaf value of every row: every cut of every feature is tried on every node, absent rows on both sides."""

    def score(ids):
        gs, hs = sum(g[i] for i in ids), sum(h[i] for i in ids)
        return gs * gs / (hs + B.LAMBDA), hs

    def grow(ids, level):
        best = (B.LEAST_GAIN, None)
        if level < depth:
            whole = score(ids)[0]
            for f in sorted({f for i in ids for f in rows[i]}):
                there = sorted({rows[i][f] for i in ids if f in rows[i]})
                for low in there:
                    for absent_left in (False, True):
                        left = [i for i in ids if (rows[i][f] <= low if f in rows[i] else absent_left)]
                        right = [i for i in ids if i not in set(left)]
                        if not left or not right:
                            continue
                        (a, ha), (b, hb) = score(left), score(right)
                        if ha >= B.LEAST_CHILD - 1e-12 and hb >= B.LEAST_CHILD - 1e-12 and a + b - whole > best[0] + 1e-9:
                            best = (a + b - whole, (left, right))
        if best[1] is None:
            gs, hs = sum(g[i] for i in ids), sum(h[i] for i in ids)
            return {i: -gs / (hs + B.LAMBDA) * rate for i in ids}
        return {**grow(best[1][0], level + 1), **grow(best[1][1], level + 1)}

    return grow(list(range(len(rows))), 0)


def sample(n, seed):
    rnd = random.Random(seed)
    labels = [rnd.choice((0, 0, 1, 2)) for _ in range(n)]
    rows = [{f: round(rnd.random() + 0.01, 3) for f in range(12) if rnd.random() < (0.6 if f % 3 == y else 0.25)} for y in labels]
    return rows, np.array(labels)


def sparse(rows):
    return B.Sparse.of([np.array(list(r), dtype=np.int64) for r in rows], [np.array(list(r.values())) for r in rows])


@pytest.mark.parametrize("seed", range(4))
def test_trees_equal_a_plain_search(seed):
    rows, labels = sample(40, seed)
    params = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.5}
    margin = np.zeros((40, 3))
    for _ in range(3):
        share, step = B.probabilities(margin), np.zeros((40, 3))
        for c in range(3):
            p = share[:, c]
            found = plain_tree(rows, p - (labels == c), 2 * p * (1 - p), 3, 0.5)
            step[:, c] = [found[i] for i in range(40)]
        margin += step
    trees = B.fit(sparse(rows), labels, 3, params)
    assert np.allclose(trees.margins(sparse(rows)), margin, atol=1e-9)


def test_first_rounds_are_the_short_fit_and_threads_change_nothing():
    rows, labels = sample(120, 9)
    data = sparse(rows)
    settings = {"max_depth": 4, "subsample": 0.8, "colsample_bytree": 0.8, "learning_rate": 0.2}
    long = B.fit(data, labels, 3, {**settings, "n_estimators": 12})
    short = B.fit(data, labels, 3, {**settings, "n_estimators": 5}, threads=3)
    assert np.array_equal(long.margins(data, 5), short.margins(data))
    assert not np.array_equal(long.margins(data, 5), long.margins(data))


def test_odd_training_rows():
    empty = B.Sparse.of([], [])
    assert B.fit(empty, np.zeros(0, dtype=int), 3, {"n_estimators": 2}).margins(sparse([{1: 0.5}, {}])).tolist() == [[0, 0, 0]] * 2
    blank = B.fit(sparse([{}] * 9), np.array([0, 0, 0, 1, 1, 1, 1, 1, 1]), 2, {"n_estimators": 5})
    assert (blank.margins(sparse([{}, {7: 1.0}])).argmax(axis=1) == 1).all()
    alone = B.fit(sparse([{1: 0.5}] * 5), np.zeros(5, dtype=int), 1, {"n_estimators": 2})
    assert B.probabilities(alone.margins(sparse([{}]))).tolist() == [[1.0]]
    same = B.fit(sparse([{1: 0.5, 2: 0.1}] * 30), np.array([0, 1] * 15), 2)  # equal rows of two labels
    assert np.allclose(B.probabilities(same.margins(sparse([{1: 0.5, 2: 0.1}]))), 0.5)


WORDS = {"positif": "bagus cepat mantap puas", "negatif": "rusak lambat kecewa jelek", "netral": "biasa standar lumayan cukup"}


@pytest.fixture(scope="module")
def trained(spark):
    rnd, rows = random.Random(1), []
    for i in range(240):
        label = rnd.choices(list(WORDS), (6, 2, 1))[0]
        rows.append((i, label, " ".join(rnd.choices(WORDS[label].split(), k=3) + rnd.choices("layar baterai harga toko kirim barang".split(), k=4)) + f" kode{i}"))
    reviews = cut_lineage(spark.createDataFrame(rows, "review_id bigint, sentiment string, review string"))
    counts = cut_lineage(term_counts(reviews, "review_id", "review"))
    idf = cut_lineage(tfidf_fit(counts, reviews))
    weights = tfidf_transform(counts, idf, "review_id")
    label_map = cut_lineage(fit_label_map(reviews, "sentiment"))
    packed = cut_lineage(label_encode(entry_rows(reviews.select("review_id", "sentiment"), weights, "review_id"), "sentiment", label_map))
    return reviews, idf, label_map, packed


def test_bounded_rows_keep_every_class_at_its_share(spark, trained):
    packed = trained[3]
    sizes = {r["label_idx"]: r["count"] for r in packed.groupBy("label_idx").count().collect()}
    some = {r["label_idx"]: r["count"] for r in M.bounded_rows(packed, "label_idx", "review_id", 60).groupBy("label_idx").count().collect()}
    assert sum(some.values()) == 60 and all(abs(some[c] - 60 * n / 240) < 1 for c, n in sizes.items())
    assert M.bounded_rows(packed, "label_idx", "review_id", 240).count() == 240


def test_every_term_takes_part_unless_k_is_given(trained):
    packed = trained[3]
    assert M.train_baseline(packed, {"n_estimators": 2}).size is None
    assert M.ResampleSelectClassifier().getOrDefault("k") == 2000
    ten = M.train_baseline(packed, {"n_estimators": 2}, k=10)
    assert ten.size == 10
    names = {r[0] for r in packed.sparkSession.createDataFrame([(t,) for t in ten.terms], "t string").select(F.xxhash64("t")).collect()}
    assert set(ten.trees.trees.used().tolist()) <= names


def test_search_has_every_point_and_finds_a_good_one(spark, trained):
    grid = {"learning_rate": [0.01, 0.3], "max_depth": [2], "n_estimators": [2, 30]}
    search = M.grid_search(trained[3], grid, search_rows=150)
    table = M.best_params(spark, search).orderBy("rank").collect()
    assert len(table) == 4 and len({tuple(sorted(r["params"].items())) for r in table}) == 4
    assert [r["macro_f1"] for r in table] == sorted((r["macro_f1"] for r in table), reverse=True)
    assert search.best["learning_rate"] == 0.3 and table[0]["macro_f1"] > 0.9
    assert search.bestModel.transform(trained[3]).filter("prediction = label_idx").count() > 220
    both = M.grid_search(trained[3], grid, estimator=M.ResampleSelectClassifier(k=12), search_rows=100)
    assert len(both.scores) == 4 and both.bestModel.size == 12


@pytest.fixture(scope="module")
def served(trained):
    reviews, idf, label_map, packed = trained
    return M.fit_sentiment(packed, label_map, idf, M.ResampleSelectClassifier(classifier=M.boosted_trees({"n_estimators": 20}), k=None, resample=False))


def labels_of(model, rows):
    return {r["review_id"]: (r["predicted"], r["confidence"]) for r in model.score(rows).collect()}


def test_raw_text_to_label_and_confidence(spark, trained, served):
    reviews, idf, label_map, packed = trained
    found = labels_of(served, reviews)
    wanted = {r["review_id"]: r["sentiment"] for r in reviews.collect()}
    assert sum(found[i][0] == wanted[i] for i in wanted) > 225
    assert all(1 / 3 <= c <= 1 for _, c in found.values()) and len({round(c, 6) for _, c in found.values()}) > 5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "zzz qqq"), (4, "BAGUS cepat, mantap!")], "review_id bigint, review string")
    odd_found = labels_of(served, odd)
    assert len({odd_found[i] for i in (1, 2, 3)}) == 1 and odd_found[4][0] == "positif"  # no known term: all alike


def test_scores_by_hand(spark, trained, served):
    """Weights, norm and margins of one review, worked out without the plan."""
    reviews, idf, _, _ = trained
    known = {r["term"]: r["idf"] for r in idf.collect()}
    text = "bagus bagus layar kode7 takdikenal"
    rows = spark.createDataFrame([(1, text)], "review_id bigint, review string")
    terms = {t: text.split().count(t) * known[t] for t in set(text.split()) if t in known}
    norm = math.sqrt(sum(w * w for w in terms.values()))
    names = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    share = B.probabilities(served.trees.trees.margins(sparse([{names[t]: w / norm for t, w in terms.items()}])))[0]
    found = labels_of(served, rows)[1]
    assert found[0] == served.labels[int(share.argmax())] and found[1] == pytest.approx(share.max(), abs=1e-12)


def test_loaded_is_fitted_and_incomplete_models_do_not_load(spark, trained, served, tmp_path):
    path = str(tmp_path / "model")
    stored.save_model(served, path)
    stored.save_model(served, path)  # written over
    assert labels_of(stored.load_model(path), trained[0]) == labels_of(served, trained[0])
    with pytest.raises(Exception, match="(?i)exist"):
        served.write().save(path)
    with pytest.raises(FileNotFoundError):
        stored.load_model(str(tmp_path / "none"))
    for part in ("idf", "labels", "trees", "manifest"):
        broken = str(tmp_path / f"without-{part}")
        stored.save_model(served, broken)
        os.rename(f"{broken}/{part}", f"{broken}/_{part}")
        with pytest.raises((ValueError, FileNotFoundError)):
            stored.load_model(broken)
    short = str(tmp_path / "short")
    stored.save_model(served, short)
    spark.read.parquet(f"{path}/idf").limit(3).write.mode("overwrite").parquet(f"{short}/idf")
    with pytest.raises(ValueError, match="3 of"):
        stored.load_model(short)


def test_the_winner_follows_the_model(spark, served):
    from reviewloom.plans.recommend import recommend, score_raw_reviews

    good, bad = "bagus cepat mantap puas", "rusak lambat kecewa jelek"
    reviews = [(1, "r", "a", good), (2, "r", "a", bad), (3, "r", "b", good), (4, "r", "b", good), (5, "r", "b", None), (6, "q", "a", bad)]
    frame = spark.createDataFrame(reviews, "review_id bigint, request_id string, url string, review string")
    candidates = spark.createDataFrame([("r", 0, "A", "a"), ("r", 1, "B", "b"), ("q", 0, "A", "a"), ("q", 1, "C", "c")], "request_id string, candidate_order int, name string, url string")
    rows = {(r["request_id"], r["url"]): r for r in recommend(frame, candidates, model=served).collect()}
    assert rows["r", "a"]["winning_product"] == "B" and rows["q", "a"]["winning_product"] == "A" and ("q", "c") not in rows
    assert rows["r", "a"]["general_score"] == 50.0 and rows["r", "b"]["positive_count"] >= 2
    # "cepat" is found in raw text; "lambat" tags nothing, "kecewa" neither.
    scored = {r["review_id"]: r for r in score_raw_reviews(frame, served).collect()}
    assert scored[1]["stored_sentiment"] == "POSITIVE" and scored[2]["stored_sentiment"] == "NEGATIVE" and scored[1]["keywords"] == ["cepat"]


def test_all_rows_are_fitted_and_searched(spark, monkeypatch):
    """The value of a single leaf tells how many rows it was fitted on."""
    rows = spark.range(3000).select(F.col("id").alias("review_id"), (F.col("id") % 10 > 6).cast("int").alias("label_idx"), F.array().cast("array<struct<term:string,weight:double>>").alias("weights"))
    leaf = M.BoostedTrees({"n_estimators": 1}).fit(rows).trees.value
    assert np.allclose(leaf, [0.3 * 600 / 1501, -0.3 * 600 / 1501])  # half of 3,000 is both the expected rows of a class and the sum of second derivatives
    seen = []
    real = M._scores_apart
    monkeypatch.setattr(M, "_scores_apart", lambda parts, *rest: [seen.append([p.count() for p in parts]), real(parts, *rest)][1])
    M.grid_scores(rows.withColumn("fold", F.col("review_id") % 3), {"n_estimators": [1]}, M.ResampleSelectClassifier(k=None, resample=False), "fold", 3)
    assert seen == [[3000] * 3]


@pytest.mark.parametrize("params", [{"n_estimators": 4}, {"n_estimators": 4, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8}])
def test_tasks_together_fit_what_one_task_fits(trained, monkeypatch, params):
    packed = trained[3]
    one = M.BoostedTrees(params).fit(packed).trees
    calls = []
    monkeypatch.setattr(M, "TASK_ENTRIES", 400)
    monkeypatch.setattr(M, "term_columns", lambda *a, real=M.term_columns: [calls.append(a[3]), real(*a)][1])
    many = M.BoostedTrees(params).fit(packed).trees
    assert calls and calls[0] > 1
    for column in ("tree", "feature", "threshold", "absent_left", "left", "right", "value"):
        assert np.allclose(getattr(one, column), getattr(many, column), atol=1e-9), column


def test_a_search_by_all_tasks_together_scores_the_same(trained, monkeypatch):
    grid = {"max_depth": [2, 4], "subsample": [0.8], "colsample_bytree": [0.8], "n_estimators": [2, 6]}
    stage = M.ResampleSelectClassifier(k=None, resample=False)
    apart = M.grid_scores(trained[3], grid, stage, "fold", 3)
    monkeypatch.setattr(M, "SEARCH_ENTRIES", 0)
    monkeypatch.setattr(M, "_scores_apart", None)
    together = M.grid_scores(trained[3], grid, stage, "fold", 3)
    assert [(pytest.approx(s), p) for s, p in apart] == together


def test_held_rows_get_the_margins_of_a_fit_without_them():
    rows, labels = sample(150, 5)
    data, held = sparse(rows), np.arange(150) % 4 == 1
    settings = {"n_estimators": 6, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8}
    trees, margins = B.fit_and_hold(data, labels, 3, settings, held=held, stops=[2, 6])
    alone = B.fit(sparse([r for r, out in zip(rows, held) if not out]), labels[~held], 3, settings)
    out = sparse([r for r, away in zip(rows, held) if away])
    assert np.allclose(margins[2], alone.margins(out, 2)) and np.allclose(margins[6], alone.margins(out)) and np.array_equal(trees.feature, alone.feature)
