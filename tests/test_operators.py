import collections
import math

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import aspects, dedup, encode, evaluate, features, merge, ranking, sampling, smote
from reviewloom.operators.neighbors import blocked_knn
from reviewloom.operators.skew import join_by_weight
from reviewloom.plans import recommend

GOLDEN = {("negatif", "negatif"): 146, ("negatif", "netral"): 34, ("negatif", "positif"): 19,
          ("netral", "negatif"): 60, ("netral", "netral"): 36, ("netral", "positif"): 28,
          ("positif", "negatif"): 29, ("positif", "netral"): 16, ("positif", "positif"): 280}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- evaluation -------------------------------------------------------------------------------
def golden(spark):
    rows = [(a, p) for (a, p), n in GOLDEN.items() for _ in range(n)]
    return spark.createDataFrame(rows, "a string, p string")


def test_golden_report(spark):
    confusion = evaluate.confusion_matrix(golden(spark), "a", "p")
    assert {(r.actual, r.predicted): r.n for r in confusion.collect()} == GOLDEN
    got = {(r.label, r.metric): r.value for r in evaluate.classification_report(confusion).collect()}
    want = {("accuracy", "accuracy"): 0.7130, ("macro avg", "f1"): 0.6249, ("weighted avg", "f1"): 0.7030,
            ("negatif", "f1"): 0.6728, ("netral", "f1"): 0.3429, ("positif", "f1"): 0.8589,
            ("netral", "precision"): 0.4186, ("negatif", "recall"): 0.7337, ("positif", "support"): 325}
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=5e-5)


def test_macro_evaluator(spark):
    from reviewloom.operators.models import MacroF1Evaluator

    codes = F.array_position(F.array(*[F.lit(c) for c in ("negatif", "netral", "positif")]), F.col("a")) - 1
    guess = F.array_position(F.array(*[F.lit(c) for c in ("negatif", "netral", "positif")]), F.col("p")) - 1
    df = golden(spark).select(codes.alias("label_idx"), guess.cast("double").alias("prediction"))
    assert MacroF1Evaluator().evaluate(df) == pytest.approx(0.6249, abs=5e-5)


def test_absent_class_and_empty_denominator(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "a string, p string")
    report = evaluate.classification_report(evaluate.confusion_matrix(df, "a", "p", ["a", "b", "c"]))
    got = {(r.label, r.metric): r.value for r in report.collect()}
    assert got["c", "f1"] == 0 and got["b", "recall"] == 0 and got["c", "support"] == 0


# --- sampling ---------------------------------------------------------------------------------
def classes(spark, **sizes):
    rows, i = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((i, name))
            i += 1
    return spark.createDataFrame(rows, "id bigint, y string")


def test_hash_rank_equals_row_number(spark):
    from pyspark.sql import Window as W

    from reviewloom.functions.keys import order_hash

    df = classes(spark, a=700, b=40)
    got = ranking.exact_rank_by_hash(df, "y", "id")
    plain = df.withColumn("want", F.row_number().over(W.partitionBy("y").orderBy(order_hash("id"), "id")) - 1)
    assert got.join(plain, "id").filter(F.col("rank") != F.col("want")).count() == 0


def test_undersample_fixture(spark):
    df = classes(spark, positif=2450, negatif=997, netral=625)
    got = collections.Counter(r.y for r in sampling.undersample_majority(df, "y", "positif", "id").collect())
    assert got == {"positif": 1622, "negatif": 997, "netral": 625}
    with pytest.raises(ValueError):
        sampling.undersample_majority(df, "y", "positif", "id", n=3000)
    assert sampling.undersample_majority(df, "y", "positif", "id", n=0).filter("y = 'positif'").count() == 0


def test_split_is_an_exact_partition(spark):
    df = classes(spark, a=101, b=53, c=7)
    out = sampling.stratified_split(df, "y", "id").collect()
    assert sorted(r.id for r in out) == list(range(161))
    test = collections.Counter(r.y for r in out if r.split == "test")
    assert sum(test.values()) == math.ceil(0.2 * 161)
    for name, n in (("a", 101), ("b", 53), ("c", 7)):
        assert abs(test[name] - n * 33 / 161) < 1


@pytest.mark.parametrize("sizes", [dict(a=10, b=4, c=2), dict(a=1, b=1, c=31), dict(a=9)])
def test_folds_are_level(spark, sizes):
    out = sampling.stratified_kfold(classes(spark, **sizes), "y", "id", 3).collect()
    per = collections.Counter((r.y, r.fold) for r in out)
    for name, n in sizes.items():
        counts = [per[name, f] for f in range(3)]
        assert sum(counts) == n and max(counts) - min(counts) <= 1
    total = collections.Counter(r.fold for r in out)
    assert max(total.values()) - min(total.get(f, 0) for f in range(3)) <= 1


def test_placing_rows_does_not_shuffle_them(spark):
    df = sampling.stratified_split(spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("y")), "y", "id")
    assert "Exchange hashpartitioning" not in plan(df) and "SinglePartition" not in plan(df)


# --- duplicates and merge ---------------------------------------------------------------------
def test_dedup_nulls_order_and_idempotence(spark):
    rows = [(3, None, "x"), (1, None, "x"), (2, "u", "x"), (4, "u", None)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    once = dedup.dedup(df, ["a", "b"], ["i"])
    assert sorted(r.i for r in once.collect()) == [1, 2, 4]
    assert dedup.dedup(once, ["a", "b"], ["i"]).count() == 3
    assert dedup.duplicate_count(df, ["a", "b"]).first()[0] == 1


def test_dedup_drops_copies_before_the_exchange(spark):
    text = plan(dedup.dedup(spark.range(10).select("id", (F.col("id") % 3).alias("k")), ["k"], ["id"]))
    limit = text.index("row_number(), 1, Partial")
    assert limit > text.index("Exchange hashpartitioning")  # plans list the input last


def test_merge_keeps_old_rows(spark):
    old = spark.createDataFrame([(9, "k")], "i int, k string")
    new = spark.createDataFrame([(1, "k"), (2, "z"), (3, "z")], "i int, k string")
    assert sorted(r.i for r in merge.merge_append_dedup(old, new, ["k"], ["i"]).collect()) == [2, 9]
    assert merge.merge_append_dedup(None, new, ["k"], ["i"]).count() == 3
    assert merge.merge_stats(old, new, ["k"]).first().asDict() == {"old_rows": 1, "new_rows": 3, "duplicates_removed": 2}
    with pytest.raises(ValueError):
        merge.union_datasets(old, new.withColumn("extra", F.lit(1)))


def test_digest_has_no_boundary_clash(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "-"), ("-", None)], "a string, b string")
    assert dedup.duplicate_count(df, ["a", "b"]).first()[0] == 0


def test_unseen_label_raises(spark):
    codes = encode.fit_label_map(classes(spark, a=1, b=2), "y")
    assert [(r.label, r.label_idx) for r in codes.orderBy("label").collect()] == [("a", 0), ("b", 1)]
    with pytest.raises(Exception, match="unseen label"):
        encode.label_encode(classes(spark, zzz=1), "y", codes).collect()


# --- skew -------------------------------------------------------------------------------------
def test_join_by_weight_covers_hot_and_cold(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    small = big.groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.col("k") * 2)
    joined = join_by_weight(big, small, ["k"], "w", limit=10)
    assert joined.count() == 1000 and joined.filter("v != k * 2").count() == 0


# --- text features ----------------------------------------------------------------------------
DOCS = [(1, "a", "apple pear apple"), (2, "a", "pear plum"), (3, "b", "fig fig fig plum"), (4, "b", "!!")]


def test_tfidf_and_chi2_against_plain_python(spark):
    docs = spark.createDataFrame(DOCS, "id bigint, y string, t string")
    counts = features.term_counts(docs, "id", "t")
    idf = {r.term: r.idf for r in features.tfidf_fit(counts, docs).collect()}
    df = {"apple": 1, "pear": 2, "plum": 2, "fig": 1}
    for term, n in df.items():
        assert idf[term] == pytest.approx(math.log(5 / (1 + n)) + 1)
    tf = features.tfidf_transform(counts, features.tfidf_fit(counts, docs), "id")
    rows = {(r.id, r.term): r.weight for r in tf.collect()}
    for doc in (1, 2, 3):
        assert sum(w * w for (d, _), w in rows.items() if d == doc) == pytest.approx(1.0)
    got = {r.term: r.chi2 for r in features.chi2_scores(tf, docs, "id", "y").collect()}
    for term in df:
        total = sum(w for (_, t), w in rows.items() if t == term)
        want = 0.0
        for y in "ab":
            o = sum(w for (d, t), w in rows.items() if t == term and dict((i, c) for i, c, _ in DOCS)[d] == y)
            want += (o - total / 2) ** 2 / (total / 2)
        assert got[term] == pytest.approx(want)
    assert features.select_k_best(features.chi2_scores(tf, docs, "id", "y"), 99).count() == 4


def test_unseen_terms_are_ignored(spark):
    docs = spark.createDataFrame(DOCS, "id bigint, y string, t string")
    idf = features.tfidf_fit(features.term_counts(docs, "id", "t"), docs)
    new = spark.createDataFrame([(9, "kiwi apple"), (10, "kiwi")], "id bigint, t string")
    out = features.tfidf_transform(features.term_counts(new, "id", "t"), idf, "id").collect()
    assert [(r.id, r.term, r.weight) for r in out] == [(9, "apple", 1.0)]


def test_vectors(spark):
    tf = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.25)], "id bigint, term string, weight double")
    index = spark.createDataFrame([("a", 0), ("b", 3)], "term string, term_idx int")
    vector = features.to_sparse_vectors(tf, index, 5, "id").first()["features"]
    assert vector.toArray().tolist() == [0.25, 0, 0, 0.5, 0]


def test_top_terms_limit_before_exchange(spark):
    df = spark.createDataFrame([("g", "aa bb aa")], "y string, t string")
    out = features.word_frequencies(df, "y", "t", n=1)
    assert [(r.term, r.n) for r in out.collect()] == [("aa", 2)]
    assert "row_number(), 1, Partial" in plan(out)
    pairs = features.word_frequencies(df, "y", "t", ngram=2).collect()
    assert {(r.term, r.n) for r in pairs} == {("aa bb", 1), ("bb aa", 1)}


# --- neighbours and oversampling --------------------------------------------------------------
def brute(rows, k):
    out = {}
    for i, g, v in rows:
        near = sorted((round(math.dist(v, w), 9), j) for j, h, w in rows if h == g and j != i)
        out[i] = [j for _, j in near[:k]]
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_knn_is_exact_with_a_hot_group_of_copies(spark, block):
    import random

    rng = random.Random(7)
    rows = [(i, i % 2, [rng.random(), rng.random()]) for i in range(60)]
    rows += [(100 + i, 0, [0.5, 0.5]) for i in range(40)]  # a third and more are copies of one vector
    df = spark.createDataFrame(rows, "id bigint, y int, v array<double>")
    got = collections.defaultdict(dict)
    for r in blocked_knn(df, "y", "id", "v", 4, block_rows=block).collect():
        got[r.id][r.nn_rank] = r.nn_id
    want = brute(rows, 4)
    assert {i: [n[r] for r in sorted(n)] for i, n in got.items()} == want


def test_sparse_knn_equals_dense(spark):
    words = ["a", "b", "c", "d"]
    rows = [(i, 0, [float((i * 7 + j * 3) % 5) for j in range(4)]) for i in range(25)]
    dense = spark.createDataFrame(rows, "id bigint, y int, v array<double>")
    sparse = spark.createDataFrame(
        [(i, y, [(w, x) for w, x in zip(words, v) if x]) for i, y, v in rows],
        "id bigint, y int, v array<struct<term:string,weight:double>>",
    )
    one = {(r.id, r.nn_rank): r.distance for r in blocked_knn(dense, "y", "id", "v", 3).collect()}
    two = {(r.id, r.nn_rank): r.distance for r in blocked_knn(sparse, "y", "id", "v", 3, sparse=True, block_rows=6).collect()}
    assert one.keys() == two.keys() and all(one[key] == pytest.approx(two[key]) for key in one)


def test_smote_equalises_and_stays_on_segments(spark):
    rows = [(i, 0, [float(i), 1.0]) for i in range(30)] + [(100 + i, 1, [float(i), -2.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "id bigint, y int, v array<double>")
    out = smote.smote(df, "y", "id", "v").collect()
    assert collections.Counter(r.y for r in out) == {0: 30, 1: 30}
    assert len({r.row_id for r in out}) == 60
    for r in out:
        if r.synthetic:
            assert r.y == 1 and r.v[1] == -2.0 and 0.0 <= r.v[0] <= 3.0
    with pytest.raises(ValueError, match="no neighbour"):
        smote.smote(df.filter("id < 101"), "y", "id", "v")


# --- aspects and ranking ----------------------------------------------------------------------
def test_aspects_match_substrings(spark):
    df = spark.createDataFrame([(1, "Orangnya ramah, PANAS saat cas"), (2, ""), (3, None)], "id int, t string")
    inline = aspects.aspect_tag(df, "t").orderBy("id").collect()
    assert inline[0].keywords == ["cas", "mah", "panas", "panas saat cas", "ram"]
    assert inline[0].aspects == ["performa", "baterai"]
    word = aspects.aspect_tag(df, "t", mode="word").orderBy("id").first()
    assert "ram" not in word.keywords


@pytest.mark.parametrize("mode", ["substring", "word"])
def test_keywords_against_plain_search(spark, mode):
    import re

    lexicon = {"a": ["ram", "rambu", "tahan", "tahan lama", "cas", "cepat", "cepat habis", "panas", "panas saat cas", "type-c"], "b": ["hz", "4k", "c++", "😀", "é", "(x)"], "c": [], "d": ["x y"]}
    lexicon["e"] = [f"kata{i}tak" for i in range(300)]
    rows = [
        ("Ramah RAM tahan lama type-c", "kipas rambu"), ("tahanlama casing cas panas saat cas", ""), ("", None), (None, "ram"), ("4kx hz c++ fhdram 😀jam (X)", "cepat habis"),
        ("cepat", "habis"), ("cepat habisx É kata7tak kata77", "xx yy"), ("cepatcepat habis", "kata299tak"),
    ]
    words = sorted({w for group in lexicon.values() for w in group})
    for row in aspects.aspect_tag(spark.createDataFrame(rows, "t string, p string"), "t", lexicon, "p", mode).collect():
        texts = [(row.t or "").lower(), row.p or ""]
        pattern = (lambda w: re.escape(w)) if mode == "substring" else (lambda w: rf"(?<!\w){re.escape(w)}(?!\w)")
        assert row.keywords == [w for w in words if any(re.search(pattern(w), t) for t in texts)]
        assert row.aspects == [a for a, group in lexicon.items() if set(group) & set(row.keywords)]


def test_ties_take_lexicon_order_and_products_without_aspects(spark):
    lexicon = {"one": ["x"], "two": ["y"], "none": ["q"]}
    df = spark.createDataFrame(
        [("p", "x y", "positif"), ("p", "x y", "negatif"), ("r", "zzz", "positif")], "product string, review string, sentiment string"
    )
    out = {r["product"]: r for r in recommend.score_products(df, ["product"], lexicon=lexicon).collect()}
    assert out["p"].description == "Produk ini sangat unggul pada aspek ONE. Namun, pengguna sering mengeluhkan ONE."
    assert out["p"].aspect_scores == {"one": 50.0, "two": 50.0, "none": 0.0}
    assert out["r"].description.startswith("Ulasan umum") and out["r"].general_score == 100.0
    best = aspects.best_worst_aspect(aspects.aspect_scores(aspects.aspect_stats(aspects.aspect_tag(df, "review", lexicon), ["product"], lexicon)), ["product"])
    assert [(r.best_aspect, r.worst_aspect) for r in best.collect()] == [("one", "one")]


def test_rank_is_stable_on_request_order(spark):
    rows = [("q", i, s) for i, s in enumerate([50.0, 80.0, 80.0, 10.0])]
    df = spark.createDataFrame(rows, "request_id string, candidate_order int, general_score double")
    ranks = {r.candidate_order: r["rank"] for r in recommend.rank_products(df, "request_id", "candidate_order").collect()}
    assert ranks == {1: 1, 2: 2, 0: 3, 3: 4}


def test_bad_candidates_do_not_stop_a_request(spark):
    reviews = spark.createDataFrame([("q", "u2", "ok", "positif")], "request_id string, url string, review string, sentiment string")
    cands = spark.createDataFrame([("q", 0, "first", "u1"), ("q", 1, "second", "u2")], "request_id string, candidate_order int, name string, url string")
    out = recommend.recommend(reviews, cands).collect()
    assert [(r.name, r.winning_product) for r in out] == [("second", "second")]
    nested = recommend.responses(recommend.recommend(reviews, cands)).first()
    assert nested.winning_product == "second" and len(nested.details) == 1


def test_terms_are_counted_in_the_row_as_by_grouping(spark):
    from reviewloom.operators import features as X

    texts = ["b a b_1 a, A", "", None, "x y", "zz", "çé ab ab çé ab 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id int, review string")
    own = df.select("review_id", F.inline(X.count_array("review")))
    assert sorted(own.collect()) == sorted(X.term_counts(df, "review_id", "review").collect())
    assert [r.term for r in own.filter("review_id = 5").collect()] == ["12", "ab", "çé"]


@pytest.mark.parametrize("twice", [False, True])
def test_matrix_is_the_same_by_either_way_and_gathers_pairs_once(spark, monkeypatch, twice):
    from reviewloom.plans import training as P

    rows = [(i, "train" if i % 4 else "test", "pn"[i % 2], "" if i == 5 else f"common word{i % 7} word{i % 3} only{i}") for i in range(40)]
    split = spark.createDataFrame(rows + (rows[-1:] if twice else []), "id int, split string, label string, text string")
    made = P.build_matrix(split, "label", "id", "text")
    monkeypatch.setattr(P.features, "unique_ids", lambda df, id_col: False)
    plain = P.build_matrix(split, "label", "id", "text")
    assert (made.rows is None) == twice and plain.rows is None

    def shown(weights):
        return {(r.id, r.split, r.label, r.term, round(r.weight, 9)) for r in weights.collect()}

    assert shown(made.weights) == shown(plain.weights) == shown(made.kept().weights)
    packed = [sorted((r.id, r.split, [(e.term, round(e.weight, 9)) for e in r.weights]) for r in (m.rows if m.rows is not None else P.entry_rows(m.docs, m.weights.drop("split"), "id")).collect()) for m in (made, plain)]
    assert packed[0] == packed[1]


def test_prepared_texts_are_not_shuffled(spark, monkeypatch):
    from reviewloom.plans import recommend as P

    seen = []
    rows = spark.createDataFrame([(1, "yang layar bagus")], "review_id long, review string")
    monkeypatch.setattr(P, "label_reviews", lambda tagged, model, text: seen.append(tagged.columns) or tagged.selectExpr("*", "'positif' AS predicted", "0.5D AS confidence"))
    got = P.score_raw_reviews(rows, type("M", (), {"out": "predicted"})(), lexicon={"a": ["layar"]}).first()
    assert seen == [["review_id", "review", "keywords", "aspects"]]
    assert (got["keywords"], got["confidence"]) == (["layar"], 0.5)
