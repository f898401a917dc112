import re

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import labels as L
from reviewloom.functions import text as X


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).first()["y"]


TEXTS = ["Bagus, 5* banget!!", "   Ada   spasi\n", "Über_Café №5 — ok", "123", "", "áb ٣٤", "tab\there\x1c "]


@pytest.mark.parametrize("text", TEXTS)
def test_clean_text_is_python_unicode_cleaning(spark, text):
    want = re.sub(r"\d+", "", re.sub(r"[^\w\s]", "", text)).lower().strip()
    assert one(spark, text, X.clean_text) == want


@pytest.mark.parametrize(
    "name,clean,brand",
    [
        ("【A】 Brand X", "Brand X", ""),
        ("【A B】Brand", "Brand", "【A"),
        ("   ", "", "Unknown"),
        ("Acer Aspire 5【promo】", "Acer Aspire 5", "Acer"),
        ("【a】x【b】", "x", "x"),
    ],
)
def test_names(spark, name, clean, brand):
    assert one(spark, name, X.clean_product_name) == clean
    assert one(spark, name, X.derive_brand) == brand


def test_stopwords_keep_order_and_empty_tokens(spark):
    kept = one(spark, "saya dan  kamu yang pergi", lambda c: X.remove_stopwords(c))
    assert kept == " kamu pergi"


@pytest.mark.parametrize(
    "word,stem",
    [
        ("bukunya", "buku"), ("membacakan", "baca"), ("menyapu", "sapu"), ("memukul", "pukul"), ("dibeli", "beli"),
        ("pergilah", "pergi"), ("bermain", "main"), ("ram", "ram"), ("Bukunya, dibeli!", "buku beli"),
    ],
)
def test_stem_rules(spark, word, stem):
    assert one(spark, word, X.stem_text) == stem


def test_serving_and_training_agree_when_cleaning_first(spark):
    text = "Layarnya BAGUS, 100% jernih!"
    serve = one(spark, text, lambda c: X.preprocess_serve(c, clean=True))
    train = one(spark, text, lambda c: X.preprocess_train(X.clean_text(c)))
    assert serve == train


@pytest.mark.parametrize(
    "rating,label",
    [("5", "positif"), ("4", "positif"), ("4.0", "positif"), ("3.5", "negatif"), ("3", "netral"), ("1", "negatif"), ("abc", None), (None, None)],
)
def test_rating_to_sentiment(spark, rating, label):
    assert one(spark, rating, L.rating_to_sentiment) == label


def test_round_is_half_even(spark):
    assert one(spark, 6.25, L.round_score, "double") == 6.2


@pytest.mark.parametrize("pct,label", [(80.0, 1), (80.1, 0), (60.0, 2), (60.5, 1), (0.0, 2)])
def test_verdict_thresholds_are_strict(spark, pct, label):
    from reviewloom.constants import VERDICT_LABELS

    assert one(spark, pct, L.verdict_label, "double") == VERDICT_LABELS[label]


def test_tokens(spark):
    assert one(spark, "A bc, d_e é1 x", X.token_array) == ["bc", "d_e", "é1"]


def test_text_expressions_do_not_shuffle(spark):
    df = spark.range(5).select(F.col("id").cast("string").alias("x")).select(X.preprocess_train(X.clean_text("x")))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_prepared_texts_have_the_stems_of_the_expressions(spark, monkeypatch):
    affixes = ["", "me", "meny", "mem", "peng", "per", "ber", "di", "ter", "ke"]
    ends = ["", "i", "an", "kan", "nya", "kah", "kannya", "ilah"]
    words = [a + root + e for a in affixes for root in ("tulis", "apu", "kata", "a") for e in ends]
    texts = [None, "", " yang  di \n", "Yang, TULISANNYA! İa ß-9", *[" ".join(words[i::7]) for i in range(7)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = X.stem_text(X.remove_stopwords(X.lower_text("t")))
    for limit in (X.STEMS, 40):  # fewer words are remembered than a text has
        monkeypatch.setattr(X, "STEMS", limit)
        X._stems.clear()
        rows = df.select(X.preprocess_serve("t").alias("got"), plain.alias("want")).collect()
        assert [r["got"] for r in rows] == [r["want"] for r in rows]
        assert [X._prepared(w, frozenset()) for w in words] == [X.stem_word(w) for w in words] and len(X._stems) <= limit
    assert X.stem_word("mempekerjakan") == df.limit(1).select(F.array_join(X.stem_tokens(F.array(F.lit("mempekerjakan"))), "")).first()[0]
