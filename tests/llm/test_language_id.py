"""Language identification: hashing, training, rejection, and held-out accuracy."""

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
from reviewloom.llm import language_id as L  # noqa: E402


def test_grams_of_a_word_do_not_depend_on_what_surrounds_it():
    alone = np.sort(L.piece_grams("Haus"))
    assert (np.sort(L.piece_grams("  haus!! 12")) == alone).all()
    assert len(alone) == 4 + 5 + 4 + 3  # letters; pairs, triples and fours with the boundaries
    assert len(L.piece_grams("123 !? ")) == 0


def test_long_texts_are_read_whole(monkeypatch):
    text = "eins zwei drei " * 50
    whole = np.concatenate(list(L.pieces(text)))
    monkeypatch.setattr(L, "PIECE", 45)
    assert sorted(whole.tolist()) == sorted(np.concatenate(list(L.pieces(text))).tolist())


def test_rejection_threshold():
    p = np.array([[0.9, 0.1], [0.8, 0.2], [0.3, 0.7], [0.55, 0.45]])
    assert L.rejection(p, np.array([0, 0, 1, 0])) == 0.0  # nothing is wrong
    assert 0.45 < L.rejection(p, np.array([0, 0, 1, 1])) <= 0.5  # never above one half


def test_held_out_accuracy(spark, sf_dir):
    found = L.op1_language_id(spark, sf_dir)
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = found.join(langs, "doc_id").filter("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert right >= 0.95 * len(rows) and not any(r["rejected"] for r in rows)
