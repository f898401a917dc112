"""Edited, partial and re-parameterised benchmark items."""

import pytest

pytest.importorskip("corpus_pipeline")
from reviewloom.llm import decontaminate as D  # noqa: E402

ITEM = "Alice buys 25 apples for the school party and each of the apples costs 3 dollars how much does Alice pay in total for all of them"
SHORT = "a train leaves the northern station at noon and travels towards the coast"
LONG = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(59))
FOUND = {
    "changed": (2, SHORT.replace("noon", "midnight")),
    "inserted": (2, SHORT.replace("at noon", "at about noon")),
    "dropped": (2, SHORT.replace("northern ", "")),
    "partial": (3, " ".join(LONG.split()[10:40])),
    "decimal": (1, ITEM.replace("25", "3.5").replace("costs 3", "costs 12")),
    "thousands": (1, ITEM.replace("25", "1,000")),
    "number words": (1, ITEM.replace("25", "twenty five").replace("costs 3", "costs one hundred and seven")),
    "hyphen": (1, ITEM.replace("25", "twenty-six")),
    "two names": (1, ITEM.replace("Alice", "John Paul")),
    "unknown name": (1, ITEM.replace("Alice", "Tariq")),
    "attached unit": (4, "a parcel of 7kg is sent over a distance of 30km by an old lorry to the next town"),
    "separate unit": (4, "a parcel of 7.5 grams is sent over a distance of nine miles by an old lorry to the next town"),
}
CLEAN = ["the school party and each of the guests costs a lot", "a train leaves the old hall and nobody gets to the sea", "", None,
         ITEM.replace("Alice pay", "Bob pay")]  # one name of the item stands for two


def test_edited_items_are_found(spark):
    items = [(1, ITEM), (2, SHORT), (3, LONG), (4, "a parcel of 5kg is sent over a distance of 20km by an old lorry to the next town")]
    texts = [f"Some words in front, {t}. And others behind it." for _, t in FOUND.values()] + CLEAN
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = {(r["doc_id"], r["item_id"]) for r in D.occurrences(docs, benchmark).collect()}
    names = list(FOUND)
    assert {(names[d] if d < len(names) else CLEAN[d - len(names)], i) for d, i in rows} == {(n, i) for n, (i, _) in FOUND.items()}


def test_template_and_words_agree(spark):
    texts = ["Alice Bob paid 3.5 or 1,000 dollars", "x_y 5kg twenty-five, 7 8", "mp3 one hundred and two km/h", ""]
    row = spark.createDataFrame([(t,) for t in texts], "t string").select(D.template(D.F.col("t")).alias("t"), D.words(D.F.col("t")).alias("w")).collect()
    assert [" ".join(r["t"]) for r in row] == ["<name> paid <num> or <num> <unit>", "x y <num> <unit> <num>", "mp3 <num> <unit> h", ""]
    assert all(len(r["t"]) == len(r["w"]) for r in row)
