"""Every operator and the pipeline on odd rows and on empty tables."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from reviewloom.llm import registry  # noqa: E402

WORDS = "the quick brown fox jumps over the lazy dog while seven old sailors drink cold tea near a green harbour wall"
ODD = [
    (1, WORDS, "en", "a"),
    (1, WORDS, "en", "a"),  # a repeated row
    (2, WORDS, "en", "b"),
    (3, WORDS.upper().replace(" ", "  "), "en", None),
    (4, None, "en", "a"),
    (5, "", None, "a"),
    (6, " \t\n ", "de", "a"),
    (7, "12 34 +1 (243) 555-5526 x@y.com 4111111111111111 10.0.0.1", None, None),
    (8, "der alte mann und das meer sind nicht weit von hier entfernt", "de", "c"),
    (9, "der junge mann und der see sind nicht sehr weit von dort entfernt", "de", "c"),
    (None, "no id here but a text of some words", "en", "b"),
    (None, "no id here but a text of some words", "en", "b"),
    (10, "日本語 😀 \u0001 text", "ja", "b"),
    (11, "word " * 30_000, "en", "c"),
    (12, "x" * 60_000, "en", "c"),
    (13, "released under the mit license.\nYou idiot, what a l-o-s-e-r.", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def write(spark, path, rows, labels, benchmark):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("size", "key", "fp", "shard", "level", "_text", "component_id", "taken", "_tag"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    # Of each document a conversation of one turn, by the document's id.
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.col("lang").alias("role"), "text", F.lit("clash").alias("depth"))
    turns.write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    labels = [(1, 1, 0), (1, 1, 1), (2, 1, None), (None, 0, 1), (8, 1, 0), (13, 0, 1), (99, 1, 1)]
    benchmark = [(1, None), (2, ""), (3, "two words"), (4, " ".join(WORDS.split()[2:12])), (None, "der alte mann und das meer sind nicht weit")]
    return write(spark, tmp_path_factory.mktemp("odd") / "t", ODD, labels, benchmark)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none") / "t", [], [], [])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty_dir, name):
    assert registry.queries()[name](spark, empty_dir).count() == 0


PER_ROW = ["op1_language_id", "op2_personal_data", "op4_toxicity", "op5_mixing", "op6_exact_dedup", "op7_sharding", "op8_token_output", "op9_simhash", "op11_secrets"]


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_document(spark, odd_dir, name):
    rows = registry.queries()[name](spark, odd_dir).select("doc_id").collect()
    assert sorted(str(r[0]) for r in rows) == sorted(str(r[0]) for r in ODD)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_of_odd_rows(spark, odd_dir):
    found = by_id(registry.queries()["op1_language_id"](spark, odd_dir))
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 and found[i]["rejected"] for i in (4, 5, 6))
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_exact_groups_of_odd_rows(spark, odd_dir):
    found = by_id(registry.queries()["op6_exact_dedup"](spark, odd_dir))
    assert found[2]["keep_id"] == 1 and found[2]["group_size"] == 3 and not found[2]["kept"] and found[1]["kept"]
    assert {found[i]["keep_id"] for i in (4, 5, 6)} == {6} and found[4]["group_size"] == 3
    assert found[None]["keep_id"] is None and found[None]["group_size"] == 2


def test_components_of_odd_rows(spark, odd_dir):
    found = by_id(registry.queries()["op9_simhash"](spark, odd_dir))
    assert {found[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert {found[i]["fingerprint"] for i in (4, 5, 6)} == {"0" * 16} and found[5]["component_id"] == 4
    assert found[None]["component_id"] is None


def test_benchmark_of_odd_rows(spark, odd_dir):
    found = {(r["doc_id"], r["item_id"]) for r in registry.queries()["op3_decontaminate"](spark, odd_dir).collect()}
    assert found == {(1, 4), (2, 4), (3, 4), (8, None)}


def test_licences_of_odd_rows(spark, odd_dir):
    found = registry.queries()["op10_licenses"](spark, odd_dir).collect()
    assert [(r["doc_id"], r["licenses"]) for r in found] == [(13, "MIT")]


def test_secrets_of_odd_rows(spark, odd_dir):
    found = by_id(registry.queries()["op11_secrets"](spark, odd_dir))
    assert found[4]["spans"] == found[5]["spans"] == "" and found[7]["n_hex"] == 1 and found[12]["spans"] == ""


def test_words_of_odd_rows(spark, odd_dir):
    found = {r["word"]: r for r in registry.queries()["op12_spelling"](spark, odd_dir).collect()}
    assert found["brown"]["root"] == "brown" and found["brown"]["n"] >= 3 and "word" not in found


def test_trie_of_odd_rows(spark, odd_dir):
    rows = registry.queries()["op13_prefix_trie"](spark, odd_dir).collect()
    root = [r for r in rows if r["depth"] == 0]
    assert len(root) == 1 and root[0]["n_convs"] == 13 and root[0]["conv_id"] == 1 and root[0]["parent_conv_id"] is None


def test_pipeline_of_odd_rows(spark, odd_dir):
    rows = registry.queries()["pipeline"](spark, odd_dir).collect()
    ids = {r["doc_id"] for r in rows}
    assert not ids & {4, 5, 6} and not ids & {1, 2, 3, 8}  # without a letter; with benchmark items
    assert ids <= {7, 9, None, 10, 11, 12, 13}
    assert sorted(r["slot"] for r in rows if r["shard"] == rows[0]["shard"])[0] == 0


def test_stages_keep_the_columns(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd_dir).columns == corpus_pipeline.COLUMNS
