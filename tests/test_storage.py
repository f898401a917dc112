import os

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import models as M
from reviewloom.operators import store as S
from reviewloom.sources import csv, matrix, models, tables
from reviewloom.streaming.ingest import BATCH, BUCKET, KEY, stream_ingest_reviews


def test_csv_round_trip_keeps_line_breaks_quotes_and_bom(spark, tmp_path):
    row = ("u", "n", 'line\n"quoted", é', "", "5", "d", "positif")
    df = spark.createDataFrame([row], csv.REVIEW_SCHEMA)
    for bom in (False, True):
        path = str(tmp_path / f"c{bom}")
        csv.write_reviews_csv(df, path, bom=bom)
        back = csv.read_reviews_csv(spark, path).first()
        assert back.Review == row[2] and back.Cleaned_Review is None and back.Source_URL == "u"


@pytest.mark.parametrize("header,want", [("note,Link", ["http://b"]), ("first,second", ["http://a"])])
def test_url_column(spark, tmp_path, header, want):
    path = tmp_path / "u.csv"
    path.write_text(f"{header}\nhttp://a,http://b\nx,ftp://c\n,\n")
    assert [r.url for r in csv.load_url_list(spark, str(path)).collect()] == want


def test_missing_matrix_and_model_fail_at_once(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        matrix.read_sparse_matrix(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        models.load_model(str(tmp_path / "none"))


def test_upserts_are_idempotent(spark):
    brands = spark.createDataFrame([], "brand_id string, name string")
    products = spark.createDataFrame([], "product_id string, url string, name string, brand_id string")
    cands = spark.createDataFrame([("Acer A", "u1"), ("Acer B", "u1"), ("【x】 Asus", "u2")], "name string, url string")
    once = S.upsert_products(products, cands)
    assert {(r.url, r.name) for r in once.collect()} == {("u1", "Acer A"), ("u2", "Asus")}
    assert S.upsert_products(once, cands).count() == 2
    named = S.upsert_brands(brands, cands)
    assert {r.name for r in named.collect()} == {"Acer", ""} and S.upsert_brands(named, cands).count() == 2


def test_replace_in_table_touches_only_the_batch_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(200).select(F.concat(F.lit("p"), F.col("id") % 20).alias("product_id"), "id")
    tables.write_review_table(old, path, buckets=16)
    before = {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith("parquet")}
    tables.replace_reviews_in_table(spark, path, spark.createDataFrame([("p3", 999)], "product_id string, id bigint"), buckets=16)
    rows = spark.read.parquet(path)
    assert [r.id for r in rows.filter("product_id = 'p3'").collect()] == [999] and rows.count() == 191
    after = {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith("parquet")}
    assert before - after and before & after


def ingest(spark, source, target, checkpoint, max_files=1):
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("user string, text string, n int")
    run = stream_ingest_reviews(spark, source, schema, target, checkpoint, ["user", "text"], ["n"], max_files=max_files)
    run.awaitTermination()
    return {(r.user, r.text, r.n) for r in spark.read.parquet(target).drop(KEY, BATCH, BUCKET).collect()}


def test_stream_equals_batch_and_survives_replay(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")

    def add(*rows):
        spark.createDataFrame(rows, "user string, text string, n int").coalesce(1).write.mode("append").parquet(source)

    add(("a", "x", 1), ("a", "x", 2), (None, "y", 3))
    assert ingest(spark, source, target, str(tmp_path / "cp")) == {("a", "x", 1), (None, "y", 3)}
    add(("a", "x", 9), ("b", "z", 4))
    want = {("a", "x", 1), ("b", "z", 4), (None, "y", 3)}
    assert ingest(spark, source, target, str(tmp_path / "cp")) == want
    # Even a lost checkpoint, which replays everything in other batches, doubles nothing.
    for name, files in (("cp2", 1), ("cp3", None)):
        assert ingest(spark, source, target, str(tmp_path / name), files) == want
        assert spark.read.parquet(target).count() == 3


def test_transform_never_resamples_and_models_reload(spark, tmp_path):
    rows = []
    for i in range(60):
        label = 0 if i < 40 else (1 if i < 52 else 2)
        words = {0: ["good", "fast"], 1: ["bad", "slow"], 2: ["plain", "okay"]}[label]
        entries = sorted([(w, 0.5 + 0.01 * i) for w in words] + [(f"n{i % 7}", 0.3)])
        rows.append((i, label, entries))
    df = spark.createDataFrame(rows, "review_id bigint, label_idx int, weights array<struct<term:string,weight:double>>")
    stage = M.ResampleSelectClassifier(classifier=M.boosted_trees({"n_estimators": 2, "max_depth": 2}), k=8, neighbors=3)
    model = stage.fit(df)
    out = model.transform(df)
    assert out.count() == 60 and model.size == 8
    right = out.filter(F.col("prediction") == F.col("label_idx")).count()
    assert right >= 55
    confidence = out.select(M.predict_confidence(F.col("probability")).alias("c")).agg(F.min("c"), F.max("c")).first()
    assert 1 / 3 <= confidence[0] <= confidence[1] <= 1
    model.save(str(tmp_path / "m"))
    again = M.ResampleSelectModel.load(spark, str(tmp_path / "m")).transform(df)
    assert again.filter(F.col("prediction") == F.col("label_idx")).count() == right


def test_grid_has_the_reference_size():
    assert len(M.param_grid(M.boosted_trees())) == 72


def test_bucket_count_is_the_tables_own(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_review_table(spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "product_id string, id bigint"), path, buckets=8)
    batch = spark.createDataFrame([(None, 9), ("a", 10)], "product_id string, id bigint")
    with pytest.raises(ValueError, match="8 buckets"):
        tables.replace_reviews_in_table(spark, path, batch, buckets=16)
    tables.replace_reviews_in_table(spark, path, batch)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [3, 9, 10]


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    """Files of other buckets are damaged, and the next batch does not notice."""
    from pyspark.sql import types as T

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = T._parse_datatype_string("user string, text string, n int")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream_ingest_reviews(spark, source, schema, target, str(tmp_path / "cp"), ["user", "text"], ["n"], buckets=16).awaitTermination()

    run([(f"u{i}", "x", i) for i in range(60)])
    own = spark.read.parquet(target).filter("user = 'u7'").first()[BUCKET]
    assert {r[0] for r in spark.read.parquet(target).select(BUCKET).distinct().collect()} != {own}
    for folder, _, files in os.walk(target):
        for f in files:
            if f"{BUCKET}=" in folder and f"{BUCKET}={own}/" not in folder + "/" and f.endswith(".parquet"):
                os.remove(os.path.join(folder, f".{f}.crc"))
                with open(os.path.join(folder, f), "wb") as out:
                    out.write(b"damaged")
    run([("u7", "x", 99)])
    left = spark.read.schema("user string, n int").parquet(f"{target}/{BUCKET}={own}")
    assert [r.n for r in left.filter("user = 'u7'").collect()] == [7]


def test_stream_scores_as_the_batch_operator(spark, tmp_path):
    from pyspark.sql import types as T

    from reviewloom.operators import models as M
    from reviewloom.operators.features import term_counts, tfidf_fit, tfidf_transform
    from reviewloom.plans.training import entry_rows

    train = spark.createDataFrame([(i, i % 2, "bagus cepat" if i % 2 else "rusak lambat") for i in range(40)], "review_id bigint, label_idx int, review string")
    counts = term_counts(train, "review_id", "review")
    idf = tfidf_fit(counts, train)
    rows = entry_rows(train.select("review_id", "label_idx"), tfidf_transform(counts, idf, "review_id"), "review_id")
    labels = spark.createDataFrame([("negatif", 0), ("positif", 1)], "label string, label_idx int")
    model = M.fit_sentiment(rows, labels, idf, M.ResampleSelectClassifier(classifier=M.boosted_trees({"n_estimators": 3}), k=None, resample=False))
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = T._parse_datatype_string("user string, review string")
    texts = ["bagus cepat sekali", "rusak lambat", "cepat", "", None, "lambat rusak"]
    spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], schema).write.parquet(source)
    stream_ingest_reviews(spark, source, schema, target, str(tmp_path / "cp"), ["user", "review"], ["user"], model=model).awaitTermination()
    got = {r.user: (r.predicted, r.confidence) for r in spark.read.parquet(target).collect()}
    batch = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "review_id bigint, review string")
    assert got == {f"u{r['review_id']}": (r["predicted"], r["confidence"]) for r in model.score(batch).collect()}
    assert got["u0"][0] == "positif" and got["u1"][0] == "negatif"


def test_stem_table_with_exceptions(spark):
    from reviewloom.operators.stems import stem_with_table

    df = spark.createDataFrame([(1, "Laptopnya dibeli, laptopnya MAHAL"), (2, None), (3, ""), (4, "dibeli " * 500)], "id int, t string")
    table = spark.createDataFrame([("laptopnya", "komputer"), ("mahal", "harga")], "surface string, stem string")
    plain = {r.id: r.stemmed for r in stem_with_table(df, "id", "t", table).collect()}
    assert plain == {1: "komputer dibeli komputer harga", 2: None, 3: "", 4: " ".join(["dibeli"] * 500)}
    ruled = {r.id: r.stemmed for r in stem_with_table(df, "id", "t", table, rules=True).collect()}
    assert ruled[1] == "komputer beli komputer harga"


@pytest.mark.parametrize("parts", [0, 1, 3])
def test_ingest_query_reads_a_table_of_part_files(spark, tmp_path, parts):
    from reviewloom.workload import queries

    schema = "conv_id long, turn int, role string, text string"
    rows = spark.createDataFrame([(c, t, "user", f"Text {c * 2 + t} a") for c in range(6) for t in (0, 1, 2)], schema)
    path = str(tmp_path / "conversations.parquet")
    if parts:
        rows.repartition(parts).write.parquet(path)
    else:  # a table without rows
        rows.filter("conv_id < 0").write.parquet(path)
    found = queries()["stream_ingest_reviews"](spark, str(tmp_path))
    assert found.columns == ["conv_id", "turn", "role", "text", "cleaned"]
    assert {(r.conv_id, r.turn) for r in found.collect()} == ({(c, t) for c in range(6) for t in (1, 2)} | {(0, 0)} if parts else set())
