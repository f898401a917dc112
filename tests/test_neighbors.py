"""Neighbours by pivot cells against all pairs; hubs in oversampling."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import neighbors as N
from reviewloom.operators import smote as S


def clustered(n, seed=0, dims=4, centres=12):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(centres, dims)) * 50
    points = middle[rnd.integers(0, centres, n)] + rnd.normal(size=(n, dims))
    points[: n // 20] = points[n // 2]  # copies of one vector
    return [(int(i), int(i % 3 == 0), [round(float(x), 6) for x in p]) for i, p in enumerate(points)]


def plain(rows, k):
    found = {}
    for i, g, v in rows:
        own = sorted((round(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), 9), j) for j, h, w in rows if h == g and j != i)
        found[i] = [(j, pytest.approx(d, abs=1e-8)) for d, j in own[:k]]
    return found


def found_of(df):
    got = {}
    for r in df.orderBy("id", "nn_rank").collect():
        got.setdefault(r["id"], []).append((r["nn_id"], r["distance"]))
    return got


def test_cells_give_the_exact_neighbours(spark):
    rows = clustered(300)
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    assert found_of(N.blocked_knn(df, "g", "id", "v", 4, block_rows=16)) == plain(rows, 4)


def test_sparse_cells_give_the_exact_neighbours(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        words = sorted(rnd.sample([f"t{i % 4}{x}" for x in range(8)] + ["u", "v"], 4))
        rows.append((i, i % 2, [(w, round(rnd.random(), 4)) for w in words]))
    df = spark.createDataFrame(rows, "id long, g int, v array<struct<term:string,weight:double>>")
    terms = sorted({w for _, _, v in rows for w, _ in v})
    dense = [(i, g, [dict(v).get(t, 0.0) for t in terms]) for i, g, v in rows]
    assert found_of(N.blocked_knn(df, "g", "id", "v", 3, sparse=True, block_rows=12)) == plain(dense, 3)


def test_far_cells_are_not_searched(spark, monkeypatch):
    """Vectors sent to other cells grow about as the rows do, not as their square."""
    sent = []
    real = N.cut_lineage

    def counted(df):
        out = real(df)
        if df.columns == ["grp", "id", "vec", "cell"]:
            sent.append(out.count())
        return out

    monkeypatch.setattr(N, "cut_lineage", counted)
    for n in (400, 1600):
        df = spark.createDataFrame(clustered(n, dims=2, centres=40), "id long, g int, v array<double>").withColumn("g", F.lit(0))
        assert N.blocked_knn(df, "g", "id", "v", 3, block_rows=25).count() == 3 * n
    assert sent[1] < 8 * max(sent[0], 1) and sent[1] < 0.3 * 1600 * (1600 / 25)


def test_few_probes_find_most(spark):
    rows = clustered(600, seed=4, dims=6, centres=3)
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    exact = found_of(N.blocked_knn(df, "g", "id", "v", 5, block_rows=40))
    some = found_of(N.blocked_knn(df, "g", "id", "v", 5, block_rows=40, probes=4))
    hits = sum(len({j for j, _ in exact[i]} & {j for j, _ in some[i]}) for i in exact)
    assert hits >= 0.9 * sum(map(len, exact.values()))


def test_a_hub_is_not_one_task(spark):
    """Rows around one vector, which is the first neighbour of all of them."""
    rows = [(0, 0, [0.0, 0.0])] + [(i, 0, [float(np.cos(i)) * 5, float(np.sin(i)) * 5]) for i in range(1, 150)] + [(1000 + i, 1, [9.0, float(i)]) for i in range(400)]
    out = S.smote(spark.createDataFrame(rows, "id long, g int, v array<double>"), "g", "id", "v", k=1)
    assert {r["g"]: r["count"] for r in out.groupBy("g").count().collect()} == {0: 400, 1: 400}


def test_sparse_rows_with_frequent_rare_and_no_terms(spark):
    rows = [(i, "a", [] if i % 9 == 4 else [("all", 0.5 + i / 64)] + [(f"t{t}", 0.25 + (i * t) % 7) for t in range(12) if (i * 7 + t) % 5 == 0] + [(f"z{i}", 0.125)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label string, v array<struct<term:string,weight:double>>")
    vectors = {i: dict(v) for i, _, v in rows}

    def dist(i, j):
        x, y = vectors[i], vectors[j]
        return round(sum((x.get(t, 0.0) - y.get(t, 0.0)) ** 2 for t in {*x, *y}) ** 0.5, 9)

    want = {i: [j for _, j in sorted((dist(i, j), j) for j in vectors if j != i)[:3]] for i in vectors}
    for block in (8, 2048):
        found = {}
        for r in N.blocked_knn(df, "label", "id", "v", 3, sparse=True, block_rows=block).collect():
            found.setdefault(r.id, []).append((r.nn_rank, r.nn_id))
        assert {i: [j for _, j in sorted(near)] for i, near in found.items()} == want
    bare = spark.createDataFrame([(i, "a", []) for i in range(4)], df.schema)
    assert N.blocked_knn(bare, "label", "id", "v", 2, sparse=True).count() == 8


def test_sparse_distances_of_far_and_near_rows(monkeypatch):
    """Only near rows are measured entry by entry; both ways give the distance to the digits that are compared."""
    rnd = np.random.default_rng(2)
    dense = rnd.random((60, 40)) * (rnd.random((60, 40)) < 0.3)
    dense[30:] = dense[:30] * (1 + 1e-7 * rnd.random((30, 40)))  # a near row each
    rows = N.pd.DataFrame({"vec": [{"t": np.flatnonzero(v), "w": v[v > 0]} for v in dense]})
    sorted_pairs = []
    real = np.lexsort
    monkeypatch.setattr(N.np, "lexsort", lambda keys: [sorted_pairs.append(len(np.unique(keys[1]))), real(keys)][1])
    i, j = (x.ravel() for x in np.mgrid[:60, :60])
    found = N._sparse(rows, rows)[1](i, j)
    want = np.sqrt(((dense[i] - dense[j]) ** 2).sum(axis=1))
    assert np.abs(found - want).max() < 1e-12
    assert 0 < sum(sorted_pairs) <= 120  # each row with itself and its near one
