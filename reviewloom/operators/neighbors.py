"""Nearest neighbours inside each class: exact by pivot cells and the triangle inequality, or the nearest cells only."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.operators.bounded import broadcast_bounded, few_rows
from reviewloom.operators.encode import MAX_CLASSES
from reviewloom.operators.skew import join_by_weight
from reviewloom.session import cut_lineage

DENSE_BLOCK = 2048
SPARSE_BLOCK = 2048
DISTANCE_DIGITS = 9  # distances are compared after rounding; ties go to the smaller id
CELLS = 1 << 20  # distance cells refined at a time inside a kernel
MAX_PIVOTS = 1024  # per class
BUNDLE = 8  # cells, and blocks of rows, that meet in one task
LEAST_BUNDLES = 8  # per class; smaller classes have bundles of fewer cells
COLUMNS = 2048  # columns multiplied at a time for sparse rows
ENTRIES = 1 << 18  # sparse entries of the left side multiplied at a time
PAIRS = 4096  # pairs of sparse rows measured at a time
NEAR = 1e-4  # squared distances below this share of the norms lose digits in a product


def _nearest(d2: np.ndarray, exact, ids: np.ndarray, k: int, noise: np.ndarray):
    """Positions of the k nearest columns of each row by (rounded exact distance, id).

    ``d2`` comes from a matrix product and may be off by ``noise``; every column that could still be
    among the k nearest is measured again with ``exact``.
    """
    k = min(k, d2.shape[1])
    rows_out, cols_out, dist_out = [], [], []
    step = max(1, CELLS // d2.shape[1])
    for start in range(0, d2.shape[0], step):
        part = d2[start : start + step]
        slack = noise[start : start + step]
        kth = np.partition(part, k - 1, axis=1)[:, k - 1]
        reach = (np.sqrt(np.maximum(kth + slack, 0.0)) + 10.0 ** (1 - DISTANCE_DIGITS)) ** 2 + slack
        rows, cols = np.nonzero(part <= reach[:, None])
        dist = np.round(exact(rows + start, cols), DISTANCE_DIGITS)
        order = np.lexsort((ids[cols], dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        first = np.searchsorted(rows, np.arange(part.shape[0]))
        keep = np.arange(len(rows)) - first[rows] < k
        rows_out.append(rows[keep] + start)
        cols_out.append(cols[keep])
        dist_out.append(dist[keep])
    return np.concatenate(rows_out), np.concatenate(cols_out), np.concatenate(dist_out)


def _dense(left: pd.DataFrame, right: pd.DataFrame):
    a, b = (np.stack(side["vec"].to_numpy()).astype(np.float64) for side in (left, right))
    na, nb = (a * a).sum(1), (b * b).sum(1)
    d2 = na[:, None] + nb[None, :] - 2.0 * (a @ b.T)
    noise = 1e-12 * (na + nb.max())

    def exact(i, j):
        out = np.empty(len(i))
        for s in range(0, len(i), 65536):
            diff = a[i[s : s + 65536]] - b[j[s : s + 65536]]
            out[s : s + 65536] = np.sqrt((diff * diff).sum(1))
        return out

    return d2, exact, noise


def _places(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of ``counts``."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _sparse(left: pd.DataFrame, right: pd.DataFrame):
    """Rows are sorted term names ``t`` with weights ``w``. Only terms of both sides make products: frequent ones become
    columns, a slice at a time; of the others the pairs of entries are added up."""
    sides = []
    for side in (left, right):
        sizes = np.array([len(v["t"]) for v in side["vec"]], dtype=np.int64)
        name = np.concatenate([np.zeros(0, np.int64), *(np.asarray(v["t"], dtype=np.int64) for v in side["vec"])])
        weight = np.concatenate([np.zeros(0), *(np.asarray(v["w"], dtype=np.float64) for v in side["vec"])])
        sides.append((np.repeat(np.arange(len(sizes)), sizes), name, weight, sizes))
    norms = [np.bincount(row, weights=weight**2, minlength=len(sizes)) for row, _, weight, sizes in sides]
    shape = (len(sides[0][3]), len(sides[1][3]))
    shared = np.intersect1d(sides[0][1], sides[1][1])
    coded = []
    for row, name, weight, _ in sides:
        code = np.searchsorted(shared, name)
        there = (shared[np.minimum(code, len(shared) - 1)] == name) if len(shared) else np.zeros(len(name), bool)
        order = np.argsort(code[there], kind="stable")
        coded.append((row[there][order], code[there][order], weight[there][order]))
    times = [np.bincount(code, minlength=len(shared)) for _, code, _ in coded]
    products = times[0] * times[1]
    dense = np.flatnonzero(products > shape[0] * shape[1] / 512)
    column = np.full(len(shared), -1)
    column[dense] = np.arange(len(dense))
    grams = np.zeros(shape)
    for start in range(0, len(dense), COLUMNS):
        blocks = []
        for (row, code, weight), rows in zip(coded, shape):
            at = column[code]
            inside = (at >= start) & (at < start + COLUMNS)
            block = np.zeros((rows, min(COLUMNS, len(dense) - start)))
            block[row[inside], at[inside] - start] = weight[inside]
            blocks.append(block)
        grams += blocks[0] @ blocks[1].T
    # The entries of one rare term on the left meet all of the term's on the right.
    row, code, weight = coded[0]
    rare = np.flatnonzero(column[code] < 0)
    first = np.cumsum(times[1]) - times[1]
    for start in range(0, len(rare), ENTRIES):
        some = rare[start : start + ENTRIES]
        counts = times[1][code[some]]
        other = np.repeat(first[code[some]], counts) + _places(counts)
        cell = np.repeat(row[some], counts) * shape[1] + coded[1][0][other]
        values = np.repeat(weight[some], counts) * coded[1][2][other]
        grams += np.bincount(cell, weights=values, minlength=shape[0] * shape[1]).reshape(shape)
    d2 = np.maximum(norms[0][:, None] + norms[1][None, :] - 2.0 * grams, 0.0)
    begins = [np.cumsum(sizes) - sizes for *_, sizes in sides]

    def exact(i, j):
        """From the products, which are off by 1e-15 of the norms or so; near rows, where that shows in a distance, from
        the differences of their entries."""
        squared = d2[i, j]
        near = np.flatnonzero(squared < NEAR * (norms[0][i] + norms[1][j]))
        squared[near] = differences(i[near], j[near])
        return np.sqrt(squared)

    def differences(i, j):
        out = np.zeros(len(i))
        for start in range(0, len(i), PAIRS):
            picked = i[start : start + PAIRS], j[start : start + PAIRS]
            parts = []
            for (_, name, weight, sizes), begin, own, sign in zip(sides, begins, picked, (1.0, -1.0)):
                counts = sizes[own]
                at = np.repeat(begin[own], counts) + _places(counts)
                parts.append((np.repeat(np.arange(len(own)), counts), name[at], sign * weight[at]))
            pair, name, value = (np.concatenate(c) for c in zip(*parts))
            if not len(pair):
                continue
            order = np.lexsort((name, pair))
            pair, name, value = pair[order], name[order], value[order]
            heads = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (name[1:] != name[:-1])])
            diff = np.add.reduceat(value, heads)
            out[start : start + PAIRS] = np.bincount(pair[heads], weights=diff * diff, minlength=len(picked[0]))
        return out

    return d2, exact, 1e-12 * (norms[0] + (norms[1].max() if len(norms[1]) else 0.0))


def _kernel(measure, k: int):
    """Both directions of one pair of blocks; only k candidates per row leave the task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf["grp"].iloc[0]
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = bool(pdf["_a"].iloc[0] == pdf["_b"].iloc[0])
        if same:
            right = left
        if not len(left) or not len(right):
            return pd.DataFrame({"grp": [], "id": [], "cid": [], "dist": []})
        d2, exact, noise = measure(left, right)
        lid, rid = left["id"].to_numpy(), right["id"].to_numpy()
        parts = []
        i, j, d = _nearest(d2, exact, rid, k, noise)
        parts.append(pd.DataFrame({"grp": group, "id": lid[i], "cid": rid[j], "dist": d}))
        if not same:
            back = np.full(len(right), noise.max())
            i, j, d = _nearest(d2.T, lambda r, c: exact(c, r), lid, k, back)
            parts.append(pd.DataFrame({"grp": group, "id": rid[i], "cid": lid[j], "dist": d}))
        return pd.concat(parts, ignore_index=True)

    return run


def _one_way(measure, k: int, block_rows: int):
    """The k nearest members (side 1) of some cells for the queries (side 0) that reach into these; members have one cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        found = [pd.DataFrame({"grp": [], "id": [], "cid": [], "dist": []})]
        asker, asked = np.repeat(np.arange(len(left)), [len(c) for c in left["cell"]]), np.concatenate([np.zeros(0, int), *left["cell"]])
        home = np.array([c[0] for c in right["cell"]], dtype=int)
        for cell in np.intersect1d(home, asked):
            members, queries = right[home == cell], left.iloc[asker[asked == cell]]
            for i, j in product(range(0, len(queries), block_rows), range(0, len(members), block_rows)):
                some, others = queries.iloc[i : i + block_rows], members.iloc[j : j + block_rows]
                d2, exact, noise = measure(some, others)
                row, col, d = _nearest(d2, exact, others["id"].to_numpy(), k, noise)
                found.append(pd.DataFrame({"grp": pdf["grp"].iloc[0], "id": some["id"].to_numpy()[row], "cid": others["id"].to_numpy()[col], "dist": d}))
        if len(found) == 1:
            return found[0]
        return pd.concat(found[1:], ignore_index=True).sort_values(["id", "dist", "cid"]).groupby("id").head(k)

    return run


def _search(distinct: DataFrame, id_type: str, grp_type: str, k: int, sparse: bool, block_rows: int, probes: int | None) -> DataFrame:
    """Candidates (grp, id, cid, dist) that hold the k nearest of each (grp, id, vec), itself included.

    Each class has a pivot per ``block_rows`` rows, and a row belongs to the cell of its nearest pivot. The k
    nearest in the own cell bound the distance from above; a cell whose nearest possible member is farther by
    the triangle inequality (distance to its pivot less its radius) is not searched. A row is sent to the cells that are
    left, or with ``probes`` to that many nearest ones at most, and once to a bundle of cells that meet in one task.
    """
    session = distinct.sparkSession
    measure = _sparse if sparse else _dense
    rank = F.row_number().over(W.partitionBy("grp").orderBy(F.xxhash64("id"), "id"))
    sizes = distinct.groupBy("grp").agg(F.least(F.lit(MAX_PIVOTS), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("_p"))
    schema = f"grp {grp_type}, id {id_type}, cid {id_type}, dist double"
    if all(r["_p"] <= 1 for r in few_rows(sizes, MAX_CLASSES, "classes")):  # a cell per class
        whole = distinct.select("grp", F.lit(0).alias("_a"), F.lit(0).alias("_b"), F.lit(0).alias("side"), "id", "vec")
        return whole.groupBy("grp").applyInPandas(_kernel(measure, k), schema)
    chosen = distinct.withColumn("_rank", rank).filter(F.col("_rank") <= MAX_PIVOTS).join(broadcast_bounded(sizes, MAX_CLASSES, "classes"), "grp")
    pivots = few_rows(chosen.filter(F.col("_rank") <= F.col("_p")).select("grp", "_rank", "vec"), MAX_PIVOTS * 16, "pivots")
    bundles = sizes.select("grp", F.greatest(F.lit(1), F.least(F.lit(BUNDLE), F.floor(F.col("_p") / LEAST_BUNDLES))).cast("int").alias("_b"))
    bundles = broadcast_bounded(bundles, MAX_CLASSES, "classes")
    width = {r["grp"]: r["_b"] for r in few_rows(bundles, MAX_CLASSES, "classes")}
    held: dict = {}
    for row in sorted(pivots, key=lambda r: r["_rank"]):
        held.setdefault(row["grp"], []).append(row["vec"].asDict() if sparse else row["vec"])
    shared = session.sparkContext.broadcast({g: pd.DataFrame({"vec": vs}) for g, vs in held.items()})
    fields = f"grp {grp_type}, id {id_type}, vec {distinct.schema['vec'].dataType.simpleString()}"

    def to_pivots(rows: pd.DataFrame, grp) -> np.ndarray:
        return np.sqrt(np.maximum(measure(rows, shared.value[grp])[0], 0.0))

    def assign(batches):
        for batch in batches:
            for grp, own in batch.groupby("grp", dropna=False):
                for start in range(0, len(own), block_rows):
                    some = own.iloc[start : start + block_rows]
                    d = to_pivots(some, grp)
                    cell = d.argmin(axis=1)
                    yield some.assign(cell=cell.astype(np.int32), reach=d[np.arange(len(some)), cell])

    placed = cut_lineage(distinct.select("grp", "id", "vec").mapInPandas(assign, f"{fields}, cell int, reach double"))
    cells = placed.groupBy("grp", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"), F.max("reach").alias("radius"))
    cells = cut_lineage(cells)
    radius: dict = {}
    for r in few_rows(cells, MAX_PIVOTS * 16, "cells"):
        radius.setdefault(r["grp"], {})[r["cell"]] = r["radius"]
    # Inside each cell: pairs of its blocks.
    pairs = (
        placed.join(F.broadcast(cells.drop("radius")), ["grp", "cell"])
        .withColumn("_x", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("_a", F.least("_x", "_j"))
        .withColumn("_b", F.greatest("_x", "_j"))
        .withColumn("side", (F.col("_x") != F.col("_a")).cast("int"))
    )
    own = pairs.groupBy("grp", "cell", "_a", "_b").applyInPandas(_kernel(measure, k), schema)
    best = own.withColumn("_rn", F.row_number().over(W.partitionBy("grp", "id").orderBy("dist", "cid"))).filter(F.col("_rn") <= k)
    best = cut_lineage(best.drop("_rn"))
    # What lies in other cells can be nearer than the k-th of the own cell only if the cell reaches that far.
    kth = best.groupBy("grp", "id").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("kth"))

    def reach_out(batches):
        for batch in batches:
            for grp, rows in batch.groupby("grp", dropna=False):
                widths = np.array([radius[grp].get(c, -np.inf) for c in range(len(shared.value[grp]))])
                for start in range(0, len(rows), block_rows):
                    some = rows.iloc[start : start + block_rows]
                    d = to_pivots(some, grp)
                    # Distances come from a product and are rounded later: cells at the edge are searched too.
                    edge = 1e-6 * (1 + d)
                    wanted = (d - widths[None, :] - edge <= some["kth"].to_numpy()[:, None]) & np.isfinite(widths)[None, :]
                    wanted[np.arange(len(some)), some["cell"].to_numpy()] = False
                    if probes is not None:
                        nth = np.argsort(np.argsort(np.where(wanted, d, np.inf), axis=1, kind="stable"), axis=1, kind="stable")
                        wanted &= nth < probes
                    i, c = np.nonzero(wanted)
                    if not len(i):
                        continue
                    heads = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (c[1:] // width[grp] != c[:-1] // width[grp])])
                    yield some.iloc[i[heads]][["grp", "id", "vec"]].assign(cell=np.split(c.astype(np.int32), heads[1:]))

    asked = placed.join(kth, ["grp", "id"]).select("grp", "id", "vec", "cell", "kth").mapInPandas(reach_out, f"{fields}, cell array<int>")
    asked = cut_lineage(asked)
    # Queries and members of a bundle meet in parts of about as many blocks as the bundle has cells.
    queries = asked.join(bundles, "grp").withColumn("_bundle", F.floor(F.get("cell", F.lit(0)) / F.col("_b")).cast("int"))
    members = placed.join(bundles, "grp").withColumn("_bundle", F.floor(F.col("cell") / F.col("_b")).cast("int"))
    rows_at_once = F.any_value("_b") * block_rows
    loads = queries.groupBy("grp", "_bundle").agg(F.ceil(F.count(F.lit(1)) / rows_at_once).alias("chunks"))
    slices = members.groupBy("grp", "_bundle").agg(F.ceil(F.count(F.lit(1)) / rows_at_once).alias("slices"))
    known = F.broadcast(cut_lineage(loads.join(slices, ["grp", "_bundle"])))  # a row per bundle
    dealt = [F.pmod(F.xxhash64("id"), F.col(n)) for n in ("chunks", "slices")]
    each = [F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("chunks", "slices")]
    left = queries.join(known, ["grp", "_bundle"]).select("grp", "_bundle", dealt[0].alias("_c"), each[1].alias("_s"), F.lit(0).alias("side"), "id", "vec", "cell")
    right = members.join(known, ["grp", "_bundle"]).select("grp", "_bundle", each[0].alias("_c"), dealt[1].alias("_s"), F.lit(1).alias("side"), "id", "vec", F.array("cell").alias("cell"))
    far = left.unionByName(right).groupBy("grp", "_bundle", "_c", "_s").applyInPandas(_one_way(measure, k, block_rows), schema)
    return best.unionByName(far)


def blocked_knn(
    df: DataFrame, group: str, id_col: str, vec: str, k: int = 5, sparse: bool = False, block_rows: int | None = None, probes: int | None = None
) -> DataFrame:
    """The k nearest rows of the same class: ``(group, id, nn_rank, nn_id, distance)``.

    Exact; with ``probes`` a row is compared with its own cell and that many others at most, which bounds the
    work of very large classes without structure (recall is measured in the tests).

    Equal vectors are collapsed first: only the k + 1 smallest ids of a vector can be anyone's
    neighbours, so a vector with any number of copies enters the search once. Distinct vectors fall
    into cells around pivots, whose number grows with the class, and cells that are too far away are never
    compared. A task compares blocks of ``block_rows`` and emits k + 1 candidates per row, never the pairs. ``vec`` is
    an array of doubles, or with ``sparse=True`` a term-sorted array of (term, weight).
    """
    id_type, grp_type = dict(df.dtypes)[id_col], dict(df.dtypes)[group]
    block_rows = block_rows or (SPARSE_BLOCK if sparse else DENSE_BLOCK)
    rows = df.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    rows = rows.withColumn("vkey", F.sha2(F.to_json(F.struct("vec")), 256))

    lowest = rows.withColumn("_rn", F.row_number().over(W.partitionBy("grp", "vkey").orderBy("id")))
    lowest = lowest.filter(F.col("_rn") <= k + 1)
    copies = rows.groupBy("grp", "vkey").agg(F.count(F.lit(1)).alias("copies"))
    distinct = lowest.groupBy("grp", "vkey").agg(
        F.sort_array(F.collect_list("id")).alias("ids"), F.any_value("vec").alias("vec")
    )
    # Read three times below, so it is written once; likewise the result of the search.
    distinct = cut_lineage(distinct.withColumn("rep", F.get("ids", F.lit(0))).join(copies, ["grp", "vkey"]))

    entries = F.struct(F.transform("vec", lambda e: F.xxhash64(e["term"])).alias("t"), F.transform("vec", lambda e: e["weight"].cast("double")).alias("w"))
    searched = distinct.select("grp", F.col("rep").alias("id"), entries.alias("vec") if sparse else "vec")
    found = _search(searched, id_type, grp_type, k + 1, sparse, block_rows, probes)

    near: list[Column] = [F.col("dist"), F.col("cid")]
    best = found.withColumn("_rn", F.row_number().over(W.partitionBy("grp", "id").orderBy(*near)))
    best = best.filter(F.col("_rn") <= k + 1).drop("_rn")
    ids = distinct.select("grp", F.col("rep").alias("cid"), "ids")
    spread = best.join(ids, ["grp", "cid"]).select("grp", F.col("id").alias("rep"), "dist", F.explode("ids").alias("nn_id"))
    spread = spread.withColumn("_rn", F.row_number().over(W.partitionBy("grp", "rep").orderBy("dist", "nn_id")))
    lists = (
        spread.filter(F.col("_rn") <= k + 1)
        .groupBy("grp", "rep")
        .agg(F.sort_array(F.collect_list(F.struct("dist", "nn_id"))).alias("near"))
    )
    per_vector = cut_lineage(
        distinct.select("grp", "vkey", "rep", "copies").join(lists, ["grp", "rep"]).select("grp", "vkey", "copies", "near")
    )
    members = join_by_weight(rows.select("grp", "vkey", "id"), per_vector, ["grp", "vkey"], "copies")
    # F.filter with the row's own id: itself is not its neighbour.
    others = F.slice(F.filter("near", lambda e: e["nn_id"] != F.col("id")), 1, k)
    return members.select("grp", "id", F.posexplode(others).alias("_pos", "_e")).select(
        F.col("grp").alias(group),
        F.col("id").alias(id_col),
        (F.col("_pos") + 1).alias("nn_rank"),
        F.col("_e.nn_id").alias("nn_id"),
        F.col("_e.dist").alias("distance"),
    )
