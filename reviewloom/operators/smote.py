"""Synthetic minority oversampling.

Every class is raised to the size of the largest one by points on the segment between a row and one
of its nearest neighbours of the same class. Which row, which neighbour and how far along the segment follow
from seeded hashes: same counts and same geometry as random draws, and repeatable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.keys import int_hash, unit_hash
from reviewloom.operators.bounded import small_table
from reviewloom.operators.neighbors import blocked_knn
from reviewloom.operators.ranking import HashOrder
from reviewloom.operators.skew import join_by_weight
from reviewloom.session import cut_lineage

CHUNK = 1000  # synthetic rows one base row yields per task


def deficits(sizes: dict) -> dict:
    """Rows each class lacks; a class of one row that needs more raises."""
    largest = max(sizes.values(), default=0)
    lacking = {value: largest - size for value, size in sizes.items() if size < largest}
    alone = [value for value in lacking if sizes[value] == 1]
    if alone:
        raise ValueError(f"class with a single row has no neighbour: {alone[0]!r}")
    return lacking


def _synthetic(
    rows: DataFrame, payload: str, label: str, id_col: str, k: int, seed: int, sparse: bool, blend: Callable[[Column, Column, Column], Column]
) -> DataFrame:
    order = HashOrder(rows, label, id_col, seed)
    lacking = deficits(order.sizes)
    # The largest class needs no rows and takes no part in the neighbour search.
    base = rows.filter(F.col(label).isin(list(lacking)))
    each = small_table(
        rows.sparkSession,
        [{"_value": v, "_each": d // order.sizes[v]} for v, d in lacking.items()],
        T.StructType([T.StructField("_value", rows.schema[label].dataType), T.StructField("_each", T.IntegerType())]),
    )
    cuts = order.cuts({value: [d % order.sizes[value]] for value, d in lacking.items()})
    placed = order.place(base, cuts, "_cut").join(F.broadcast(each), F.col(label) == F.col("_value"))
    copies = F.col("_each") + (F.col("_cut") == 0).cast("int")
    placed = placed.withColumn("_copies", copies).filter(F.col("_copies") > 0).drop("_cut", "_value", "_each")

    near = blocked_knn(base.select(label, id_col, payload), label, id_col, payload, k, sparse)
    near = cut_lineage(near.select(id_col, "nn_rank", "nn_id"))
    # A hub may be the neighbour of very many rows: its join is split by that number.
    weights = near.groupBy("nn_id").agg(F.count(F.lit(1)).alias("_times"))
    targets = cut_lineage(base.select(F.col(id_col).alias("nn_id"), F.col(payload).alias("_nn")).join(weights, "nn_id"))
    lists = (
        join_by_weight(near, targets, ["nn_id"], "_times")
        .groupBy(id_col)
        .agg(F.sort_array(F.collect_list(F.struct("nn_rank", "_nn"))).alias("_near"))
    )
    # The neighbours travel with the row, so nothing is joined after the rows multiply. Runs of
    # CHUNK copies are spread over the tasks before they are unfolded.
    chunks = F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / CHUNK).cast("int"))
    runs = placed.join(lists, id_col).withColumn("_chunk", F.explode(chunks)).repartition(F.col(id_col), F.col("_chunk"))
    until = F.least(F.col("_copies"), (F.col("_chunk") + 1) * CHUNK) - 1
    drawn = runs.withColumn("_j", F.explode(F.sequence(F.col("_chunk") * CHUNK, until)))
    token = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("_j").cast("string"))
    pick = (int_hash(F.concat(token, F.lit("|nn"))) % F.size("_near")).cast("int")
    step = unit_hash(F.concat(token, F.lit("|u")))
    return drawn.withColumn("_other", F.get(F.col("_near"), pick)["_nn"]).withColumn("_u", step).select(
        F.concat(F.col(id_col).cast("string"), F.lit("#"), F.col("_j").cast("string")).alias("row_id"),
        F.col(label),
        blend(F.col(payload), F.col("_other"), F.col("_u")).alias(payload),
        F.lit(True).alias("synthetic"),
    )


def smote(df: DataFrame, label: str, id_col: str, vec: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Original and synthetic rows ``(row_id, label, vec, synthetic)`` for dense vectors."""
    rows = df.select(id_col, label, F.col(vec).cast("array<double>").alias(vec))

    def blend(x: Column, y: Column, u: Column) -> Column:
        return F.zip_with(x, y, lambda a, b: a + u * (b - a))

    fresh = _synthetic(rows, vec, label, id_col, k, seed, False, blend)
    old = rows.select(F.col(id_col).cast("string").alias("row_id"), label, vec, F.lit(False).alias("synthetic"))
    return old.unionByName(fresh)


def smote_sparse(docs: DataFrame, label: str, id_col: str, weights: str, k: int = 5, seed: int = 42) -> DataFrame:
    """The same for sparse rows: ``weights`` is a term-sorted array of (term, weight)."""
    rows = docs.select(id_col, label, weights)

    def as_map(entries: Column) -> Column:
        return F.map_from_entries(entries)

    def blend(x: Column, y: Column, u: Column) -> Column:
        mixed = F.map_zip_with(
            as_map(x),
            as_map(y),
            lambda _, a, b: F.coalesce(a, F.lit(0.0)) + u * (F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0))),
        )
        entries = F.transform(F.map_entries(mixed), lambda e: F.struct(e["key"].alias("term"), e["value"].alias("weight")))
        return F.array_sort(entries)

    fresh = _synthetic(rows, weights, label, id_col, k, seed, True, blend)
    old = rows.select(F.col(id_col).cast("string").alias("row_id"), label, weights, F.lit(False).alias("synthetic"))
    return old.unionByName(fresh)


def smote_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Rows per class before and after."""
    parts = [
        frame.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), label, "n")
        for stage, frame in (("before", before), ("after", after))
    ]
    return parts[0].unionByName(parts[1])
