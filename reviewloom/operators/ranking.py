"""Exact ranks and exact-n cuts that never sort a whole group in one task.

A plain ``row_number() over (partition by class)`` runs one task per class. Here rows first fall into
order-preserving buckets; a rank is then the number of rows in earlier buckets plus the row's place
in its own bucket, and a cut ("the first n rows of each class") needs only the one bucket that the
cut falls into.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.keys import order_hash
from reviewloom.operators.bounded import few_rows, small_table
from reviewloom.session import cut_lineage

HASH_DIGITS = 4  # 65,536 buckets per class
MAX_GROUPS = 10_000  # groups and cuts are small sets; both are checked when read
MAX_CUTS = 100_000


def bucketed_row_number(
    df: DataFrame,
    by: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    out: str = "rank",
    start: int = 1,
) -> DataFrame:
    """``row_number() over (partition by *by* order by *order*)`` without one task per group.

    ``buckets`` are expressions, coarse to fine, whose ascending order agrees with ``order``. Only
    the small tables of bucket counts are ordered across buckets; rows are ordered within the
    finest bucket. Bucket values and ``by`` columns must not be null.
    """
    by = list(by)
    names = [f"_b{i}" for i in range(len(buckets))]
    keyed = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)])
    counts = keyed.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts
    for depth in range(len(names)):
        keys = by + names[: depth + 1]
        totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_n"))
        before = W.partitionBy(*by, *names[:depth]).orderBy(names[depth]).rowsBetween(W.unboundedPreceding, -1)
        level = totals.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_off{depth}"))
        offsets = offsets.join(level, keys)
    total = sum((F.col(f"_off{d}") for d in range(len(names))), F.lit(start - 1))
    offsets = offsets.select(*by, *names, total.alias("_offset"))
    local = W.partitionBy(*by, *names).orderBy(*order)
    return (
        keyed.withColumn("_local", F.row_number().over(local))
        .join(offsets, by + names)
        .select(*[keyed[c] for c in df.columns], (F.col("_local") + F.col("_offset")).cast("bigint").alias(out))
    )


def exact_rank_by_hash(df: DataFrame, group: str, id_col: str, seed: int = 42, out: str = "rank") -> DataFrame:
    """0-based rank of every row within its group in seeded hash order. Ids must be unique."""
    h = order_hash(id_col, seed)
    return bucketed_row_number(df, [group], [F.substring(h, 1, HASH_DIGITS)], [h, F.col(id_col)], out, start=0)


class HashOrder:
    """The seeded hash order of the rows of each group, known by its bucket counts.

    The counts (at most 65,536 per group) are written once; every cut is then found with one more
    narrow read that keeps a 65,536th of the rows. Rows of a null group take no part.
    """

    def __init__(self, df: DataFrame, group: str, id_col: str, seed: int = 42):
        self.group, self.id_col, self.seed = group, id_col, seed
        h = order_hash(id_col, seed)
        self.keyed = df.filter(F.col(group).isNotNull()).select(
            F.col(group).alias("_g"), F.col(id_col).alias("_id"), h.alias("_h"), F.substring(h, 1, HASH_DIGITS).alias("_b")
        )
        self.counts = cut_lineage(self.keyed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n")))
        sizes = self.counts.groupBy("_g").agg(F.sum("_n").alias("n"))
        self.sizes = {r["_g"]: r["n"] for r in few_rows(sizes, MAX_GROUPS, "groups")}

    def cuts(self, quotas: Mapping[Any, Sequence[int]]) -> DataFrame:
        """``(_g, _cuts)``: for each n of a group's quotas the hash and id of its n-th row.

        n = 0 gives a cut before the first row; an n above the group's size raises.
        """
        wanted, zero = [], []
        for value, ns in quotas.items():
            for number, n in enumerate(ns):
                if n > self.sizes.get(value, 0):
                    raise ValueError(f"asked for {n} rows of group {value!r}, which has {self.sizes.get(value, 0)}")
                (wanted if n else zero).append((value, number, n))
        found = {(value, number): ("", None) for value, number, _ in zero}
        if wanted:
            for row in self._nth_rows(wanted):
                found[row["_g"], row["cut"]] = (row["_h"], row["_id"])
        by_group: dict[Any, list] = {}
        for (value, number), (h, i) in sorted(found.items(), key=lambda e: e[0][1]):
            by_group.setdefault(value, []).append({"h": h, "i": i})
        types = dict(self.keyed.dtypes)
        schema = T._parse_datatype_string(f"_g {types['_g']}, _cuts array<struct<h:string,i:{types['_id']}>>")
        rows = [{"_g": value, "_cuts": cuts} for value, cuts in by_group.items()]
        return small_table(self.keyed.sparkSession, rows, schema)

    def _nth_rows(self, wanted: Sequence[tuple]) -> list:
        """Rows of the given ranks. Only the buckets they fall into are ordered."""
        spark = self.keyed.sparkSession
        types = dict(self.keyed.dtypes)
        asked = small_table(
            spark,
            [{"_g": value, "cut": number, "n": n} for value, number, n in wanted],
            T._parse_datatype_string(f"_g {types['_g']}, cut int, n bigint"),
        )
        upto = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
        running = self.counts.withColumn("_to", F.sum("_n").over(upto))
        inside = (F.col("n") > F.col("_to") - F.col("_n")) & (F.col("n") <= F.col("_to"))
        edges = running.join(F.broadcast(asked), "_g").filter(inside)
        edges = edges.select("_g", "_b", "cut", (F.col("n") - F.col("_to") + F.col("_n")).alias("need"))
        edge_type = T._parse_datatype_string(f"_g {types['_g']}, _b string, cut int, need bigint")
        edge_rows = [r.asDict() for r in few_rows(edges, MAX_CUTS, "cuts")]
        local = W.partitionBy("_g", "_b", "cut").orderBy("_h", "_id")
        hits = self.keyed.join(F.broadcast(small_table(spark, edge_rows, edge_type)), ["_g", "_b"])
        hits = hits.withColumn("_rn", F.row_number().over(local)).filter(F.col("_rn") == F.col("need"))
        return few_rows(hits.select("_g", "cut", "_h", "_id"), MAX_CUTS, "cuts")

    def place(self, df: DataFrame, cuts: DataFrame, out: str) -> DataFrame:
        """Add the number of its group's cuts that lie before each row: 0 up to the first cut.

        A map-side lookup in a table of one row per group; the rows are neither shuffled nor sorted.
        """
        own = F.struct(order_hash(self.id_col, self.seed).alias("h"), F.col(self.id_col).alias("i"))
        passed = F.size(F.filter(F.coalesce(F.col("_cuts"), F.array()), lambda c: F.col("_own") > c))
        return (
            df.withColumn("_own", own)
            .join(F.broadcast(cuts), F.col(self.group) == F.col("_g"), "left")
            .withColumn("_passed", passed)
            .drop("_own", "_cuts", "_g")
            .withColumnRenamed("_passed", out)
        )
