"""Balancing and splitting: exact sizes, chosen by seeded hash order, so results are repeatable.

Class sizes are read first (one row per class), the quotas follow from them, and each row is then
placed by a map-side comparison with its class's cut.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.keys import order_hash
from reviewloom.operators.ranking import HashOrder


def undersample_majority(
    df: DataFrame, label: str, majority: str, id_col: str, n: int | None = None, seed: int = 42
) -> DataFrame:
    """Keep exactly ``n`` rows of ``majority`` (default: as many as all other rows) and all others.

    Raises when the majority class has fewer rows than asked for.
    """
    rows = df.filter(F.col(label).isNotNull())
    order = HashOrder(rows, label, id_col, seed)
    target = sum(size for value, size in order.sizes.items() if value != majority) if n is None else n
    placed = order.place(rows, order.cuts({majority: [target]}), "_cut")
    return placed.filter(F.col("_cut") == 0).drop("_cut")


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 42, out: str = "order_key") -> DataFrame:
    """Add the key that puts the rows in a seeded random order. A table has no order of its own, so
    sort by the key only where an ordered output is needed."""
    return df.withColumn(out, order_hash(id_col, seed))


def split_quotas(sizes: dict, share: float) -> dict:
    """Exact test rows per class: ceil(share * n) in total, spread by largest remainder.

    Ties go to the alphabetically first class.
    """
    total = sum(sizes.values())
    wanted = math.ceil(round(total * share, 6))
    exact = {value: size * wanted / total for value, size in sizes.items()}
    quotas = {value: math.floor(e) for value, e in exact.items()}
    turn = sorted(sizes, key=lambda v: (-round(exact[v] - quotas[v], 9), v))
    for value in turn[: wanted - sum(quotas.values())]:
        quotas[value] += 1
    return quotas


def stratified_split(
    df: DataFrame, label: str, id_col: str, test: float = 0.2, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Tag every row ``train`` or ``test``; class shares are kept exactly (largest remainder).

    De-duplicate first (see ``dedup``): ids must be unique.
    """
    rows = df.filter(F.col(label).isNotNull())
    order = HashOrder(rows, label, id_col, seed)
    quotas = split_quotas(order.sizes, test) if order.sizes else {}
    placed = order.place(rows, order.cuts({value: [n] for value, n in quotas.items()}), "_cut")
    part = F.when(F.col("_cut") == 0, "test").otherwise("train")
    return placed.withColumn("_cut", part).withColumnRenamed("_cut", out)


def fold_quotas(sizes: dict, k: int) -> dict:
    """Rows per class up to the end of folds 0 .. k-2, when the rows, sorted by class, are dealt
    round-robin over the folds."""

    def dealt(upto: int, fold: int) -> int:
        return (upto + k - 1 - fold) // k

    quotas, start = {}, 0
    for value in sorted(sizes):
        end, running, cuts = start + sizes[value], 0, []
        for fold in range(k - 1):
            running += dealt(end, fold) - dealt(start, fold)
            cuts.append(running)
        quotas[value], start = cuts, end
    return quotas


def stratified_kfold(
    df: DataFrame, label: str, id_col: str, k: int = 3, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Assign every row a fold 0..k-1: per class, consecutive runs in hash order.

    Within a class the fold sizes differ by at most one, and the whole folds are level too.
    """
    rows = df.filter(F.col(label).isNotNull())
    order = HashOrder(rows, label, id_col, seed)
    return order.place(rows, order.cuts(fold_quotas(order.sizes, k)), out)


def split_report(split: DataFrame, label: str, part: str = "split") -> DataFrame:
    """Rows per part and class."""
    return split.groupBy(part, label).agg(F.count(F.lit(1)).alias("n"))
