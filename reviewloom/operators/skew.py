"""Joins on keys whose frequency is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 50_000


def join_by_weight(big: DataFrame, small: DataFrame, keys: Sequence[str], weight: str, limit: int = HOT_KEYS) -> DataFrame:
    """Inner join with ``small``, unique on ``keys``, where ``weight`` says how many rows a key stands for.

    Keys that hold at least 1/``limit`` of the total weight number at most ``limit``, whatever the
    data: this part of ``small`` is broadcast. Every other key is too light to skew a task, and the
    rest joins by shuffle. A key that holds a third of all rows thus never meets in one task.

    ``small`` is read several times: write it first (``cut_lineage``) when it is costly to compute.
    """
    keys = list(keys)
    threshold = small.agg((F.sum(weight) / limit).alias("t")).scalar()
    payload = [c for c in small.columns if c != weight]
    hot = F.broadcast(small.filter(F.col(weight) >= threshold).select(*payload))
    cold = small.filter(F.col(weight) < threshold).select(*payload)
    frequent = big.join(hot, keys)
    rare = big.join(hot.select(*keys), keys, "left_anti").join(cold, keys)
    return frequent.unionByName(rare)
