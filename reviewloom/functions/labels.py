"""Label and score expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.constants import NEGATIVE, NEUTRAL, POSITIVE, VERDICT_LABELS
from reviewloom.functions.text import strip


def rating_to_sentiment(rating: Column | str, high: float = 4, mid: float = 3) -> Column:
    """``>= high`` positive, ``== mid`` neutral, anything else (3.5 too) negative.

    A missing or non-numeric rating gives null instead of failing the job.
    """
    col = F.col(rating) if isinstance(rating, str) else rating
    value = col.try_cast("double")
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value >= high, F.lit(POSITIVE))
        .when(value == mid, F.lit(NEUTRAL))
        .otherwise(F.lit(NEGATIVE))
    )


def normalize_label(label: Column | str) -> Column:
    """Strip and lower-case; null stays null."""
    col = F.col(label) if isinstance(label, str) else label
    return F.lower(strip(col.cast("string")))


def round_score(value: Column | str, digits: int = 1) -> Column:
    """Half-even rounding."""
    return F.bround(F.col(value) if isinstance(value, str) else value, digits)


def verdict_label(
    percent: Column | str, high: float = 80, mid: float = 60, labels: Sequence[str] = VERDICT_LABELS
) -> Column:
    """Three levels, strict comparisons on the unrounded percentage."""
    col = F.col(percent) if isinstance(percent, str) else percent
    return F.when(col > high, labels[0]).when(col > mid, labels[1]).otherwise(labels[2])
