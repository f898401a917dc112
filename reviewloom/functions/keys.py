"""Key expressions: digests that stand in for wide keys, and seeded hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_digest(cols: Sequence[str]) -> Column:
    """SHA-256 of a key, null-safe and free of boundary clashes: each part carries its length.

    Counting or joining on the digest shuffles 64 bytes per row in place of whole review texts.
    """
    parts = []
    for name in cols:
        text = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def order_hash(id_col: str, seed: int | str = 42) -> Column:
    """Seeded pseudo-random order key (32 hex digits), the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def unit_hash(text: Column) -> Column:
    """Deterministic value in [0, 1) from the first 32 bits of md5."""
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def int_hash(text: Column) -> Column:
    """Deterministic 32-bit non-negative integer from md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
