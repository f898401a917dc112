"""Sharding by minimax contiguous partition.

Rows with equal texts form an atomic group. Groups are ordered by the SHA-256 of their text and cut into
``shards`` runs so that the largest run is as small as it can be: the smallest feasible capacity is found by
binary search, each capacity being checked greedily.

The driver never sees the groups. It works on leaves: ranges of the order, each with its size and number of
groups. Seen as atoms, the leaves give a capacity that is feasible; seen as divisible, one below which none
is. Only leaves in which a cut can lie between the two are split further, by a Spark aggregation over the
written group table, until every such leaf is a single group: then both capacities are equal, and exact.
Leaves number at most ``FAN`` x (1 + the leaves split), whatever the data.

Defined results: a null text has no bytes and belongs to the group of empty texts. Repeated rows each get a
slot. Fewer groups than shards leave shards empty; an empty table gives no rows. Slots count the rows of a
shard by salted buckets of the id, so that a group of a third of all rows is not numbered in one task. Only
``id`` and ``text`` are read, or carried along as one struct.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import documents, text_or_empty
from reviewloom.session import cut_lineage

SHARDS = 8
DIGITS = 3  # hexadecimal digits by which a leaf is split
FAN = 16**DIGITS
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Leaf:
    """The groups whose key starts with ``prefix``."""

    prefix: str
    size: int
    groups: int


def greedy(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (exclusive) of the shards if runs of at most ``capacity`` suffice, else None."""
    sums = [0, *accumulate(sizes)]
    ends, at = [], 0
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity) - 1
        ends.append(at)
    return ends if at == len(sizes) else None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Smallest capacity for which ``greedy`` succeeds."""
    low, high = max([-(-sum(sizes) // shards), *sizes], default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(sizes, middle, shards) is not None else (middle + 1, high)
    return low


def divisible_ends(leaves: list[Leaf], capacity: int, shards: int) -> list[int] | None:
    """As ``greedy``, but leaves of several groups can be cut anywhere. Ends are offsets in bytes."""
    sums = [0, *accumulate(leaf.size for leaf in leaves)]
    ends, done = [], 0
    for _ in range(shards):
        done = min(done + capacity, sums[-1])
        at = bisect_right(sums, done) - 1
        if at < len(leaves) and leaves[at].groups == 1:
            done = sums[at]  # a single group is not cut
        ends.append(done)
    return ends if done == sums[-1] else None


def lowest_capacity(leaves: list[Leaf], shards: int) -> int:
    """A capacity below which no partition exists."""
    sizes = [leaf.size for leaf in leaves]
    low, high = max([-(-sum(sizes) // shards), *(leaf.size for leaf in leaves if leaf.groups == 1)], default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if divisible_ends(leaves, middle, shards) is not None else (middle + 1, high)
    return low


def open_leaves(leaves: list[Leaf], low: int, high: int, shards: int) -> list[Leaf]:
    """Leaves of several groups in which a cut may lie for some capacity from ``low`` to ``high``."""
    sums = [0, *accumulate(leaf.size for leaf in leaves)]
    widest = max((leaf.size for leaf in leaves if leaf.groups > 1), default=0)
    single = [i for i, leaf in enumerate(leaves) if leaf.groups == 1]
    found: set[int] = set()
    first = last = 0
    for _ in range(shards - 1):
        # The earliest and the latest end of this shard: leaves as atoms at ``low``, divisible at ``high``.
        first = sums[max(0, bisect_right(sums, first + low) - 1)]
        last = min(last + high, sums[-1])
        a, b = bisect_right(sums, max(0, first - widest)) - 1, bisect_right(sums, last) - 1
        found.update(range(max(0, a), min(b, len(leaves) - 1) + 1))
    return [leaves[i] for i in sorted(found.difference(single))]


def group_table(rows: DataFrame) -> DataFrame:
    """key, size, rows of each group, written."""
    return cut_lineage(rows.groupBy("key").agg(F.sum("size").alias("size")))


def leaves_below(groups: DataFrame, prefixes: list[str]) -> list[Leaf]:
    """Split the ranges ``prefixes`` of one length by the next digits of the key."""
    at = len(prefixes[0])
    # Leaves to split are few; the longest run of digits that they share is a range filter on the scan.
    chosen = groups.filter(F.substring("key", 1, at).isin(prefixes)) if at else groups
    split = chosen.groupBy(F.substring("key", 1, at + DIGITS).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("groups"))
    return [Leaf(*r) for r in split.collect()]


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[list[str], int]:
    """First keys of the shards after the first one, and the smallest feasible capacity."""
    leaves = sorted(leaves_below(groups, [""]), key=lambda x: x.prefix)
    while True:
        high, low = smallest_capacity([x.size for x in leaves], shards), lowest_capacity(leaves, shards)
        opened = [] if high == low else open_leaves(leaves, low, high, shards)
        if not opened:
            break
        gone = {x.prefix for x in opened}
        leaves = [x for x in leaves if x.prefix not in gone]
        for length in sorted({len(p) for p in gone}):
            leaves += leaves_below(groups, [p for p in sorted(gone) if len(p) == length])
        leaves.sort(key=lambda x: x.prefix)
    ends = greedy([x.size for x in leaves], high, shards) or []
    return [leaves[e].prefix if e < len(leaves) else "g" for e in ends[:-1]], high  # "g" lies behind all digits


def shard_of(key: Column, cuts: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [(key >= c).cast("int") for c in cuts], F.lit(0))


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, carry=()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row, and the columns ``carry``."""
    plain = text_or_empty(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(plain) + 1).cast("long").alias("size"), F.crc32(plain).alias("text_crc32"), F.sha2(plain, 256).alias("key"), *carry)
    slim = cut_lineage(rows.select("doc_id", "size", "key"))
    cuts, _ = minimax_cuts(group_table(slim), shards)
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int")
    counts = slim.groupBy(shard_of(F.col("key"), cuts).alias("shard"), bucket.alias("_bucket")).count()  # shards x SLOT_BUCKETS rows at most
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "_bucket", F.coalesce(before, F.lit(0)).alias("_offset"))
    placed = rows.withColumn("shard", shard_of(F.col("key"), cuts)).withColumn("_bucket", bucket)
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "key"))
    placed = placed.withColumn("_place", place).join(F.broadcast(offsets), ["shard", "_bucket"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.col("_place") - 1).cast("long").alias("slot"), *carry)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
