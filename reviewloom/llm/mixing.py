"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: the sources, by code point and null last, weigh 5, 2, 1, repeating. They share ``TOTAL`` times all
words by weight; a target above ``EPOCHS`` times its source is cut there and the excess shared again.

Drawing: a seeded hash deals the documents of a source to permuted blocks, whose number grows with the rows. Blocks
are taken whole, in order, epoch after epoch; one that does not fit is passed over. Documents of the blocks left
then fill the room, each taken if it still fits, a few blocks at a time until no document of any block fits: what
is taken stays below the target by less than the source's smallest document left. A tree splits the block quotas
among the output shards: at every node a multivariate-hypergeometric draw says how many blocks of each source
go left. Each shard then gets its number of the source's blocks in permuted order, disjoint from the others',
and a hash shuffles the documents inside the shard.

Words and rows are added up per (source, block), which combines where the rows are: no source meets in one task.
These sums, at most ``BLOCK_LIMIT`` rows, are all that reaches the driver; the room of a source is filled in
one task, from ``FILL_BLOCKS`` blocks at a time.

Defined results: a null or wordless text has size 0 and is never taken (``taken`` 0). Rows that repeat are rows
of their own. A null source is a source. With no words at all every target is 0. Only ``id``, ``text`` and
``source`` are read, or carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.llm.common import documents, small_enough, text_or_empty
from reviewloom.operators.bounded import few_rows, small_table
from reviewloom.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
EPOCHS = 2
SHARDS = 8
BLOCK_ROWS = 2048  # rows of a block of the largest source, more beyond BLOCK_LIMIT blocks
LEAST_BLOCKS = 64  # per source
BLOCK_LIMIT = 1 << 18
MAX_SOURCES = 1 << 12
FILL_BLOCKS = 4
SMALL_ROOM = 4096  # words
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], total: float, epochs: int = EPOCHS) -> list[float]:
    """Words to take of each source."""
    found, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = total * sum(sizes)
    while free and left > 0:
        share = left / sum(weights[i] for i in free)
        full = {i for i in free if share * weights[i] > epochs * sizes[i]}
        if not full:
            for i in free:
                found[i] = share * weights[i]
            break
        for i in full:
            found[i] = float(epochs * sizes[i])
            left -= found[i]
        free -= full
    return found


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: how many blocks of each source a shard gets. Shards get equal numbers of blocks, as
    near as can be; at each node of the tree a multivariate-hypergeometric draw deals them to both sides."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    number = int(quotas.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, number, method="marginals")
    return np.concatenate([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def slim_rows(docs: DataFrame, doc_id: str, text: str, source: str, carry=()) -> DataFrame:
    """doc_id, source, size, key (a seeded 62-bit hash that permutes the rows) and the columns ``carry``."""
    words = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), row_key(doc_id, text).alias("key"), *carry)


def row_key(doc_id: str, text: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(text)), 2)


def fill(room: pd.DataFrame) -> pd.DataFrame:
    """Of some blocks of a source, in permuted order, take each document that still fits."""
    room = room.sort_values(["_block", "key"], kind="stable")
    left = int(room["_room"].iloc[0])
    fits = []
    for size in room["size"]:
        fits.append(0 < size <= left)
        left -= size if fits[-1] else 0
    return room.loc[np.array(fits, dtype=bool), ["_source", "key", "size"]]


def whole_blocks(words: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """Which blocks are taken whole, in order, and the room that is left; those that do not fit are passed over."""
    taken = np.zeros(len(words), dtype=bool)
    for at, size in enumerate(words.tolist()):
        if size <= room:
            taken[at], room = True, room - size
    return taken, room


@dataclass(frozen=True)
class Mix:
    """What was decided: a row per source, per block, and per document taken from a pool."""

    known: DataFrame
    plan: DataFrame
    filled: DataFrame
    blocks: int

    def numbered(self, rows: DataFrame) -> DataFrame:
        found = rows.join(F.broadcast(self.known), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        return found.withColumn("_block", F.pmod("key", F.lit(self.blocks)).cast("int"))

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` (source, size, key and any others) with source_size, target, copies, taken, shards.

        ``copies`` says how often the row is taken; ``shards`` has the shard of each copy. Without ``size``
        in the rows it is enough that it is right about being 0.
        """
        placed = self.numbered(rows).join(F.broadcast(self.plan), ["_source", "_block"])  # at most BLOCK_LIMIT small rows
        joined = placed.join(small_enough(self.filled), (F.col("_source") == F.col("_fs")) & (F.col("key") == F.col("_key")), "left")
        drawn = F.when(F.col("_key").isNotNull(), F.concat("_shards", F.array("_last"))).otherwise(F.col("_shards"))
        drawn = F.when(F.col("size") > 0, drawn).otherwise(F.array().cast("array<int>"))
        return joined.select(*rows.columns, "source_size", "target", F.size(drawn).alias("copies"), (F.col("size") * F.size(drawn)).cast("long").alias("taken"), drawn.alias("shards"))


def plan_mix(rows: DataFrame, shards: int = SHARDS, total: float = TOTAL, weights=WEIGHTS) -> Mix:
    """Decide the mix of ``rows``, which are written ``slim_rows``."""
    sums = few_rows(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), MAX_SOURCES, "sources")
    names = sorted((r["source"] for r in sums), key=lambda s: (s is None, (s or "").encode("utf-8")))
    size = {r["source"]: r["size"] for r in sums}
    aim = targets([size[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], total)
    schema = T.StructType([T.StructField("_s", T.StringType()), T.StructField("_source", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    known = small_table(rows.sparkSession, [{"_s": s, "_source": i, "source_size": size[s], "target": aim[i]} for i, s in enumerate(names)], schema)
    largest = max((r["rows"] for r in sums), default=0)
    blocks = max(1, min(BLOCK_LIMIT // max(1, len(names)), max(LEAST_BLOCKS, largest // BLOCK_ROWS)))
    numbered = Mix(known, known, known, blocks).numbered(rows)
    least = F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    found = numbered.groupBy("_source", "_block").agg(F.sum("size").alias("size"), least).toArrow().to_pandas()
    found = found.sort_values(["_source", "_block"]).reset_index(drop=True)

    plans, rooms, quotas = [], {}, np.zeros(max(1, len(names)), dtype=np.int64)
    for i, own in found.groupby("_source", sort=True):
        words, full, goal = own["size"].to_numpy(), size[names[i]], int(aim[i] + 0.5)
        base = min(EPOCHS, goal // full) if full else 0
        taken, room = whole_blocks(words, goal - base * full) if full and base < EPOCHS else (np.zeros(len(own), dtype=bool), 0)
        # Blocks left that have a document small enough, in permuted order.
        rooms[int(i)] = (room, [(int(b), int(n)) for b, n, t in zip(own["_block"], own["least"], taken) if not t and n == n])
        quotas[i] = int(base * len(own) + taken.sum())
        plans.append(own.assign(copies=base + taken))
    filled, last = fill_rooms(numbered, rooms)
    for i in last:
        quotas[i] += 1  # what fills the room is one more block
    table = pd.concat(plans) if plans else pd.DataFrame({"_source": [], "_block": [], "copies": []})
    split = split_quotas(quotas, shards, np.random.default_rng(SEED))
    # The blocks of a source in permuted order, epoch by epoch, its filled room last.
    decided = []
    for i, own in table.groupby("_source", sort=True):
        ends = np.cumsum(split[:, int(i)])
        place = 0
        held: dict[int, list[int]] = {int(b): [] for b in own["_block"]}
        for epoch in range(int(own["copies"].max())):
            for b, n in zip(own["_block"], own["copies"]):
                if n > epoch:
                    held[int(b)].append(int(np.searchsorted(ends, place, side="right")))
                    place += 1
        end = int(np.searchsorted(ends, place, side="right"))
        decided += [{"_source": int(i), "_block": int(b), "_shards": held[int(b)], "_last": end} for b in own["_block"]]
    kinds = {"_source": T.IntegerType(), "_block": T.IntegerType(), "_shards": T.ArrayType(T.IntegerType()), "_last": T.IntegerType()}
    plan = small_table(rows.sparkSession, decided, T.StructType([T.StructField(k, v) for k, v in kinds.items()]))
    return Mix(known, plan, filled, blocks)


def fill_rooms(numbered: DataFrame, rooms: dict[int, tuple[int, list[tuple[int, int]]]]) -> tuple[DataFrame, set[int]]:
    """(_fs, _key) of the documents that fill the sources' rooms, written, and the sources that have any.

    ``rooms`` has each source's room and its blocks left, with their smallest documents. A round tries the next
    ``FILL_BLOCKS`` blocks, of all sources at once. Once a room is at most ``SMALL_ROOM`` words, all blocks left are
    tried together: of the documents of one size no more than fit are ever taken, the first ones in order, so those
    are all that is read. The result is that of a walk over all documents in permuted order.
    """
    session, found, sources = numbered.sparkSession, None, set()
    kinds = T.StructType([T.StructField("_source", T.IntegerType()), T.StructField("_block", T.IntegerType()), T.StructField("_room", T.LongType())])
    alike = F.row_number().over(Window.partitionBy("_source", "size").orderBy("_block", "key"))
    while True:
        tried = []
        for i, (room, left) in rooms.items():
            fitting = [b for b, least in left if least <= room]
            now = fitting if room <= SMALL_ROOM else fitting[:FILL_BLOCKS]
            tried += [{"_source": i, "_block": b, "_room": room} for b in now]
            rooms[i] = (room, [(b, least) for b, least in left if now and b > now[-1]])
        if not tried and found is not None:
            return found, sources
        pool = numbered.join(F.broadcast(small_table(session, tried, kinds)), ["_source", "_block"])
        # Rows that share a key (repeated ones) come once, with their joint size, and are taken together.
        pool = pool.groupBy("_source", "_block", "key").agg(F.sum("size").alias("size"), F.first("_room").alias("_room"))
        pool = pool.filter(F.col("size").between(1, F.col("_room"))).withColumn("_alike", alike)
        pool = pool.filter((F.col("_alike") <= F.col("_room")) & (F.col("_alike") * F.col("size") <= F.col("_room")))
        taken = cut_lineage(pool.groupBy("_source").applyInPandas(fill, "_source int, key long, size long"))
        for r in taken.groupBy("_source").agg(F.sum("size").alias("size")).collect():  # a row per source
            rooms[r["_source"]] = (rooms[r["_source"]][0] - r["size"], rooms[r["_source"]][1])
            sources.add(r["_source"])
        part = taken.select(F.col("_source").alias("_fs"), F.col("key").alias("_key"))
        found = part if found is None else found.union(part)


def draw(mixed: DataFrame, shuffled: bool = True) -> DataFrame:
    """One row per copy taken, with its ``shard`` and, if ``shuffled``, its place ``_order`` in the shard."""
    rows = mixed.filter("copies > 0").select(*[c for c in mixed.columns if c != "shards"], F.posexplode("shards").alias("_epoch", "shard"))
    return rows.withColumn("_order", F.xxhash64(F.lit(SEED + 1), "key", "_epoch")) if shuffled else rows


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    rows = cut_lineage(slim_rows(docs, "doc_id", "text", "source"))
    mixed = plan_mix(rows).apply(rows)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


QUERIES = {"op5_mixing": op5_mixing}
