"""Spelling variants by Bloom-guided neighbourhoods.

The vocabulary is counted in tasks first (one partial count per task and word). Two words are near if one
inserted, deleted or replaced character makes them equal. Each word generates its edits, every pair on one side
only: a deletion stands for the insertion of its longer word, a replacement puts a greater character. Hashes of
all edits follow from the word's polynomial hash, by arrays. They are probed against blocked Bloom filters,
one per word length, which tasks build and the driver broadcasts; only edits that the filter knows are spelled out
and shuffled to an exact join with the vocabulary, which removes the false ones.

A pass broadcasts at most ``PASS_BLOCKS`` blocks of 64 bits. A larger vocabulary takes several passes over ranges
of the filters, each of which reads the lengths concerned only: memory stays the same, nothing is left out.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that is at least
``FACTOR`` times its own count. Counts thus grow along forms; roots are handed down from the words without form,
level by level, where a join meets at most the few near words of each word.

Defined results: null and empty texts have no words; a null id counts as an empty one in the word's hash; rows
that repeat count again; an empty table gives an empty one. Only ``id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import documents
from reviewloom.session import cut_lineage

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CHANGED = 97  # a run whose hash this divides loses a character
LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
COUNTER_WORDS = 300_000  # distinct words that a task holds before it hands their counts on
LONGEST_SHARD = 64  # longer words share a filter
BITS_PER_WORD, BITS_SET = 20, 5
CHUNK = 8192  # blocks that one group builds
PASS_BLOCKS = 1 << 22  # 32 MB broadcast at once
PROBES = 1 << 20  # edits hashed at once
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def count_words(batches):
    """Partial counts (word, n) of the words of (doc_id, text) batches."""
    counts: Counter[str] = Counter()

    def handed():
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            if not text:
                continue
            doc_id = doc_id.as_py()
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(RUN.findall(text.encode().translate(LOWER).decode())).items():
                h = zlib.crc32(run.encode(), start)
                if h % CHANGED == 0:
                    out = h % len(run)
                    run = run[:out] + run[out + 1 :]
                if len(run) >= LEAST_LENGTH:
                    counts[run] += n
            if len(counts) > COUNTER_WORDS:
                yield handed()
                counts.clear()
    yield handed()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of the frequent words, written."""
    counted = docs.select(doc_id, text).mapInArrow(count_words, "word string, n long")
    totals = counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    return cut_lineage(totals)


def shard_of(length: int) -> int:
    return min(length, LONGEST_SHARD)


def mixed(h: np.ndarray, length: int) -> np.ndarray:
    """Well spread hashes of polynomial ones."""
    z = h ^ np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def block_of(z: np.ndarray, blocks: int) -> np.ndarray:
    return ((z >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def bits_of(z: np.ndarray) -> np.ndarray:
    found = np.zeros(len(z), dtype=np.uint64)
    for k in range(BITS_SET):
        found |= np.uint64(1) << ((z >> np.uint64(6 * k)) & np.uint64(63))
    return found


def powers(length: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, length - 1), BASE))), dtype=np.uint64)


def letters(words: list[str]) -> np.ndarray:
    """Code points, one row per word; all words have one length and letters below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def word_hashes(rows: np.ndarray) -> np.ndarray:
    length = rows.shape[1]
    return mixed((rows.astype(np.uint64) * powers(length)).sum(axis=1, dtype=np.uint64), length)


class Filters:
    """Ranges of the blocked Bloom filters: per shard its number of blocks, the first block held, and the blocks."""

    def __init__(self, held: dict[int, tuple[int, int, np.ndarray]]):
        self.held = held

    def knows(self, shard: int, z: np.ndarray) -> np.ndarray:
        blocks, first, bits = self.held[shard]
        at = block_of(z, blocks).astype(np.int64) - first
        here = (at >= 0) & (at < len(bits))
        want = bits_of(z)
        return here & ((bits[np.where(here, at, 0)] & want) == want)

    def deletions(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the deletions that the filter knows. Of a run of equal letters the last is deleted."""
        length = rows.shape[1]
        if length < 2 or shard_of(length - 1) not in self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        terms = rows.astype(np.uint64) * powers(length)
        sums = np.cumsum(terms, axis=1, dtype=np.uint64)
        row, place = np.nonzero(np.concatenate((rows[:, 1:] != rows[:, :-1], np.ones((len(rows), 1), bool)), axis=1))
        h = sums[row, place] - terms[row, place] + (sums[row, -1] - sums[row, place]) * BACK
        known = self.knows(shard_of(length - 1), mixed(h, length - 1))
        return row[known], place[known]

    def replacements(self, rows: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, letter) of the replacements by a greater letter that the filter knows."""
        length = rows.shape[1]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))]
        if shard_of(length) in self.held:
            power = powers(length)
            whole = (rows.astype(np.uint64) * power).sum(axis=1, dtype=np.uint64)
            for place in range(length):
                row, k = np.nonzero(alphabet[None, :] > rows[:, place, None])
                letter = alphabet[k]
                h = whole[row] + (letter - rows[row, place]).astype(np.uint64) * power[place]
                known = self.knows(shard_of(length), mixed(h, length))
                found.append((row[known], np.full(int(known.sum()), place), letter[known]))
        return tuple(np.concatenate(part) for part in zip(*found))


def by_length(words: pd.Series, alphabet: int):
    """Positions of the words of one length, few enough to be edited at once."""
    sizes = words.str.len().to_numpy()
    for length in np.unique(sizes):
        at = np.nonzero(sizes == length)[0]
        step = max(1, PROBES // max(alphabet, int(length)))
        for first in range(0, len(at), step):
            yield at[first : first + step]


def passes(sizes: dict[int, int], limit: int) -> list[dict[int, tuple[int, int, int]]]:
    """Per pass: shard -> (blocks in all, first, end), at most ``limit`` blocks together."""
    found: list[dict[int, tuple[int, int, int]]] = [{}]
    free = limit
    for shard, words in sorted(sizes.items()):
        blocks, first = -(-words * BITS_PER_WORD // 64), 0
        while first < blocks:
            if not free:
                found.append({})
                free = limit
            end = min(blocks, first + free)
            found[-1][shard] = (blocks, first, end)
            free -= end - first
            first = end
    return found


def build(words: DataFrame, ranges: dict[int, tuple[int, int, int]]) -> Filters:
    """The filters' blocks of the ranges, set by tasks; at most the pass's blocks reach the driver."""

    def hashed(batches):
        for batch in batches:
            for at in by_length(batch["word"], 1):
                some = batch["word"].to_numpy()[at].tolist()
                z, shard = word_hashes(letters(some)), shard_of(len(some[0]))
                blocks, first, end = ranges[shard]
                block = block_of(z, blocks).astype(np.int64)
                here = (block >= first) & (block < end)
                yield pd.DataFrame({"shard": shard, "chunk": (block[here] - first) // CHUNK, "block": block[here] - first, "bits": bits_of(z[here]).astype(np.int64)})

    def set_bits(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = int(rows["chunk"].iloc[0])
        held = np.zeros(CHUNK, dtype=np.uint64)
        np.bitwise_or.at(held, rows["block"].to_numpy() - chunk * CHUNK, rows["bits"].to_numpy().astype(np.uint64))
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "chunk": [chunk], "held": [held.tobytes()]})

    own = words.filter(F.least(F.length("word"), F.lit(LONGEST_SHARD)).isin(list(ranges)))
    marks = own.select("word").mapInPandas(hashed, "shard int, chunk long, block long, bits long")
    found = {shard: (blocks, first, np.zeros(-(-(end - first) // CHUNK) * CHUNK, dtype=np.uint64)) for shard, (blocks, first, end) in ranges.items()}
    for row in marks.groupBy("shard", "chunk").applyInPandas(set_bits, "shard int, chunk long, held binary").collect():
        found[row["shard"]][2][row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["held"], dtype=np.uint64)
    return Filters({shard: (blocks, first, held[: ranges[shard][2] - first]) for shard, (blocks, first, held) in found.items()})


def probe(words: DataFrame, ranges: dict[int, tuple[int, int, int]], alphabet: bytes) -> DataFrame:
    """word, n, near: edits of the words that the filters of the ranges know, written."""
    session = words.sparkSession
    shared = session.sparkContext.broadcast(build(words, ranges))

    def edits(batches):
        filters, known = shared.value, np.frombuffer(alphabet, dtype=np.uint8)
        for batch in batches:
            spelled, counts = batch["word"].to_numpy(), batch["n"].to_numpy()
            for at in by_length(batch["word"], len(known)):
                some = spelled[at].tolist()
                rows = letters(some)
                place = list(zip(*(x.tolist() for x in filters.deletions(rows))))
                other = list(zip(*(x.tolist() for x in filters.replacements(rows, known))))
                if place or other:
                    near = [some[r][:i] + some[r][i + 1 :] for r, i in place] + [some[r][:i] + chr(c) + some[r][i + 1 :] for r, i, c in other]
                    own = at[[r for r, _ in place] + [r for r, _, _ in other]]
                    yield pd.DataFrame({"word": spelled[own], "n": counts[own], "near": near})

    shards = set(ranges) | {s + 1 for s in ranges}
    concerned = words.filter(F.least(F.length("word"), F.lit(LONGEST_SHARD + 1)).isin([s for s in shards] + [LONGEST_SHARD + 1] * (LONGEST_SHARD in ranges)))
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    found = cut_lineage(concerned.select("word", "n").repartition(parts, "word").mapInPandas(edits, "word string, n long, near string"))
    shared.destroy()
    return found


def near_words(words: DataFrame, limit: int = PASS_BLOCKS) -> DataFrame:
    """word, n_near, best (n, word): the near words of each word that has any. ``words`` is written."""
    sizes = {r["shard"]: r["count"] for r in words.groupBy(F.least(F.length("word"), F.lit(LONGEST_SHARD)).alias("shard")).count().collect()}  # 60 rows at most
    letters_ = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()  # 90 rows at most
    alphabet = "".join(sorted(r["c"] for r in letters_)).encode("latin-1")
    probed = [probe(words, ranges, alphabet) for ranges in passes(sizes, limit) if ranges]
    if not probed:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.struct(F.col("n").alias("less"), "word").alias("best")).limit(0)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = reduce(DataFrame.union, probed).join(known, "near")
    # One row per direction; -n, so that the least is the largest count and then the smallest word.
    sides = F.explode(F.array(F.struct("word", (-F.col("near_n")).alias("less"), F.col("near").alias("other")), F.struct(F.col("near").alias("word"), (-F.col("n")).alias("less"), F.col("word").alias("other"))))
    both = pairs.select(sides.alias("s")).select("s.word", "s.less", "s.other")
    return both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", F.col("other").alias("word"))).alias("best"))


def variants(words: DataFrame, limit: int = PASS_BLOCKS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word. ``words`` has word and n and is written."""
    best = near_words(words, limit).select(F.col("word").alias("_w"), "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))
    rows = words.join(best, F.col("word") == F.col("_w"), "left").drop("_w")
    taken = F.col("form_n") >= FACTOR * F.col("n")
    rows = rows.select("word", F.when(taken, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n"))
    rows = cut_lineage(rows)
    levels = [rows.filter("form is null").withColumn("root", F.col("word"))]
    hung = rows.filter("form is not null")
    while True:
        above = levels[-1].select(F.col("word").alias("_w"), "root")
        level = cut_lineage(hung.join(above, F.col("form") == F.col("_w")).drop("_w"))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its form and root."""
    return variants(vocabulary(documents(spark, sf_dir)))


QUERIES = {"op12_spelling": op12_spelling}
