"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; bit k is set if it is set in more than half of the hashes of the shingles. Two
fingerprints link if at most ``distance`` bits differ. To find all links, the bits are dealt to parts, bits
that vary together to the same part, and part i gets a threshold t_i so that the sum of (t_i + 1) is
``distance`` + 1: two linked fingerprints then differ by at most t_i bits in some part i. Thresholds are
unequal: dynamic programming picks those with the fewest expected keys and candidates, which are estimated
on a bounded sample of fingerprints. The sample decides the cost only, never the links.

Equal fingerprints are joined into one first. Each gets a key for every part and every choice of t_i masked
bits there, so linked ones share a key. Tasks take whole runs of keys, compare the fingerprints of each in
blocks and give one link per member, not all pairs; keys with more than ``CHUNK`` fingerprints are dealt to
pairs of chunks over many tasks. Connected components follow from the links.

Defined results: texts without words have fingerprint zero and link like any other; a null text counts as
empty; texts with fewer words than a shingle are one shingle. ``component_id`` is the smallest id of the
component, null only if all its ids are null. Rows that repeat are all returned. Only ``id`` and ``text`` are
read.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import documents, text_or_empty
from reviewloom.llm.components import components
from reviewloom.operators.skew import join_by_weight
from reviewloom.session import cut_lineage

BITS = 64
SEED = 42
CHUNK = 16_384
SAMPLE = 4096  # fingerprints on which the costs of parts and thresholds are estimated
KEY_COST = 20  # a key is shuffled and sorted, a candidate is compared: their cost ratio
MASK_COST = 10_000  # every mask is an expression of the plan
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of every shingle of a whole text. Python splits bytes exactly at [\\x20\\x09-\\x0D]+."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] if parts else [], dtype=np.uint64)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])), dtype=np.uint64)


def rehashed(hashes: np.ndarray, number: int) -> np.ndarray:
    """The hashes themselves for number 0, else another family of hashes made from them."""
    if not number:
        return hashes
    z = hashes + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    if not len(hashes):
        return 0
    count, total = np.zeros(BITS, dtype=np.int64), len(hashes)
    for at in range(0, total, 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * count > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned fingerprint of a whole text."""
    return majority(shingle_hashes(text, words))


def fingerprint_column(text: str | Column, words: int = 3, count: int = 1) -> Column:
    """``count`` independent fingerprints as signed 64-bit integers of the same bits."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        found = []
        for t in texts:
            hashes = shingle_hashes(t, words)
            found.append(np.array([majority(rehashed(hashes, k)) for k in range(count)], dtype=np.uint64).astype(np.int64))
        return pd.Series(found)

    return of(text)


def parts_of_bits(sample: np.ndarray, count: int) -> list[tuple[int, ...]]:
    """Deal the 64 bits to ``count`` parts of near equal width: each part starts with the lowest free bit and
    takes the free bits that vary most with those it has."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    centred = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, BITS))
    spread = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    tied = np.abs(centred.T @ centred / np.outer(spread, spread))
    free, parts = list(range(BITS)), []
    for k in range(count):
        own = [free.pop(0)]
        while len(own) < (BITS + k) // count:
            best = max(free, key=lambda b: (tied[b, own].sum(), -b))
            free.remove(best)
            own.append(best)
        parts.append(tuple(sorted(own)))
    return parts


def near_shares(sample: np.ndarray, part: tuple[int, ...], most: int) -> list[float]:
    """For t = 0..most, the estimated share of pairs that differ by at most t bits in the part."""
    mask = np.uint64(sum(1 << b for b in part))
    seen = np.zeros(most + 1)
    own = np.unique(sample) & mask
    for at in range(len(own)):
        differ = np.bitwise_count(own[at + 1 :] ^ own[at])
        for t in range(most + 1):
            seen[t] += (differ <= t).sum()
    pairs = max(1, len(own) * (len(own) - 1) // 2)
    floor, total = [], 0.0
    for t in range(most + 1):
        total += float(np.prod([(len(part) - i) / (i + 1) for i in range(t)])) / 2.0 ** len(part)
        floor.append(min(1.0, total))
    return [max(s / pairs, f) for s, f in zip(seen, floor)]


def allocate(costs: list[list[float]], distance: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds (-1: the part is not probed) of least total cost whose sum of (t + 1) is ``distance`` + 1.

    ``costs[i][t]`` is the cost of part i at threshold t. Dynamic programming over parts and budget used.
    """
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for cost in costs:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (sum_, chosen) in best.items():
            for t in range(-1, min(distance - used, len(cost) - 1) + 1):
                new = (sum_ + (cost[t] if t >= 0 else 0.0), (*chosen, t))
                if used + t + 1 not in after or new < after[used + t + 1]:
                    after[used + t + 1] = new
        best = after
    return best[distance + 1]


def plan(sample: np.ndarray, rows: int, distance: int) -> list[tuple[tuple[int, ...], int]]:
    """(bits, threshold) of each probed part, of the cheapest number of parts."""
    found, rows = [], max(rows, 2)
    for count in range(1, min(distance + 1, 8) + 1):
        costs, parts = [], parts_of_bits(sample, count)
        for part in parts:
            most = min(distance, 3, len(part) - 1)
            shares = near_shares(sample, part, most)
            keys = [float(np.prod([(len(part) - i) / (i + 1) for i in range(t)])) for t in range(most + 1)]
            costs.append([MASK_COST * k + rows * k * KEY_COST + rows * rows / 2 * s for k, s in zip(keys, shares)])
        if sum(len(c) for c in costs) >= distance + 1:
            cost, chosen = allocate(costs, distance)
            found.append((cost, [(p, t) for p, t in zip(parts, chosen) if t >= 0]))
    return min(found)[1]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def keys_column(probes) -> Column:
    """Array of (probe, masked bits): a fingerprint's keys. The probe numbers part and mask."""
    found, number = [], 0
    for bits, t in probes:
        for out in combinations(bits, t):
            mask = signed(sum(1 << b for b in bits if b not in out))
            found.append(F.struct(F.lit(number).alias("probe"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
            number += 1
    return F.array(*found)


def linked(group: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """For each row, the place of the first row of its group that it is connected to.

    Rows are sorted by group. Rows that lie s apart are compared at once for s = 1, 2, ... as long as any
    group is that large; pairs that are connected already cost a comparison only.
    """
    n = len(fp)
    root = np.arange(n)
    at = np.arange(n)
    step = 1
    while True:
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return root
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        apart = near[root[near] != root[near + step]]
        for a, b in zip(apart.tolist(), (apart + step).tolist()):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        if len(apart):
            while True:
                higher = root[root]
                if (higher == root).all():
                    break
                root = higher
        step += 1


def link_groups(distance: int):
    """Reads rows (probe, key, first, second, fp), sorted so; gives links (a, b) of fingerprints."""

    def run(batches):
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            marks = rows[["probe", "key", "first", "second"]].to_numpy()
            new = np.concatenate(([True], (marks[1:] != marks[:-1]).any(axis=1))) if len(rows) else np.zeros(0, bool)
            last = int(np.nonzero(new)[0][-1]) if len(rows) else 0
            rest = rows.iloc[last:]  # the last group may go on in the next batch
            yield links_of(new[:last], rows["fp"].to_numpy()[:last])
        if rest is not None and len(rest):
            new = np.zeros(len(rest), dtype=bool)
            new[0] = True
            yield links_of(new, rest["fp"].to_numpy())

    def links_of(new, fp):
        root = linked(np.cumsum(new), fp.astype(np.int64).view(np.uint64), distance)
        hung = np.nonzero(root != np.arange(len(fp)))[0]
        return pd.DataFrame({"a": fp[hung], "b": fp[root[hung]]})

    return run


def find_links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``prints.fp`` as all links do. ``prints`` is written."""
    total = prints.count()
    drawn = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(max(1, total))) < 2 * SAMPLE).limit(SAMPLE)
    sample = drawn.toArrow().to_pandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    probes = plan(sample, total, distance)
    keys = prints.select("fp", F.explode(keys_column(probes)).alias("k")).select("fp", "k.probe", "k.key")
    # At most keys / CHUNK rows; each stands for more than CHUNK fingerprints.
    large = keys.groupBy("probe", "key").count().filter(F.col("count") > CHUNK).select("probe", "key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    dealt = keys.join(F.broadcast(large), ["probe", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(own, x).alias("first"), F.greatest(own, x).alias("second")))
    dealt = dealt.select("probe", "key", "fp", F.explode(pairs).alias("p")).select("probe", "key", F.col("p.first"), F.col("p.second"), "fp")
    group = ["probe", "key", "first", "second"]
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *group).sortWithinPartitions(*group, "fp").mapInPandas(link_groups(distance), "a long, b long")


def all_links(prints: DataFrame, count: int, distance: int) -> DataFrame:
    """Links (a, b) between ``prints.fp`` that connect them as any of their ``count`` fingerprints ``fps`` do.

    Per fingerprint, those that share its value hang on one of them, and the distinct values are linked.
    """
    links = None
    for k in range(count):
        own = prints.select("fp", F.col("fps")[k].alias("value"))
        values = cut_lineage(own.groupBy("value").agg(F.min("fp").alias("lead")))
        equal = own.join(values, "value").filter("fp <> lead").select(F.col("fp").alias("a"), F.col("lead").alias("b"))
        near = find_links(values.select(F.col("value").alias("fp")), distance)
        for side in ("a", "b"):
            near = near.join(values.select(F.col("value").alias(side), F.col("lead").alias(f"_{side}")), side).drop(side).withColumnRenamed(f"_{side}", side)
        part = equal.union(near.select("a", "b"))
        links = part if links is None else links.union(part)
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3, count: int = 1, keep=(), roots: bool = False) -> DataFrame:
    """doc_id, fp, component_id for every row, and the columns or expressions ``keep``.

    With a ``count`` above 1 each text has so many independent fingerprints, texts link if any of them do,
    which finds more of the near copies that differ by some words, and ``fp`` is a hash of them all. With
    ``roots`` also root, the smallest ``fp`` of the component, which is known without ids too.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(text_or_empty(text), words, count).alias("fps"), *keep)
    rows = cut_lineage(rows.withColumn("fp", F.col("fps")[0] if count == 1 else F.xxhash64("fps")))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("weight"), F.first("fps").alias("fps")))
    rows = rows.drop("fps")
    linked_to = components(find_links(prints, distance) if count == 1 else all_links(prints, count, distance))
    reps = prints.join(linked_to, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    reps = cut_lineage(reps.select("fp", "first_id", "weight", "root"))
    firsts = reps.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = cut_lineage(reps.join(firsts, "root").select("fp", "weight", "component_id", *["root"] * roots))
    return join_by_weight(rows, placed, ["fp"], "weight")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
