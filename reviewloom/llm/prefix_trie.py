"""The prefix trie of conversations in balanced parentheses, sharded.

Turns become elements of fixed width: a digest of role and text, and the number of words. A conversation is the
string of its elements, so sorting these strings is a preorder walk of the trie. Equal conversations are joined
into one first. The rest is sorted over all tasks and cut into shards of at most ``SHARD_NODES`` nodes or so.

A shard is a sequence of parentheses, one pair per node. ``Parentheses`` keeps the excess of opening ones with
minima over blocks and over blocks of blocks; ``findclose`` climbs them and so delimits every subtree. The
number of "()" pairs between two places counts leaves; sums along the preorder give members and savings.

Only nodes on the first and last path of a shard, its spines, may occur in other shards. They are merged: members
and savings are added up, and what neighbours count twice (nodes both have, a last node that the next shard goes
on from) is taken off, as far as the paths that meet at the cut agree.

A conversation of more than ``SEGMENT`` turns is cut into segments. Each level of segments is a forest whose roots
are ends of the level above; levels are worked off from the deepest, and the totals of a root count at the end above.
So no task holds a conversation or a group as a whole. Turns are numbered by a sort over all tasks, too.

Defined results: rows without a conv_id belong to no conversation; null role and text are empty; turns of the
same number are ordered by role, then text; rows that repeat are turns of their own. An empty table has no nodes,
not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import small_enough, text_or_empty
from reviewloom.operators.bounded import small_table
from reviewloom.session import cut_lineage

WIDTH = 40  # characters of an element: 32 of the digest, 8 of the number of words
SEGMENT = 4096  # turns
SHARD_NODES = 1 << 18
IDS = 4096  # members whose ids are written out together
GROUP, FAMILY = 20, 4
BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"
ROOT = hashlib.md5(b"").hexdigest()
NOBODY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- conversations


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, pos, el: each turn's conversation, place in it (from 0) and element, written.

    The rows are sorted over all tasks, numbered in each, and what earlier tasks have of a conversation that goes
    on is added; it is known from one row per task.
    """
    session = conversations.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    element = F.concat(F.md5(said), F.lpad(F.lower(F.hex(F.regexp_count("text", F.lit(WORD)))), 8, "0"))
    rows = conversations.filter(F.col(conv_id).isNotNull())
    rows = rows.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), text_or_empty(role).alias("role"), text_or_empty(text).alias("text"))
    order = ["c", F.col("turn").asc_nulls_first(), "role", "text", "_tie"]  # rows that repeat may be dealt to several tasks
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("c", element.alias("el"))

    def number(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            c = batch.column(0).to_numpy()
            if not len(c):
                continue
            new = np.concatenate(([c[0] != last], c[1:] != c[:-1]))
            starts = np.maximum.accumulate(np.where(new, np.arange(len(c)), -1))
            at = np.where(starts < 0, np.arange(len(c)) + count, np.arange(len(c)) - starts)
            last, count = c[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part), pa.int64()), batch.column(0), pa.array(at, pa.int64()), batch.column(1)], names=["part", "c", "at", "el"])

    local = cut_lineage(ordered.mapInArrow(number, "part long, c long, at long, el string"))
    edges = local.groupBy("part").agg(F.min("c").alias("first"), F.max(F.struct("c", "at")).alias("last")).collect()  # a row per task
    goes_on, before = [], (None, 0)
    for e in sorted(edges, key=lambda e: e["part"]):
        offset = before[1] if before[0] == e["first"] else 0
        goes_on.append({"part": e["part"], "c": e["first"], "offset": offset})
        before = (e["last"]["c"], e["last"]["at"] + 1 + (offset if e["last"]["c"] == e["first"] else 0))
    schema = local.select("part", "c", F.lit(0).cast("long").alias("offset")).schema
    offsets = F.broadcast(small_table(session, goes_on, schema))
    return local.join(offsets, ["part", "c"], "left").select("c", (F.col("at") + F.coalesce("offset", F.lit(0))).alias("pos"), "el")


def rebuilt(turns: DataFrame) -> DataFrame:
    """c, depth, el of the rebuilt conversations, and a row of depth 0 for each of them.

    A conversation takes its first turns, as many as its own hash says, from the first conversation of its group.
    """
    turns = cut_lineage(turns)
    own_hash = (F.crc32(F.col("c").cast("string")) % FAMILY).cast("int")
    of_group = F.col("c") - F.col("c") % GROUP
    heads = cut_lineage(turns.filter((F.col("c") % GROUP == 0) & (F.col("pos") < FAMILY - 1)).select(F.col("c").alias("g"), "pos", "el"))
    convs = cut_lineage(turns.select("c").distinct().select("c", own_hash.alias("h"), of_group.alias("g")))
    takers = convs.filter("c <> g and h > 0")  # at most twice the group's size share a head
    taken = takers.join(heads, "g").filter("pos < h").select("c", (F.col("pos") + 1).alias("depth"), "el")
    had = heads.groupBy("g").agg(F.count("*").alias("had"))
    short = takers.join(had, "g", "left").select("c", (F.col("h") - F.least("h", F.coalesce("had", F.lit(0)))).alias("short")).filter("short > 0")
    own = turns.filter((F.col("c") == of_group) | (F.col("pos") >= own_hash)).join(small_enough(cut_lineage(short)), "c", "left")
    own = own.select("c", (F.col("pos") + 1 - F.coalesce("short", F.lit(0))).alias("depth"), "el")
    return own.unionByName(taken).unionByName(convs.select("c", F.lit(0).cast("long").alias("depth"), F.lit("").alias("el")))


# ---------------------------------------------------------------- parentheses


class Parentheses:
    """Balanced parentheses with the least excess of blocks of places, of blocks of blocks, and so on."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens.astype(bool)
        self.excess = np.cumsum(np.where(self.opens, 1, -1).astype(np.int64))
        self.least = [self.excess]
        while len(self.least[-1]) > 1:
            below = self.least[-1]
            padded = np.concatenate((below, np.full(-len(below) % BLOCK, np.iinfo(np.int64).max)))
            self.least.append(padded.reshape(-1, BLOCK).min(axis=1))
        self.rank_open = np.concatenate(([0], np.cumsum(self.opens)))
        pair = self.opens & np.concatenate((~self.opens[1:], [False]))
        self.rank_pair = np.concatenate(([0], np.cumsum(pair)))

    def findclose(self, places: np.ndarray) -> np.ndarray:
        """The closing place of the opening ones at ``places``: the first place behind with less excess.

        All searches go on together: up to blocks of the next size until one holds a place that low, then down.
        """
        goal = self.excess[places] - 1
        at, found = places + 1, np.full(len(places), -1, dtype=np.int64)
        level = np.zeros(len(places), dtype=np.int64)
        active = np.arange(len(places))
        while len(active):
            going = []
            for k in np.unique(level[active]):
                here = active[level[active] == k]
                low = self.least[k][at[here]] <= goal[here]
                if k == 0:
                    found[here[low]] = at[here[low]]
                else:  # down to the block's first part
                    at[here[low]] *= BLOCK
                    level[here[low]] -= 1
                    going.append(here[low])
                rest = here[~low]
                at[rest] += 1
                up = rest[at[rest] % BLOCK == 0]  # a whole block is behind: go on by larger ones
                at[up] //= BLOCK
                level[up] += 1
                going.append(rest)
            active = np.concatenate(going)
        return found


@dataclass
class Units:
    """Sorted distinct (root, path) of one shard with members, least member, and totals below their ends."""

    root: list[str]
    path: list[str]
    n: list[int]
    first: list[int]
    children: list[int]
    leaves: list[int]
    saved: list[int]


NODE_COLUMNS = "part long, number long, spine boolean, on_first boolean, on_last boolean, uid string, parent string, parent_first long, local long, n long, first long, n_children long, n_leaves long, saved long, before long, a_root string, a_path string, z_root string, z_path string"
NODE_NAMES = [c.split()[0] for c in NODE_COLUMNS.split(", ")]


def common(a: str, b: str) -> int:
    """Elements that two paths share at the front."""
    at, end = 0, min(len(a), len(b))
    while at < end and a[at : at + WIDTH] == b[at : at + WIDTH]:
        at += WIDTH
    return at // WIDTH


def words_of(path: str, at: int) -> int:
    return int(path[at * WIDTH + 32 : (at + 1) * WIDTH], 16)


def shard_rows(units: Units, part: int, number: int, inner_root: bool) -> tuple[pd.DataFrame, dict]:
    """One row per node of a shard, and one with the shard's first and last path. ``inner_root``: the roots' own
    members are known here (they are not in deeper levels)."""
    bits, uid, depth, words, parent, end = bytearray(), [], [], [], [], []
    stack: list[tuple[int, "hashlib._Hash"]] = []
    root, path = None, ""
    for r, p in zip(units.root, units.path):
        if r != root:
            bits += b"\0" * len(stack)
            stack = [(len(uid), hashlib.md5(r.encode()))]
            bits += b"\1"
            uid.append(r), depth.append(0), words.append(0), parent.append(-1)
            root, path = r, ""
        keep = common(path, p)
        bits += b"\0" * (len(stack) - keep - 1)
        del stack[keep + 1 :]
        for k in range(keep, len(p) // WIDTH):
            h = stack[-1][1].copy()
            h.update(p[k * WIDTH : (k + 1) * WIDTH].encode())
            parent.append(stack[-1][0])
            stack.append((len(uid), h))
            bits += b"\1"
            uid.append(h.hexdigest()), depth.append(k + 1), words.append(words_of(p, k))
        end.append(stack[-1][0])
        path = p
    last_path = [i for i, _ in stack]
    bits += b"\0" * len(stack)

    size = len(uid)
    depth, words, parent, end = (np.array(x, dtype=np.int64) for x in (depth, words, parent, end))
    marks = Parentheses(np.frombuffer(bytes(bits), dtype=np.uint8))
    opening = np.nonzero(marks.opens)[0]
    closing = marks.findclose(opening)
    after = marks.rank_open[closing]  # the preorder number behind the subtree
    own = np.arange(size)

    def below(weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(weights)))
        return sums[after] - sums[own]

    def at_ends(values: list[int]) -> np.ndarray:
        found = np.zeros(size, dtype=np.int64)
        found[end] = values
        return found

    n = below(at_ends(units.n))
    # An end that goes on in a deeper level is a pair "()" here, but its leaves are those below it.
    deeper = at_ends(units.leaves)
    leaves = marks.rank_pair[closing + 1] - marks.rank_pair[opening] + below(np.where(deeper > 0, deeper - 1, 0))
    saved = below((n - 1) * words + at_ends(units.saved))
    children = np.bincount(parent[parent >= 0], minlength=size) + at_ends(units.children)
    first = np.full(size, np.iinfo(np.int64).max)
    first[end] = units.first
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[by_depth], np.arange(int(depth.max()) + 2))
    for d in range(int(depth.max()), 0, -1):
        level = by_depth[cuts[d] : cuts[d + 1]]
        np.minimum.at(first, parent[level], first[level])
    before = np.zeros(size, dtype=np.int64)
    first_path = np.arange(len(units.path[0]) // WIDTH + 1)  # the first nodes of the preorder
    before[first_path[1:]] = np.cumsum(words[first_path])[:-1]

    on_first, on_last = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    on_first[first_path], on_last[last_path] = True, True
    spine = on_first | on_last
    above = np.maximum(parent, 0)
    known = (parent >= 0) & ~spine[above] & ((depth[above] > 0) | inner_root)
    names = np.array(uid, dtype=object)
    rows = pd.DataFrame(
        {
            "part": part, "number": number, "spine": spine, "on_first": on_first, "on_last": on_last, "uid": names, "parent": np.where(parent >= 0, names[above], None),
            "parent_first": pd.array(np.where(known, first[above], 0), dtype="Int64"), "local": depth, "n": n, "first": first, "n_children": children, "n_leaves": leaves, "saved": saved, "before": before,
            "a_root": None, "a_path": None, "z_root": None, "z_path": None,
        }
    )
    rows.loc[~known, "parent_first"] = pd.NA
    ends = {c: None for c in NODE_NAMES} | {"part": part, "number": number, "a_root": units.root[0], "a_path": units.path[0], "z_root": units.root[-1], "z_path": units.path[-1]}
    return rows, ends


def walk_shards(inner_root: bool, shard_nodes: int):
    """Reads sorted units and gives the rows of their shards."""
    fields = ("root", "path", "n", "first", "children", "leaves", "saved")

    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [[] for _ in fields], 0

        def rows():
            nodes, ends = shard_rows(Units(*held), part, number, inner_root)
            yield nodes
            yield pd.DataFrame([ends], columns=NODE_NAMES)

        for batch in batches:
            for row in zip(*(batch[f].tolist() for f in fields)):
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[1]) // WIDTH + 1
                if size >= shard_nodes:
                    yield from rows()
                    number, held, size = number + 1, [[] for _ in fields], 0
        if held[0]:
            yield from rows()

    return run


def neighbours(batches):
    """Per shard, in order: elements its first path shares with the last path before it (-1: not even the root),
    the words of these elements, and whether the next shard goes on from the end of its last path."""
    waiting, z = None, (None, "")
    for batch in batches:
        found = []
        for row in batch.itertuples(index=False):
            same = z[0] == row.a_root
            shared = common(z[1], row.a_path) if same else -1
            if waiting:
                found.append((*waiting, same and shared * WIDTH == len(z[1])))
            waiting = (row.part, row.number, shared, sum(words_of(row.a_path, k) for k in range(shared)))
            z = (row.z_root, row.z_path)
        yield pd.DataFrame(found, columns=["part", "number", "shared", "shared_words", "extended"])
    if waiting:
        yield pd.DataFrame([(*waiting, False)], columns=["part", "number", "shared", "shared_words", "extended"])


def forest(units: DataFrame, inner_root: bool, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """uid, parent, parent_first, local, n, first, n_children, n_leaves, saved of every node over the units, written.

    ``parent_first`` is null where the parent is a spine or a root of a deeper level.
    """
    session = units.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    ordered = units.repartitionByRange(parts, "root", "path").sortWithinPartitions("root", "path")
    rows = cut_lineage(ordered.mapInPandas(walk_shards(inner_root, shard_nodes), NODE_COLUMNS))
    cuts = rows.filter("uid is null").select("part", "number", "a_root", "a_path", "z_root", "z_path")
    met = cuts.repartition(1).sortWithinPartitions("part", "number").mapInPandas(neighbours, "part long, number long, shared long, shared_words long, extended boolean")  # a row per shard
    values = ["uid", "parent", "parent_first", "local", "n", "first", "n_children", "n_leaves", "saved"]
    spines = rows.filter("spine").join(small_enough(cut_lineage(met)), ["part", "number"])
    twice = F.col("on_first") & (F.col("local") <= F.col("shared"))
    spines = spines.select(
        "uid", "parent", "local", "n", "first",
        (F.col("n_children") - F.when(twice & (F.col("local") < F.col("shared")), 1).otherwise(0)).alias("n_children"),
        (F.col("n_leaves") - F.when(F.col("on_last") & F.col("extended"), 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved") + F.when(twice, F.col("shared_words") - F.col("before")).otherwise(0)).alias("saved"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "n_children", "n_leaves", "saved")]
    merged = spines.groupBy("uid").agg(F.first("parent").alias("parent"), F.first("local").alias("local"), F.min("first").alias("first"), *sums)
    merged = merged.withColumn("parent_first", F.lit(None).cast("long")).select(*values)
    return cut_lineage(rows.filter("not spine").select(*values).unionByName(merged))


# ---------------------------------------------------------------- the trie


def end_digests(ends: DataFrame) -> DataFrame:
    """uid, ends_sha256 from (uid, c): the digest of the ids at each node, ascending, joined by commas.

    Ids are sorted over all tasks and written out in runs; one stream per node reads a row per ``IDS`` ids.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches):
        for batch in batches:
            names, ids = batch["uid"].to_numpy(), batch["c"].to_numpy()
            starts = np.nonzero(np.concatenate(([True], names[1:] != names[:-1])))[0] if len(ids) else np.zeros(0, dtype=int)
            found = []
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                for at in range(a, z, IDS):
                    some = ids[at : min(z, at + IDS)]
                    found.append((names[a], some[0], ",".join(map(str, some.tolist()))))
            yield pd.DataFrame(found, columns=["uid", "c", "ids"])

    def digests(batches):
        uid, held = None, None
        for batch in batches:
            found = []
            for name, ids in zip(batch["uid"], batch["ids"]):
                if name == uid:
                    held.update(b"," + ids.encode())
                    continue
                if uid is not None:
                    found.append((uid, held.hexdigest()))
                uid, held = name, hashlib.sha256(ids.encode())
            yield pd.DataFrame(found, columns=["uid", "ends_sha256"])
        if uid is not None:
            yield pd.DataFrame([(uid, held.hexdigest())], columns=["uid", "ends_sha256"])

    dealt = ends.repartitionByRange(parts, "uid", "c").sortWithinPartitions("uid", "c").mapInPandas(runs, "uid string, c long, ids string")
    return dealt.repartition(parts, "uid").sortWithinPartitions("uid", "c").mapInPandas(digests, "uid string, ends_sha256 string")


def trie(turns: DataFrame, segment: int = SEGMENT, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The nodes of the trie over (c, depth, el): uid, parent, depth, conv_id, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    level = F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / segment)).otherwise(0).cast("int")
    said = F.array_sort(F.collect_list(F.struct("depth", "el")))  # at most a segment
    path = F.array_join(F.transform(said, lambda t: t["el"]), "")
    segments = cut_lineage(turns.groupBy("c", level.alias("level")).agg(path.alias("path")))
    levels = (segments.agg(F.max("level")).first()[0] or 0) + 1
    own = F.when(F.col("path") == "", F.col("root")).otherwise(F.md5(F.concat("root", "path"))).alias("uid")
    ways = [segments.filter("level = 0").select("c", F.lit(ROOT).alias("root"), "path")]
    for k in range(1, levels):
        above = ways[-1].select("c", own.alias("root"))
        ways.append(cut_lineage(segments.filter(F.col("level") == k).join(above, "c").select("c", "root", "path")))
    nodes, totals = [], None
    for k in reversed(range(levels)):
        units = ways[k].groupBy("root", "path").agg(F.count("*").alias("n"), F.min("c").alias("first"))
        below = ["children", "leaves", "saved"]
        if totals is None:
            units = units.select("*", *[F.lit(0).cast("long").alias(c) for c in below])
        else:
            units = units.withColumn("uid", own).join(totals, "uid", "left").select("root", "path", "n", "first", *[F.coalesce(c, F.lit(0)).alias(c) for c in below])
        found = forest(units, k == 0, shard_nodes)
        totals = found.filter("local = 0").select("uid", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), "saved")
        nodes.append(found.filter(F.col("local") >= (1 if k else 0)).withColumn("depth", F.col("local") + k * segment))
    nodes = reduce(DataFrame.unionByName, nodes)
    # Parents that are spines or ends of the level above are few; all others are known already.
    wanted = small_enough(cut_lineage(nodes.filter("parent_first is null and parent is not null").select(F.col("parent").alias("uid")).distinct()))
    firsts = small_enough(cut_lineage(nodes.join(wanted, "uid", "left_semi").select(F.col("uid").alias("parent"), F.col("first").alias("_first"))))
    nodes = nodes.join(firsts, "parent", "left").withColumn("parent_first", F.coalesce("parent_first", "_first"))
    last = [way if k == levels - 1 else way.join(ways[k + 1].select("c"), "c", "left_anti") for k, way in enumerate(ways)]
    digests = end_digests(reduce(DataFrame.unionByName, [way.select(own, "c") for way in last]))
    return nodes.join(digests, "uid", "left").select(
        "uid", "parent", F.col("depth").cast("long").alias("depth"), F.col("first").alias("conv_id"), F.col("parent_first").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node."""
    nodes = trie(rebuilt(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
