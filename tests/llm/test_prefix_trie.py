"""The sharded trie against a plain one."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
from reviewloom.llm import prefix_trie as P  # noqa: E402
from reviewloom.llm import registry  # noqa: E402

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The contract, read word by word, over (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - c % 20, [])[:h] + turns[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, path in built.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = own + sum(saved[k] for k in children[node])
    found = []
    for node, ids in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        found.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), leaves[node], saved[node], digest))
    return sorted(found, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def given(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def trie(spark, rows, **sizes):
    return rows_of(P.trie(P.rebuilt(P.numbered(given(spark, rows))), **sizes))


def test_whole_table_against_a_plain_trie(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(registry.queries()["op13_prefix_trie"](spark, sf_dir)) == plain(rows)


@pytest.fixture(scope="module")
def shared_turns():
    """Few different turns, so that conversations share long beginnings and many are equal; a few are long."""
    rnd, rows = random.Random(2), []
    for c in range(400):
        length = rnd.choice((1, 2, 3, 4, 6, 9)) if c % 50 else 60
        for t in range(length):
            rows.append((c, t, "user" if t % 2 else "assistant", rnd.choice(("yes", "no no", "")) if t > 3 else rnd.choice(("hello there", "hi"))))
    for c in range(1000, 1300):  # one large group of equal conversations
        rows += [(c, t, "user", "the same words again") for t in range(5)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_nodes": 7}, {"segment": 3}, {"segment": 4, "shard_nodes": 1}, {"segment": 1, "shard_nodes": 20}])
def test_any_cut_gives_the_same(spark, shared_turns, sizes):
    assert trie(spark, shared_turns, **sizes) == plain(shared_turns)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 0, "system", None), (0, 3, "user", "x\ty  z"), (0, None, "user", ""),
        (20, 1, "user", "only"), (21, 5, "user", "q"), (39, 1, "user", "w"), (45, 0, "user", "base is absent"), (46, 0, "u", "one"), (46, 1, "u", "two"), (46, 2, "u", "three"),
        (None, 0, "user", "nobody"), (60, -5, "😀", "日本 語"), (61, 9, "😀", "日本 語"), (62, 9, "😀", "日本 語"), (63, 9, "u", "v"), (64, 9, "u", "v"),
        (80, 0, "ab", "c"), (81, 0, "a", "bc"), (82, 0, "x", "word " * 200_000), (7, 0, "u", "  \u001f x"),
    ]
    assert trie(spark, rows) == plain(rows)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "a", "b")]) == []


def test_extra_columns_that_clash(spark):
    rows = [(c, t, "u", f"{t} {c % 3}") for c in range(30) for t in range(3)]
    table = given(spark, rows)
    for name in ("c", "pos", "el", "part", "uid", "depth", "root", "path", "n"):
        table = table.withColumn(name, P.F.lit("clash"))
    assert rows_of(P.trie(P.rebuilt(P.numbered(table)))) == plain(rows)


def test_findclose_and_ranks():
    rnd = random.Random(4)
    for size in (1, 2, 50, 5000, 60_000):
        bits, open_ = [], 0
        while len(bits) + open_ < 2 * size:
            up = open_ == 0 or rnd.random() < 0.52
            bits.append(up)
            open_ += 1 if up else -1
        bits += [False] * open_
        marks, stack, closes = P.Parentheses(np.array(bits)), [], {}
        for at, b in enumerate(bits):
            if b:
                stack.append(at)
            else:
                closes[stack.pop()] = at
        places = np.nonzero(marks.opens)[0]
        assert marks.findclose(places).tolist() == [closes[p] for p in places.tolist()]
    chain = P.Parentheses(np.array([True] * 100_000 + [False] * 100_000))
    assert chain.findclose(np.arange(100_000)).tolist() == list(range(199_999, 99_999, -1))
    assert chain.rank_pair[-1] == 1


def test_ids_at_hot_ends(spark):
    rows = [("a", c) for c in range(3 * P.IDS + 5)] + [("b", -7), ("b", 100), ("b", 20)]
    found = {r["uid"]: r["ends_sha256"] for r in P.end_digests(spark.createDataFrame(rows, "uid string, c long")).collect()}
    assert found == {"a": hashlib.sha256(",".join(map(str, range(3 * P.IDS + 5))).encode()).hexdigest(), "b": hashlib.sha256(b"-7,20,100").hexdigest()}
