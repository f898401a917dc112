"""Minimax cuts and mixing against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("corpus_pipeline")
from reviewloom.llm import mixing as M  # noqa: E402
from reviewloom.llm import sharding as S  # noqa: E402
from reviewloom.session import cut_lineage  # noqa: E402


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.integers(1, 4))
def test_smallest_capacity(sizes, shards):
    best = {(0, 0): 0}
    for end in range(1, len(sizes) + 1):
        for k in range(1, shards + 1):
            best[end, k] = min(max(best[start, k - 1], sum(sizes[start:end])) for start in range(end + 1) if (start, k - 1) in best) if any((s, k - 1) in best for s in range(end + 1)) else 10**9
        best.update({(0, k): 0 for k in range(shards + 1)})
    assert S.smallest_capacity(sizes, shards) == min(best[len(sizes), k] for k in range(1, shards + 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 16**6 - 1), st.integers(1, 500)), min_size=1, max_size=120, unique_by=lambda x: x[0]))
def test_leaves_give_the_exact_capacity(groups):
    groups = sorted((f"{k:06x}" + "0" * 58, size) for k, size in groups)

    def leaves_below(_, prefixes):
        found = {}
        for key, size in groups:
            for p in prefixes:
                if key.startswith(p):
                    at = key[: len(p) + S.DIGITS]
                    found[at] = (found.get(at, (0, 0))[0] + size, found.get(at, (0, 0))[1] + 1)
        return [S.Leaf(p, s, n) for p, (s, n) in found.items()]

    real, S.leaves_below, digits, S.DIGITS = S.leaves_below, leaves_below, S.DIGITS, 1
    try:
        cuts, capacity = S.minimax_cuts(None, 8)
    finally:
        S.leaves_below, S.DIGITS = real, digits
    assert capacity == S.smallest_capacity([s for _, s in groups], 8)
    loads = [0] * 8
    for key, size in groups:
        loads[sum(key >= c for c in cuts)] += size
    assert max(loads) == capacity


def test_targets_reshare_the_excess():
    assert M.targets([100, 100, 100], [5, 2, 1], 1.5) == pytest.approx([200, 500 / 3, 250 / 3])
    assert M.targets([0, 0], [5, 2], 1.5) == [0, 0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(1, 8))
def test_tree_deals_every_block_once(quotas, shards):
    split = M.split_quotas(np.array(quotas), shards, np.random.default_rng(3))
    assert split.shape == (shards, len(quotas)) and (split.sum(axis=0) == quotas).all() and (split >= 0).all()
    loads = split.sum(axis=1)
    assert loads.max() - loads.min() <= 3  # a unit of rounding for each level


def test_mix(spark, sf_dir):
    rows = M.op5_mixing(spark, sf_dir).collect()
    again = {(r["doc_id"], r["taken"], tuple(r["shards"])) for r in M.op5_mixing(spark, sf_dir).collect()}
    assert {(r["doc_id"], r["taken"], tuple(r["shards"])) for r in rows} == again
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["shards"]) for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    total = sum(r["size"] for r in rows)
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    for (_, target), taken in by.items():
        assert target - max(taken, default=0) - 1 <= sum(taken) <= target + 1


def mixed(spark, rows):
    docs = cut_lineage(spark.createDataFrame(rows, "doc_id long, source string, size long, key long"))
    return M.plan_mix(docs).apply(docs).collect()


@pytest.mark.parametrize("first", [0, 7_000_000])
def test_a_giant_document_does_not_keep_a_source_from_its_target(spark, first):
    """What is taken misses the target by less than the smallest document left, wherever the giant falls."""
    rnd = np.random.default_rng(first)
    keys = rnd.integers(0, 1 << 62, 24_001).tolist()
    sizes = [1_400_000] + [100] * 20_000 + [int(x) for x in rnd.integers(1, 3000, 4000)]
    rows = [(first + i, "a" if i <= 20_000 else "b", s, k) for i, (s, k) in enumerate(zip(sizes, keys))]
    found = mixed(spark, rows)
    for source in ("a", "b"):
        own = [r for r in found if r["source"] == source]
        taken, target = sum(r["taken"] for r in own), own[0]["target"]
        fewest = min(r["copies"] for r in own)
        left = min(r["size"] for r in own if r["copies"] == fewest)
        assert 0 <= target + 1 - taken <= left + 1 and all(r["copies"] <= 2 for r in own)


def test_rooms_are_filled_as_a_plain_walk_would(spark):
    """The draws done again in plain Python: whole blocks in order, then documents that fit, block by block."""
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.choice(["a", "b", "c"]), int(rnd.integers(0, 400)), int(rnd.integers(0, 1 << 62))) for i in range(3000)]
    rows[0] = (0, "b", 50_000, rows[0][3])
    found = {r["doc_id"]: r["copies"] for r in mixed(spark, rows)}
    names = sorted({r[1] for r in rows})
    totals = [sum(r[2] for r in rows if r[1] == n) for n in names]
    for name, full, target in zip(names, totals, M.targets(totals, [5, 2, 1], 1.5)):
        blocks = {}
        for i, source, size, key in rows:
            if source == name:
                blocks.setdefault(key % M.LEAST_BLOCKS, []).append((key, i, size))
        goal = int(target + 0.5)
        base = min(2, goal // full)
        room, left, copies = (goal - base * full if base < 2 else 0), [], {}
        for b in sorted(blocks):
            words = sum(size for *_, size in blocks[b])
            whole = words <= room and base < 2
            room -= words if whole else 0
            for _, i, size in blocks[b]:
                copies[i] = (base + whole) if size else 0
            if not whole:
                left.append(b)
        for b in left:
            for _, i, size in sorted(blocks[b]):
                if 0 < size <= room:
                    copies[i], room = copies[i] + 1, room - size
        assert {i: found[i] for i in copies} == copies
