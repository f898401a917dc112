"""SimHash against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("corpus_pipeline")
from reviewloom.llm import simhash as S  # noqa: E402


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÄß \t\n  ", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text) == slow(text)


def test_plan_covers_the_distance():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for rows in (0, 1000, 10**9):
        for distance in (3, 5):
            probes = S.plan(sample, rows, distance)
            assert sum(t + 1 for _, t in probes) == distance + 1
            bits = [b for part, _ in probes for b in part]
            assert len(bits) == len(set(bits))
    assert len(S.plan(sample, 10**9, 3)) < len(S.plan(sample, 1000, 3))  # more rows, more selective parts


def components_of(prints, distance):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_links_connect_as_all_pairs_do(spark, monkeypatch):
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(0, 1 << 64, 150, dtype=np.uint64)}
    for base in list(prints)[:40]:  # chains of near ones, and one dense group
        for _ in range(4):
            base ^= 1 << int(rng.integers(64))
            base ^= 1 << int(rng.integers(64))
            prints.add(base)
    dense = next(iter(prints))
    prints |= {dense ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    prints = sorted(prints)
    monkeypatch.setattr(S, "CHUNK", 50)  # groups are dealt to pairs of chunks
    rows = S.cut_lineage(spark.createDataFrame([(S.signed(p),) for p in prints], "fp long"))
    roots = {r["node"]: r["root"] for r in S.components(S.find_links(rows, 3)).collect()}
    got = [roots.get(S.signed(p), S.signed(p)) for p in prints]
    want = components_of(prints, 3)
    assert len(set(zip(got, want))) == len(set(want)) == len(set(got))
