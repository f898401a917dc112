"""Spelling variants against a plain reading of the rules."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
from reviewloom.llm import registry  # noqa: E402
from reviewloom.llm import spelling as S  # noqa: E402
from reviewloom.session import cut_lineage  # noqa: E402


def counted(docs):
    words = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def grouped(words):
    """All near pairs by shared deletions, and what follows from them."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    found = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return found


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = rows_of(registry.queries()["op12_spelling"](spark, sf_dir))
    assert len(rows) == len(set(rows)) and set(rows) == grouped(counted(docs))


def test_odd_texts(spark):
    text = "Apples APPLES apples Ærøskøbing ærøskøbing naïve×÷ naïve×÷ naïve×÷ tiny tiny tiny x1longword longword longword ß" + " " + "aaaaaa " * 3 + "aaaaa " * 9 + "z" * 70_000
    docs = [(1, text), (None, text), (None, text), (2, None), (3, ""), (4, "z" * 70_000), (5, "Z" * 70_001 + " " + "z" * 70_000), (7, "😀apples日本longword")] + [(k, "recieve receive receives") for k in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = rows_of(S.variants(S.vocabulary(frame)))
    assert len(rows) == len(set(rows)) and set(rows) == grouped(counted(docs))
    assert any(r[1] for r in rows)


@pytest.fixture(scope="module")
def vocabulary(spark):
    rnd, words = random.Random(3), {}
    for _ in range(1500):
        w = "".join(rnd.choice("abcdé") for _ in range(rnd.randint(5, 8)))
        words[w] = rnd.choice((3, 3, 4, 6, 9, 12, 30, 200))
    long = "".join(rnd.choice("xyz") for _ in range(80))
    words |= {long: 9, long[1:]: 3, long[:40] + "a" + long[41:]: 20, long + "ÿ": 40, long[:64]: 5, long[:63]: 11, long[:65]: 30}
    return words, cut_lineage(spark.createDataFrame(list(words.items()), "word string, n long"))


@pytest.mark.parametrize("limit", [S.PASS_BLOCKS, 100])
def test_any_number_of_passes_gives_the_same(vocabulary, limit):
    words, table = vocabulary
    rows = rows_of(S.variants(table, limit))
    assert len(rows) == len(words) and set(rows) == grouped(words)


def test_passes_cover_every_block_once():
    sizes = {5: 1000, 6: 10, 64: 3333}
    found = S.passes(sizes, 100)
    assert all(sum(e - a for _, a, e in p.values()) <= 100 for p in found)
    for shard, n in sizes.items():
        ranges = [p[shard] for p in found if shard in p]
        assert ranges[0][1] == 0 and ranges[-1][2] == ranges[0][0] >= n * S.BITS_PER_WORD / 64 and all(a[2] == b[1] for a, b in zip(ranges, ranges[1:]))


def test_filter_knows_its_words_and_few_others():
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("abcdefghijkl") for _ in range(9)) for _ in range(20_000)})
    z, blocks = S.word_hashes(S.letters(words)), len(words) * S.BITS_PER_WORD // 64
    bits = np.zeros(blocks, dtype=np.uint64)
    np.bitwise_or.at(bits, S.block_of(z, blocks).astype(np.int64), S.bits_of(z))
    filters = S.Filters({9: (blocks, 0, bits)})
    assert filters.knows(9, z).all()
    others = sorted({"".join(rnd.choice("mnopqrstuvwx") for _ in range(9)) for _ in range(20_000)})
    assert filters.knows(9, S.word_hashes(S.letters(others))).mean() < 0.03


def test_empty_vocabulary(spark):
    assert S.variants(cut_lineage(spark.createDataFrame([], "word string, n long"))).count() == 0
