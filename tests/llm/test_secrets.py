"""Secret scan: base spans against a plain reading of the rules, added spans on planted strings."""

import hashlib
import random
import re
import string

import pytest

pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402

from reviewloom.llm import registry  # noqa: E402
from reviewloom.llm import secrets as S  # noqa: E402

TOKENS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHARS = string.ascii_letters + string.digits
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain(text):
    """The base rules, read word by word."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text or "", re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return sorted(found)


def digest(spans):
    return hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_whole_table_against_the_rules(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registry.queries()["op11_secrets"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        expected = plain(docs[r["doc_id"]])
        assert r["base_sha256"] == digest(expected)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in expected) for i in range(3)]
        base = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in expected)
        assert base == ",".join(s for s in r["spans"].split(",") if s and not s.startswith("random"))


def test_base_rules_one_by_one():
    def kinds(t):
        return [(S.KINDS[k], t[a:b]) for a, k, b in S.base_spans(t)]

    assert kinds("PassWord = 'hunter2hunter2'") == [("assign", "PassWord = 'hunter2hunter2")]
    assert kinds("apikey:short api_KEY:\"0123456789AB\"") == [("assign", 'api_KEY:"0123456789AB')]
    assert kinds("AKIA1234567890123 AKIA12345678901234") == [("access", "AKIA12345678901234")]
    assert kinds("x0123456789abcdef0 ABCDEF0123456789") == [("hex", "0123456789abcdef0")]
    assert kinds("ſecret=abcdefghijklm") == []  # a long s is no letter of the keyword
    assert kinds("😀token:0123456789abcdef")[0] == ("assign", "token:0123456789abcdef")


def test_random_strings_are_found_and_identifiers_are_not(spark):
    rnd = random.Random(5)
    planted = ["".join(rnd.choice(CHARS) for _ in range(n)) for n in (24, 32, 40, 64, 700) for _ in range(20)]
    known = [
        hashlib.sha256(b"a").hexdigest().upper(), hashlib.md5(b"b").hexdigest().upper(), "sha512-" + "Zk3" * 20, "123e4567-E89b-12d3-A456-426614174000",
        "getElementsByClassNameOrTag", "AbstractSingletonProxyFactoryBean", "my_long_variable_name_here", "HTTP_PROXY_SERVER_ADDRESS_2", "20240102T030405Z-20240102",
        "/usr/local/lib/python3/site-packages", "Donaudampfschifffahrtsgesellschaft", "x" * 500, "1234-5678-9012-3456-7890",
    ]
    texts = [f"see ({p}) there" for p in planted] + [f"see {k}, there" for k in known] + [f"token={planted[0]}", "é" + planted[0], None, ""]
    rows = S.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENS).collect()
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "random"] for r in rows}
    hit = [found[i] == [p] for i, p in enumerate(planted)]
    assert sum(hit) >= 0.98 * len(hit)
    assert [t for i, t in enumerate(texts) if i >= len(planted) and found[i]] == []


def test_very_long_texts():
    encoding = S.vocabulary(TOKENS)
    for text in ("aB3" * 1_000_000, "token" + " " * 2_000_000, "token=" + "a" * 2_000_000, "0123456789abcdef " * 100_000):
        base = S.base_spans(text)
        S.random_spans(text, base, encoding)
    assert len(base) == 100_000


def test_added_spans_keep_clear_of_base_spans():
    encoding = S.vocabulary(TOKENS)
    text = "Qz7LkP0wXv9TbN2mRf5Y/0123456789abcdef0123 secret: Qz7LkP0wXv9TbN2mRf5YdH8sGj3 Qz7LkP0wXv9TbN2mRf5YdH8sGj3"
    base = S.base_spans(text)
    assert [text[a:b] for a, b, _ in S.random_spans(text, base, encoding)] == ["Qz7LkP0wXv9TbN2mRf5YdH8sGj3"]
