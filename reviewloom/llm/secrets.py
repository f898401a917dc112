"""Secret scan by token efficiency.

Base spans follow fixed rules: ``assign`` (a keyword, ":" or "=", a value), ``access`` (access key ids) and
``hex`` (long runs of hexadecimal digits), each leftmost and not overlapping within its kind; a match that
fails its length is dropped without another try.

Beside them every run of key characters is a candidate for ``random``. Known digests (hexadecimal runs of a
digest's length, prefixed digests) and identifiers (UUIDs, dates, numbers, runs of one kind of character, parts that
are all words or all numbers) are left out. The rest is encoded with a byte-pair vocabulary: language and
names take few tokens, random strings many, so a candidate with at most ``RATIO`` characters per token is a
secret. Runs are encoded in blocks of ``BLOCK`` characters, so a text that is one run costs no more than its
length. Added spans never overlap base spans.

Rows are independent: one pass over the texts, no shuffle. Defined results: null and empty texts have no spans;
rows that repeat are each returned; an empty table gives an empty one. Only ``id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import documents, text_or_empty

KINDS = ("assign", "access", "hex")
ADDED = "random"
# Base rules: pattern, what is measured (0: the match), least length. The keywords are taken in either case.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # a maximal run: shorter ones fail the rule anyway
}
LEAST = 20  # characters of a candidate
RATIO = 1.9  # characters per token; random strings have 1.0 to 1.9, names and words 2.4 and more
BLOCK = 512
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
# Hexadecimal digits of the common digests, and forms that identify without being secret.
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST = re.compile(r"(?:md5|sha1|sha224|sha256|sha384|sha512)[-_=/][A-Za-z0-9+/=_-]+")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
NUMBERS = re.compile(r"[0-9TZ+/_=-]+")
PARTS = re.compile(r"[-_/+=]+")
PLAIN = re.compile(r"[0-9]+|[A-Z]?[a-z]{2,15}|[A-Z]{2,15}")
# Splits a text before the merges; the form that the public vocabulary was made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPANS = "array<struct<start:int,order:int,end:int,kind:string,ratio:double>>"

_vocabularies: dict[str, tiktoken.Encoding] = {}


def vocabulary(path: str) -> tiktoken.Encoding:
    """The byte-pair encoding of a rank file; one per process."""
    if path not in _vocabularies:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _vocabularies[path] = tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of all base spans, sorted."""
    found = []
    for order, kind in enumerate(KINDS):
        pattern, group, least = BASE[kind]
        found += [(m.start(), order, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def identifies(run: str) -> bool:
    """Whether a run of key characters is a known digest or an identifier."""
    if HEX.fullmatch(run) and len(run) in DIGEST_LENGTHS:
        return True
    if DIGEST.fullmatch(run) or UUID.fullmatch(run) or NUMBERS.fullmatch(run):
        return True
    kinds = any(map(str.islower, run)) + any(map(str.isupper, run)) + any(map(str.isdigit, run))
    if kinds < 2:
        return True
    parts = [p for p in PARTS.split(run) if p]
    return len(parts) > 1 and all(map(PLAIN.fullmatch, parts))


def characters_per_token(run: str, encoding: tiktoken.Encoding) -> float:
    tokens = sum(len(encoding.encode_ordinary(run[at : at + BLOCK])) for at in range(0, len(run), BLOCK))
    return len(run) / max(1, tokens)


def random_spans(text: str, taken: list[tuple[int, int, int]], encoding: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int, float]]:
    """(start, end, characters per token) of the candidates that are random and overlap no span of ``taken``."""
    found = []
    blocks = merged(taken)
    ends = [b for _, b in blocks]
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
            continue  # part of a word with other letters
        while start < end and text[start] in "-_/+=":
            start += 1
        while start < end and text[end - 1] in "-_/+":
            end -= 1
        at = bisect_left(ends, start + 1)
        if end - start < LEAST or (at < len(blocks) and blocks[at][0] < end):
            continue
        run = text[start:end]
        if not identifies(run) and (r := characters_per_token(run, encoding)) <= ratio:
            found.append((start, end, r))
    return found


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that sorted spans cover, in order."""
    covered: list[tuple[int, int]] = []
    for start, _, end in spans:
        if covered and start <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(end, covered[-1][1]))
        else:
            covered.append((start, end))
    return covered


def spans_column(text: str | Column, tokens: str, ratio: float = RATIO) -> Column:
    """All spans of a text, ordered by start and kind; ``ratio`` is null for base spans."""

    @F.pandas_udf(SPANS)
    def of(texts: pd.Series) -> pd.Series:
        encoding, found = vocabulary(tokens), []
        for text in texts:
            base = base_spans(text)
            rows = [(start, order, end, KINDS[order], None) for start, order, end in base]
            rows += [(start, len(KINDS), end, ADDED, r) for start, end, r in random_spans(text, base, encoding, ratio)]
            found.append([dict(zip(("start", "order", "end", "kind", "ratio"), row)) for row in sorted(rows, key=lambda row: row[:2])])
        return pd.Series(found, dtype=object)

    return of(text)


def scan(docs: DataFrame, tokens: str, doc_id: str = "doc_id", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """doc_id and ``spans`` of every row; ``tokens`` is the path of a rank file on every executor."""
    return docs.select(F.col(doc_id).alias("doc_id"), spans_column(text_or_empty(text), tokens, ratio).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document: counts and digest of the base ones, and all of them as text."""
    import public_tokenizers

    found = scan(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def of_kind(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = joined(F.filter("spans", lambda s: s["kind"] != ADDED))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op11_secrets": op11_secrets}
