"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, everything but letters becomes a word boundary, and all 1- to 4-grams of
characters inside words (boundaries included) are hashed into ``BUCKETS``. The embeddings of the buckets
are averaged and a linear softmax gives the languages. Both are trained by stochastic gradient descent in
numpy. A temperature and a rejection threshold are then set on rows that the descent has not seen.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected. Without any
labelled row every text is ``und``. A null ``lang`` is not learned from. Repeated rows are classified
alike. Only ``id``, ``text`` and (for learning) ``lang`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import documents, id_remainder
from reviewloom.operators.bounded import few_rows

BUCKETS = 1 << 14
DIM = 16
LONGEST_GRAM = 4
PIECE = 1 << 20  # characters hashed at a time; bounds the memory for very long texts
BOUNDARY = 32
MAX_LANGUAGES = 1000
MAX_TRAIN_ROWS = 3000  # labelled rows that reach the driver, as at most BUCKETS counts each
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter. Made once per process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def piece_grams(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    after = np.concatenate(([False], letter[:-1]))
    keep = letter | after  # of a run of other characters, the first one ends the word
    code = np.concatenate(([BOUNDARY], np.where(letter, codes, BOUNDARY)[keep], [BOUNDARY])).astype(np.uint64)
    inside = code != BOUNDARY
    found = []
    mixed = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        mixed = mixed[:size] + code[n - 1 :] * PRIMES[n - 1]
        if n == 1:
            good = inside
        elif n == 2:
            good = inside[:-1] | inside[1:]
        else:
            good = inside[1 : size + 1].copy()
            for k in range(2, n - 1):
                good &= inside[k : size + k]
        gram = mixed[good] ^ np.uint64(n)
        found.append(((gram ^ (gram >> np.uint64(31))) * PRIMES[0] >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
    return np.concatenate(found)


def pieces(text: str):
    for start in range(0, len(text), PIECE):
        grams = piece_grams(text[start : start + PIECE])
        if len(grams):
            yield grams


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages: the embedding times the softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        return softmax((means + self.bias) / self.temperature)

    def score(self, text: str | None) -> tuple[str, float]:
        """Most likely language and its calibrated probability."""
        total, count = np.zeros(len(self.languages)), 0
        if text and self.languages:
            for grams in pieces(text):
                total += self.table[grams].sum(axis=0, dtype=np.float64)
                count += len(grams)
        if not count:
            return "und", 0.0
        p = self.probabilities(total / count)
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def column(self, text: str | Column) -> Column:
        """Struct of language and score."""
        model = self

        @F.pandas_udf("lang string, score double")
        def classify(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([model.score(t) for t in texts], columns=["lang", "score"])

        return classify(text)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def dense(rows, languages: int | None = None) -> np.ndarray:
    """Averaging weights of the buckets, a row per text."""
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, (bucket, count) in enumerate(rows):
        x[i, bucket] = np.asarray(count, dtype=np.float32) / np.sum(count)
    return x


def train(rows, labels: np.ndarray, languages: tuple[str, ...], epochs: int = 12, batch: int = 32, rate: float = 40.0, seed: int = 7) -> LanguageModel:
    """Fit on (buckets, counts) rows. Every fifth row is kept for temperature and threshold."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, k)).astype(np.float32)
    bias = np.zeros(k, dtype=np.float32)
    steps = max(1, epochs * -(-len(fit) // batch))
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, -(-len(fit) // batch))):
            if not len(part):
                continue
            pace = rate * (1 - step / steps)
            step += 1
            x = dense([rows[i] for i in part])
            hidden = x @ embed
            error = softmax(hidden @ out + bias)
            error[np.arange(len(part)), labels[part]] -= 1
            error /= len(part)
            back = error @ out.T
            out -= 0.05 * pace * (hidden.T @ error)
            bias -= 0.01 * pace * error.sum(axis=0)
            embed -= pace * (x.T @ back)
    table = embed @ out
    if not len(held):
        return LanguageModel(languages, table, bias, 1.0, 0.0)
    logits = np.concatenate([dense([rows[i]]) @ table for i in held]) + bias
    temperature = min(np.geomspace(0.25, 8, 41), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), labels[held]] + 1e-12).mean())
    return LanguageModel(languages, table, bias, float(temperature), rejection(softmax(logits / temperature), labels[held]))


def rejection(p: np.ndarray, labels: np.ndarray, error: float = 0.01) -> float:
    """Smallest score above which at most ``error`` of the held rows are wrong, but at most one half:
    a language likelier than all others together is never rejected."""
    best = p.max(axis=1)
    wrong = p.argmax(axis=1) != labels
    order = np.argsort(-best, kind="stable")
    rate = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
    good = np.nonzero(rate <= error)[0]
    if not len(good) or good[-1] == len(order) - 1:
        return 0.0
    return float(min(0.5, best[order][good[-1] + 1] + 1e-9))


def sample_rows(labelled: DataFrame, text: str, lang: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows, as many of each language as it has or its even share."""
    counts = few_rows(labelled.groupBy(lang).count(), MAX_LANGUAGES, "languages")
    if not counts:
        return labelled.limit(0)
    share = max(1, max_rows // len(counts))
    drawn = F.xxhash64(F.lit("language"), F.col(text))
    part = F.create_map(*[x for r in counts for x in (F.lit(r[lang]), F.lit(min(1.0, 2 * share / r["count"] + 20 / r["count"])))])
    near = labelled.filter(F.pmod(drawn, F.lit(1 << 20)) < part[F.col(lang)] * (1 << 20))
    place = F.row_number().over(Window.partitionBy(lang).orderBy(drawn))
    return near.withColumn("_place", place).filter(F.col("_place") <= share).drop("_place")


def count_grams(batches):
    for batch in batches:
        found = []
        for lang, text in zip(batch["lang"], batch["text"]):
            total = np.zeros(BUCKETS, dtype=np.int64)
            for grams in pieces(text):
                total += np.bincount(grams, minlength=BUCKETS)
            used = np.nonzero(total)[0]
            if len(used):
                found.append((lang, used.astype(np.int16), total[used].astype(np.float32)))
        yield pd.DataFrame(found, columns=["lang", "buckets", "counts"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = MAX_TRAIN_ROWS, seed: int = 7) -> LanguageModel:
    """Train on at most ``max_rows`` rows of ``labelled``, spread evenly over its languages.

    Only counts per bucket reach the driver: at most ``max_rows`` x BUCKETS x 6 bytes.
    """
    usable = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    drawn = sample_rows(usable, "text", "lang", max_rows)
    found = drawn.select("lang", "text").mapInPandas(count_grams, "lang string, buckets array<smallint>, counts array<float>").toArrow().to_pandas()
    found = found.assign(key=[(a, tuple(b)) for a, b in zip(found["lang"], found["buckets"])]).sort_values("key").reset_index(drop=True)
    languages = tuple(sorted(set(found["lang"])))
    rows = list(zip(found["buckets"], found["counts"]))
    labels = np.array([languages.index(x) for x in found["lang"]], dtype=np.int64)
    if not rows:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    return train(rows, labels, languages, seed=seed)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "_lang") -> DataFrame:
    """``docs`` plus the struct ``out``: lang, score, rejected."""
    scored = docs.withColumn(out, model.column(F.col(text)))
    rejected = (F.col(f"{out}.lang") == "und") | (F.col(f"{out}.score") < model.threshold)
    return scored.withColumn(out, F.struct(F.col(f"{out}.lang").alias("lang"), F.col(f"{out}.score").alias("score"), rejected.alias("rejected")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out quarter."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(id_remainder(4) == 2, F.lit(False))
    model = fit(docs.filter(id_remainder(4) != 2))
    found = identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"), F.col("_lang.rejected").alias("rejected"))


QUERIES = {"op1_language_id": op1_language_id}
