"""Toxicity by noisy-channel deobfuscation.

A trigram language model of characters is counted over the words of all documents. Words that look disguised
(digits or signs for letters, letters set apart, letters repeated) become lattices: a sign stands for some
letters or for nothing, a repeated letter may be dropped, each at a cost. Viterbi decoding under the language
model restores the likeliest word; letters that stand apart over more than a word are decoded with word ends in the
lattice, and look-alike letters of other scripts are edges too. Restored texts are scored by word evidence: every word and word start is
hashed, and the log odds of the labelled documents that have it, shrunk for rare ones, are its evidence. The
three strongest pieces of evidence of a text go through a logistic function that is fitted on labelled rows
which the evidence has not seen.

All labelled rows are counted, each distinct text once; only the three numbers of at most ``MAX_FIT_ROWS`` rows
and tables of fixed size (64^3 trigrams, 2^20 hashes) reach the driver.

Defined results: null and empty texts, and those without words, are scored on no evidence. Without labels, or
without both classes, every score is the share of toxic labels (0 if there are none). Ids that are labelled
more than once count as toxic if any of their labels does. Repeated rows are scored alike. Only ``id``,
``text``, and of labels ``id`` and ``toxic``, are read.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import documents, id_remainder, small_enough, text_or_empty
from reviewloom.session import cut_lineage

SYMBOLS = 64  # 0 is the word boundary, 1-26 are a-z, other Latin letters share the rest
BUCKETS = 1 << 20
STARTS = (4, 5, 6, 7)  # lengths of the word starts that are evidence besides whole words
SPELLED = 12  # letters that enter the hash of a whole word, besides its length
TOP = 3
SHRINK = 5.0
MAX_FIT_ROWS = 20_000
PIECE = 1 << 20
LONGEST = 32  # characters of a disguised word, repeats shortened
ONE_WORD = 10  # more letters with marks between them may be several words
RUN_PIECE = 96  # letters of such a run decoded together
CACHE_WORDS = 1 << 17

# What signs stand for, and the channel's costs in nats.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
REPLACED, DROPPED_SIGN, DROPPED_MARK, DROPPED_REPEAT, KEPT_REPEAT, LOOK_ALIKE = 1.0, 8.0, 0.3, 0.7, 0.0, 0.0
# Letters of other scripts that look like Latin ones.
LOOKS_LIKE = dict(zip("аеорсухіѕјһԁвкмнтɡαεικνορτυχ", "aeopcyxisjhdbkmhtgaeiknoptux"))
MARKS = " ._*~-"
SIGNS = "@$!|+0-9"
LETTER = "[a-zªµºß-öø-ɏ]"  # of lower-case Latin text
# Four or more single letters or signs with the same mark between them; or a word with a sign between letters, one or
# two signs at an end, three letters with single marks, or a letter three times.
APART = rf"(?<!\S)(?:{LETTER}|[{SIGNS}])(?P<mark>[{MARKS}])(?:{LETTER}|[{SIGNS}])(?:(?P=mark)(?:{LETTER}|[{SIGNS}])){{2,}}(?![^\s.,;:?])"
ALIKE = "".join(c for c in LOOKS_LIKE if c > "\u024f")
CORE = rf"{LETTER}[{ALIKE}]|[{ALIKE}]{LETTER}|(?P<again>{LETTER})(?:[{SIGNS}]+{LETTER}|[@$|+0-9]{{1,2}}(?!\S)|[._*~-]{LETTER}[._*~-]{LETTER}|(?P=again){{2}})|(?<!\S)[@$|+0-9]{{1,2}}{LETTER}"
DISGUISED = re.compile(f"(?P<apart>{APART})|{CORE}")
REPEATED = re.compile(r"(.)\1{3,}", re.DOTALL)
REACH = 6  # characters behind a place that tell whether a disguised word may begin there
PRIMES = np.random.default_rng(64).integers(1, 1 << 63, SPELLED + 1, dtype=np.uint64) | np.uint64(1)


@cache
def symbols() -> np.ndarray:
    """The symbol of every code point: letters of all scripts, with the marks that belong to them, have one."""
    table = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        if chr(c).isalpha() or (c > 0x2FF and unicodedata.category(chr(c))[0] == "M"):
            table[c] = c - 96 if 97 <= c < 123 else 27 + c % (SYMBOLS - 27)
    return table


def symbol(letter: str) -> int:
    return int(symbols()[ord(letter)])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@cache
def kinds() -> np.ndarray:
    """Of every code point, as bits: 1 a letter of the patterns above, 2 a sign, 4 a mark, 8 a look-alike."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for bit, pattern in ((1, LETTER), (2, f"[{SIGNS}]"), (4, f"[{MARKS}]"), (8, f"[{ALIKE}]")):
        for c in re.finditer(pattern, "".join(map(chr, range(0x3000)))):
            table[c.start()] |= bit
    return table


def repeats(text: str) -> bool:
    """Whether a character comes four times in a row."""
    for at in range(0, len(text), PIECE):
        codes = codes_of(text[at : at + PIECE + 3])
        same = codes[1:] == codes[:-1]
        if (same[2:] & same[1:-1] & same[:-2]).any():
            return True
    return False


def places(text: str):
    """The places, in order, that ``DISGUISED`` may match at: all that it does match at, and a few more."""
    for at in range(0, len(text), PIECE):
        codes = codes_of(text[at : at + PIECE + REACH])
        n = min(PIECE, len(text) - at)
        codes = np.concatenate((codes, np.zeros(n + REACH - len(codes), dtype=np.uint32)))
        kind = kinds()[codes]
        letter, sign, mark = (kind & 1) > 0, (kind & 2) > 0, (kind & 4) > 0
        either, alike = letter | sign, (kind & 8) > 0
        code = [codes[k : n + k] for k in range(REACH)]
        letter, sign, mark, either, alike = ([x[k : n + k] for k in range(REACH + 1)] for x in (letter, sign, mark, either, alike))
        found = letter[0] & (sign[1] | alike[1] | ((code[0] == code[1]) & (code[0] == code[2])))
        found |= letter[1] & (alike[0] | sign[0]) | (sign[0] & sign[1] & letter[2])
        apart = either[0] & mark[1] & either[2] & mark[3] & either[4]
        found |= apart & (letter[0] & letter[2] & letter[4] | (code[1] == code[3]) & (code[1] == code[5]) & either[6])
        yield from (np.nonzero(found)[0] + at).tolist()


def count_trigrams(batches):
    """Trigram counts of the batches' words, two boundaries before each word and one behind."""
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    waiting: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for text in batch["text"]:
            for at in range(0, len(text), PIECE):
                codes = codes_of(text[at : at + PIECE].lower())
                one = np.concatenate(([0, 0], symbols()[codes], [0]))
                before = np.where(one[1:-1] == 0, 0, one[:-2])  # what lies before a boundary is forgotten
                gram = (before * SYMBOLS + one[1:-1]) * SYMBOLS + one[2:]
                waiting.append(gram[(one[1:-1] > 0) | (one[2:] > 0)])
                held += len(waiting[-1])
                if held >= PIECE:
                    total += np.bincount(np.concatenate(waiting), minlength=len(total))
                    waiting, held = [], 0
    if waiting:
        total += np.bincount(np.concatenate(waiting), minlength=len(total))
    used = np.nonzero(total)[0]
    yield pd.DataFrame({"gram": used.astype(np.int32), "n": total[used]})


@dataclass(frozen=True)
class CharacterModel:
    """Cost in nats of a symbol after two others."""

    cost: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> CharacterModel:
        tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        uni = (uni + 0.5) / (uni.sum() + 0.5 * SYMBOLS)
        bi = (bi + 4 * uni) / (bi.sum(axis=1, keepdims=True) + 4)
        return CharacterModel((-np.log((tri + 4 * bi) / (tri.sum(axis=2, keepdims=True) + 4))).astype(np.float32))


def options(token: str, at: int) -> list[tuple[str, float]]:
    """What the character at a place may have been, with costs; nothing is the empty string."""
    c = token[at]
    if c in MARKS:
        return [("", DROPPED_MARK)]
    if c in STANDS_FOR:
        return [(x, REPLACED) for x in STANDS_FOR[c]] + [("", DROPPED_SIGN)]
    if c in LOOKS_LIKE:
        return [(c, 0.0), (LOOKS_LIKE[c], LOOK_ALIKE)]
    if not c.isalpha():
        return [("", DROPPED_SIGN)]
    run = at and token[at - 1] == c and (token[at + 1 : at + 2] == c or (at > 1 and token[at - 2] == c))
    return [(c, KEPT_REPEAT if run else 0.0)] + ([("", DROPPED_REPEAT)] if run else [])


def decode(token: str, model: CharacterModel) -> str:
    """Likeliest word of a disguised one: Viterbi over the last two symbols."""
    cost = model.cost
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for at in range(len(token)):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (sum_, word) in states.items():
            for letter, price in options(token, at):
                if letter:
                    s = symbol(letter)
                    key, new = (b, s), (sum_ + price + float(cost[a, b, s]), word + letter)
                else:
                    key, new = (a, b), (sum_ + price, word)
                if key not in after or new < after[key]:
                    after[key] = new
        states = after
    return min((sum_ + float(cost[a, b, 0]), word) for (a, b), (sum_, word) in states.items())[1]


def decode_run(letters: str, model: CharacterModel) -> str:
    """Likeliest words of letters that stood apart: the same search, with a word's end as one more way on."""
    cost = model.cost
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for at in range(len(letters)):
        for (a, b), (sum_, words) in list(states.items()):
            if b:  # a word may end here
                ended = (sum_ + float(cost[a, b, 0]), words + " ")
                if (0, 0) not in states or ended < states[0, 0]:
                    states[0, 0] = ended
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (sum_, words) in states.items():
            for letter, price in options(letters, at):
                s = symbol(letter) if letter else b
                new = (sum_ + price + (float(cost[a, b, s]) if letter else 0.0), words + letter)
                key = (b, s) if letter else (a, b)
                if key not in after or new < after[key]:
                    after[key] = new
        states = after
    return min((sum_ + float(cost[a, b, 0]), words) for (a, b), (sum_, words) in states.items())[1].strip()


class Restorer:
    """Restores texts; remembers the words it has decoded."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def word(self, token: str) -> str:
        if token not in self.known:
            if len(self.known) >= CACHE_WORDS:
                self.known = {}
            self.known[token] = decode(token, self.model)
        return self.known[token]

    def run(self, letters: str) -> str:
        """Words of a run of any length: a piece at a time, its last word decoded again with what follows."""
        found, rest = [], letters
        while len(rest) > RUN_PIECE:
            words = decode_run(rest[:RUN_PIECE], self.model)
            last = words.rpartition(" ")[2] if " " in words else ""
            found.append(words[: len(words) - len(last)].strip())
            # Signs that were dropped belong to the words given out, so the last word's letters are counted from the end.
            rest = rest[RUN_PIECE - len(last) :]
        return " ".join([w for w in found if w] + [decode_run(rest, self.model)])

    def text(self, text: str) -> str:
        """Lower-case text with disguised words restored."""
        text = text.lower()
        if repeats(text):
            text = REPEATED.sub(r"\1\1\1", text)  # no word has a letter four times in a row
        parts, done, at = [], 0, 0
        for place in places(text):
            found = DISGUISED.match(text, place) if place >= at else None
            if not found:
                continue
            start, end = found.span()
            at = max(end, at + 1)
            if found["apart"] is not None:
                letters = found["apart"].replace(found["mark"], "")
                if len(letters) > ONE_WORD and start >= done:
                    parts += [text[done:start], self.run(letters)]
                    done = end
                    continue
            else:
                # The token around the find.
                low = start
                while low > done and start - low <= LONGEST and not text[low - 1].isspace():
                    low -= 1
                high = end
                while high < len(text) and high - end <= LONGEST and not text[high].isspace():
                    high += 1
                start, end = low, high
                at = max(at, end)
            if end - start > LONGEST or start < done:
                continue
            token = text[start:end].strip(",;:?\"'()[]{}<>#%&=/\\").rstrip(".!")
            word = self.word(token)
            if len(word) > 2:
                parts += [text[done:start], word]
                done = end
        return "".join([*parts, text[done:]]) if parts else text


def word_features(text: str):
    """Hashes (features x words) of the words of a lower-case text, and which are real, piece by piece."""
    for at in range(0, len(text), PIECE):
        codes = codes_of(text[at : at + PIECE])
        letter = symbols()[codes] > 0
        padded = np.concatenate(([False], letter, [False]))
        starts = np.nonzero(padded[1:-1] & ~padded[:-2])[0]
        lengths = np.nonzero(padded[1:-1] & ~padded[2:])[0] + 1 - starts
        if not len(starts):
            continue
        codes = np.concatenate((codes, np.zeros(SPELLED, dtype=np.uint32))).astype(np.uint64)
        mixed = np.zeros(len(starts), dtype=np.uint64)
        found, real = [], []
        for k in range(SPELLED):
            mixed = mixed + np.where(k < lengths, codes[starts + k] * PRIMES[k], np.uint64(0))
            if k + 1 in STARTS:
                found.append(mixed + np.uint64(k))
                real.append(lengths > k + 1)
        found.append(mixed + lengths.astype(np.uint64) * PRIMES[SPELLED])
        real.append(lengths > 0)
        hashed = np.array(found)
        hashed = ((hashed ^ (hashed >> np.uint64(29))) * PRIMES[0] >> np.uint64(44)).astype(np.int64) & (BUCKETS - 1)
        yield hashed, np.array(real)


def text_buckets(text: str) -> np.ndarray:
    found = [np.unique(hashed[real]) for hashed, real in word_features(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


@dataclass(frozen=True)
class ToxicityModel:
    characters: CharacterModel
    evidence: np.ndarray  # by bucket
    weights: np.ndarray  # of the strongest pieces of evidence, and the bias

    def strongest(self, restored: str) -> np.ndarray:
        """The ``TOP`` strongest pieces of evidence, of different buckets, 0 where there are none."""
        best = np.zeros(TOP)
        seen: list[np.ndarray] = []
        for hashed, real in word_features(restored):
            value = np.where(real, self.evidence[hashed], 0.0)
            word = value.argmax(axis=0)
            buckets, value = hashed[word, np.arange(hashed.shape[1])], value.max(axis=0)
            _, once = np.unique(buckets, return_index=True)  # a word that repeats is one piece of evidence
            once = once[np.argsort(-value[once], kind="stable")[:TOP]]
            seen.append(np.stack([value[once], buckets[once]]))
        if seen:
            value, bucket = np.concatenate(seen, axis=1)
            _, first = np.unique(bucket, return_index=True)
            top = -np.sort(-value[first])[:TOP]
            best[: len(top)] = np.maximum(top, 0)
        return best

    def score(self, best: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(best @ self.weights[:-1] + self.weights[-1], -35, 35))))

    def column(self, text: str | Column) -> Column:
        """Score of a text, from 0 to 1."""
        model, restorers = self, []

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            if not restorers:
                restorers.append(Restorer(model.characters))
            return pd.Series([model.score(model.strongest(restorers[0].text(t or ""))) for t in texts], dtype="float64")

        return scored(text)


def character_model(docs: DataFrame, text: str = "text") -> CharacterModel:
    """Trigrams of the words of all ``docs``."""
    grams = docs.select(text_or_empty(text).alias("text")).mapInPandas(count_trigrams, "gram int, n long")
    found = grams.groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # at most 64^3 rows
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    counts[found["gram"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    return CharacterModel.of(counts)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; weights of the columns of ``x`` and the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled documents, one row per distinct text; written."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.filter("doc_id is not null").join(small_enough(cut_lineage(known)), "doc_id")
    tagged = cut_lineage(rows.select("doc_id", "toxic", F.xxhash64("text").alias("_tag")))
    first = cut_lineage(tagged.groupBy("_tag").agg(F.min_by(F.struct("doc_id", "toxic"), "doc_id").alias("f")).select("_tag", "f.*"))
    return docs.withColumn("_tag", F.xxhash64("text")).join(small_enough(first), ["doc_id", "_tag"]).select("doc_id", text_or_empty("text").alias("text"), "toxic")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> ToxicityModel:
    """Learn from the labelled rows among ``docs`` (doc_id, text); the characters from all of them.

    Four of five labelled texts give the evidence, the others fit its weights.
    """
    characters = character_model(docs)
    return fit_labels(characters, docs, labels, max_rows)


def fit_labels(characters: CharacterModel, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> ToxicityModel:
    rows = labelled_texts(docs, labels)
    part = F.pmod(F.xxhash64("text", F.lit("part")), F.lit(5))

    def count_buckets(batches):
        restorer, texts = Restorer(characters), np.zeros(2, dtype=np.int64)
        seen = np.zeros((2, BUCKETS), dtype=np.int32)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                seen[int(toxic > 0), text_buckets(restorer.text(text))] += 1
                texts[int(toxic > 0)] += 1
        used = np.nonzero(seen.any(axis=0))[0]
        yield pd.DataFrame({"bucket": np.append(used, -1), "clean": np.append(seen[0, used], texts[0]), "toxic": np.append(seen[1, used], texts[1])})

    counted = rows.filter(part > 0).select("text", "toxic").mapInPandas(count_buckets, "bucket long, clean long, toxic long")
    # At most 2^20 + 1 rows; -1 has the numbers of texts.
    found = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow().to_pandas().sort_values("bucket")
    bare = found[found["bucket"] < 0]
    clean, toxic = (int(bare["clean"].sum()), int(bare["toxic"].sum()))
    found = found[found["bucket"] >= 0]
    evidence = np.zeros(BUCKETS, dtype=np.float32)
    if clean and toxic:
        c, t = found["clean"].to_numpy(), found["toxic"].to_numpy()
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        evidence[found["bucket"].to_numpy()] = odds * (c + t) / (c + t + SHRINK)
    base = ToxicityModel(characters, evidence, np.zeros(TOP + 1))

    def strongest(batches):
        restorer = Restorer(characters)
        for batch in batches:
            best = np.array([base.strongest(restorer.text(t)) for t in batch["text"]]).reshape(-1, TOP)
            yield pd.DataFrame({**{f"e{k}": best[:, k] for k in range(TOP)}, "toxic": (batch["toxic"] > 0).astype("int32")})

    kept = rows.filter(part == 0).select("text", "toxic", F.xxhash64("text", F.lit("fit")).alias("_draw"))
    bound = kept.count()
    kept = kept.filter(F.pmod("_draw", F.lit(max(1, bound))) < max_rows).select("text", "toxic")
    sample = kept.mapInPandas(strongest, ", ".join(f"e{k} double" for k in range(TOP)) + ", toxic int").toArrow().to_pandas().sort_values([f"e{k}" for k in range(TOP)] + ["toxic"])
    y = sample["toxic"].to_numpy(dtype=np.float64)
    if not clean or not toxic or not 0 < y.sum() < len(y):
        share = toxic / max(1, clean + toxic)
        return ToxicityModel(characters, np.zeros_like(evidence), np.array([*[0.0] * TOP, np.log(max(share, 1e-15) / max(1 - share, 1e-15))]))
    return ToxicityModel(characters, evidence, logistic(sample[[f"e{k}" for k in range(TOP)]].to_numpy(), y))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(id_remainder(5) != 0)
    model = fit(docs, labels)
    scored = docs.select("doc_id", F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out"), model.column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op4_toxicity": op4_toxicity}
