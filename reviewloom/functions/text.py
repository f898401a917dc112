"""Text expressions. They never shuffle, and stay inside the JVM but for ``preprocess_serve``, which remembers the stems
of words in Python."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.constants import STOPWORDS_ID

# The characters Python's str.strip() removes. Spark's plain trim() removes only spaces.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_CLASS = r"\t-\r\x1c-\x20\x85\p{Z}"
PUNCTUATION = rf"[^\p{{L}}\p{{N}}_{_SPACE_CLASS}]"
DIGITS = r"\p{Nd}+"
WORD_CHARS = r"[\p{L}\p{N}_]"
BRACKETED = "【[^\n]*?】"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(_c(col), F.lit(WHITESPACE))


def clean_text(col: Column | str) -> Column:
    """Delete punctuation, then digits; lower-case; strip."""
    no_punct = F.regexp_replace(_c(col), PUNCTUATION, "")
    return strip(F.lower(F.regexp_replace(no_punct, DIGITS, "")))


def lower_text(col: Column | str) -> Column:
    return F.lower(_c(col))


def fill_empty_text(col: Column | str) -> Column:
    return F.coalesce(_c(col), F.lit(""))


def remove_stopwords(col: Column | str, words: Sequence[str] = STOPWORDS_ID) -> Column:
    """Drop stop words, keeping order. Tokens are separated by single spaces.

    ``isin`` with a literal list becomes a hash-set lookup, so the cost per token does not grow
    with the list.
    """
    stop = list(dict.fromkeys(words))
    tokens = F.split(_c(col), " ", -1)
    if not stop:
        return _c(col)
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(stop)), " ")


def clean_product_name(name: Column | str) -> Column:
    """Remove 【…】 spans and strip."""
    return strip(F.regexp_replace(_c(name), BRACKETED, ""))


def derive_brand(name: Column | str) -> Column:
    """Brand = first whitespace-separated token of the raw name, without 【…】; blank name → Unknown."""
    bare = strip(name)
    first = F.regexp_extract(bare, rf"^([^{_SPACE_CLASS}]+)", 1)
    return F.when(bare == "", F.lit("Unknown")).otherwise(clean_product_name(first))


def token_array(col: Column | str, min_len: int = 2) -> Column:
    """Lower-cased runs of at least ``min_len`` word characters, in order."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(f"({WORD_CHARS}{{{min_len},}})"), F.lit(1))


# --- rule stemmer -----------------------------------------------------------------------------
# After the published Porter-style affix rules for Indonesian (Tala, 2003): inflectional suffixes,
# first-order prefix, derivational suffix, second-order prefix. An affix goes only when at least two
# vowels stay, so short roots survive. No dictionary is used.
STEM_KEEP = "[^aiueo]*[aiueo][^aiueo]*[aiueo].*"
STEM_PARTICLE = f"^({STEM_KEEP})(?:kah|lah|pun)$"
STEM_POSSESSIVE = f"^({STEM_KEEP})(?:nya|ku|mu)$"
STEM_PREFIX_S = "^(?:meny|peny)([aiueo][^aiueo]*[aiueo].*)$"
STEM_PREFIX_P = "^(?:mem|pem)([aiueo][^aiueo]*[aiueo].*)$"
STEM_PREFIX_PLAIN = f"^(?:meng|peng|men|pen|mem|pem|me|di|ter|ke)({STEM_KEEP})$"
STEM_SUFFIX_KAN = f"^({STEM_KEEP})kan$"
STEM_SUFFIX_AN = f"^({STEM_KEEP})an$"
STEM_SUFFIX_I = f"^({STEM_KEEP})i$"
STEM_PREFIX_SECOND = f"^(?:ber|bel|be|per|pel|pe)({STEM_KEEP})$"


def stem_input(col: Column | str) -> Column:
    """Lower-cased tokens of a-z, 0-9 and hyphen; every other character separates."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit("([a-z0-9-]+)"), F.lit(1))


def _any_start(word: Column, *heads: str) -> Column:
    return reduce(lambda a, b: a | b, [word.startswith(h) for h in heads])


def _any_end(word: Column, *tails: str) -> Column:
    return reduce(lambda a, b: a | b, [word.endswith(t) for t in tails])


# Each rule tests plain prefixes or suffixes first, so most tokens never reach a pattern.
def _inflection(word: Column) -> Column:
    return F.when(_any_end(word, "kah", "lah", "pun"), F.regexp_replace(word, STEM_PARTICLE, "$1")).otherwise(word)


def _possessive(word: Column) -> Column:
    return F.when(_any_end(word, "nya", "ku", "mu"), F.regexp_replace(word, STEM_POSSESSIVE, "$1")).otherwise(word)


def _first_prefix(word: Column) -> Column:
    return (
        F.when(~_any_start(word, "me", "pe", "di", "ter", "ke"), word)
        .when(F.rlike(word, F.lit(STEM_PREFIX_S)), F.regexp_replace(word, STEM_PREFIX_S, "s$1"))
        .when(F.rlike(word, F.lit(STEM_PREFIX_P)), F.regexp_replace(word, STEM_PREFIX_P, "p$1"))
        .otherwise(F.regexp_replace(word, STEM_PREFIX_PLAIN, "$1"))
    )


def _suffix(word: Column, bare: Column) -> Column:
    """Derivational suffix of ``bare``; which one may go depends on the prefix ``word`` had."""

    def allowed(pattern: str, banned: tuple[str, ...]) -> Column:
        return ~_any_start(word, *banned) & F.rlike(bare, F.lit(pattern))

    return (
        F.when(~_any_end(bare, "an", "i"), bare)
        .when(allowed(STEM_SUFFIX_KAN, ("ke", "peng")), F.regexp_replace(bare, STEM_SUFFIX_KAN, "$1"))
        .when(allowed(STEM_SUFFIX_AN, ("di", "meng", "ter")), F.regexp_replace(bare, STEM_SUFFIX_AN, "$1"))
        .when(allowed(STEM_SUFFIX_I, ("ber", "ke", "peng")), F.regexp_replace(bare, STEM_SUFFIX_I, "$1"))
        .otherwise(bare)
    )


def _second_prefix(word: Column) -> Column:
    return F.when(_any_start(word, "be", "pe"), F.regexp_replace(word, STEM_PREFIX_SECOND, "$1")).otherwise(word)


def stem_tokens(tokens: Column) -> Column:
    """Stem an array of lower-case tokens. One pass per rule group keeps each lambda small."""
    words = F.transform(F.transform(tokens, _inflection), _possessive)
    pairs = F.transform(words, lambda w: F.struct(w.alias("word"), _first_prefix(w).alias("bare")))
    return F.transform(F.transform(pairs, lambda p: _suffix(p["word"], p["bare"])), _second_prefix)


def stem_text(col: Column | str, normalize: bool = True) -> Column:
    """Stem every token with the affix rules and join the stems by single spaces."""
    tokens = stem_input(col) if normalize else F.split(_c(col), " ", -1)
    return F.array_join(stem_tokens(tokens), " ")


def preprocess_train(col: Column | str, words: Sequence[str] = STOPWORDS_ID) -> Column:
    """Training-side preparation of already cleaned text: stop words, then stems."""
    return stem_text(remove_stopwords(col, words))


def preprocess_serve(col: Column | str, words: Sequence[str] = STOPWORDS_ID, clean: bool = False) -> Column:
    """Serving-side preparation of raw text: lower-case, stop words, stems.

    ``clean=True`` runs :func:`clean_text` first, which makes serving agree with training.
    """
    stop = frozenset(words)

    @F.pandas_udf("string")
    def prepared(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _prepared(t, stop) for t in texts], dtype="object")

    return prepared(clean_text(col) if clean else lower_text(col))


STEMS = 1 << 18  # words that a worker remembers at most
_stems: dict[str, str] = {}
_token, _rule = re.compile("[a-z0-9-]+"), cache(re.compile)


def _prepared(text: str, stop: frozenset[str]) -> str:
    """Stop words dropped from a lower-case text, and the stems of what is left."""
    words = _token.findall(" ".join([w for w in text.split(" ") if w not in stop]) if stop else text)
    try:
        return " ".join(map(_stems.__getitem__, words))
    except KeyError:
        new = set(words).difference(_stems)
    if len(_stems) + len(new) > STEMS:
        _stems.clear()
        new = set(words)
    for word in new:
        _stems[word] = stem_word(word)
    return " ".join(map(_stems.__getitem__, words))


def stem_word(word: str) -> str:
    """The stem that ``stem_tokens`` gives a token, rule by rule."""
    word = _rule(STEM_PARTICLE).sub(r"\1", word) if word.endswith(("kah", "lah", "pun")) else word
    word = _rule(STEM_POSSESSIVE).sub(r"\1", word) if word.endswith(("nya", "ku", "mu")) else word
    bare = word
    if word.startswith(("me", "pe", "di", "ter", "ke")):
        for pattern, stem in ((STEM_PREFIX_S, r"s\1"), (STEM_PREFIX_P, r"p\1"), (STEM_PREFIX_PLAIN, r"\1")):
            if _rule(pattern).search(word):
                bare = _rule(pattern).sub(stem, word)
                break
    if bare.endswith(("an", "i")):
        suffixes = ((STEM_SUFFIX_KAN, ("ke", "peng")), (STEM_SUFFIX_AN, ("di", "meng", "ter")), (STEM_SUFFIX_I, ("ber", "ke", "peng")))
        for pattern, banned in suffixes:
            if not word.startswith(banned) and _rule(pattern).search(bare):
                bare = _rule(pattern).sub(r"\1", bare)
                break
    return _rule(STEM_PREFIX_SECOND).sub(r"\1", bare) if bare.startswith(("be", "pe")) else bare
