"""Aspect tagging, scores and verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.constants import ASPECT_KEYWORDS, POSITIVE, SUMMARY_BEST, SUMMARY_NONE, SUMMARY_WORST
from reviewloom.functions.labels import round_score, verdict_label
from reviewloom.operators.bounded import bounded

Lexicon = Mapping[str, Sequence[str]]
MAX_LEXICON = 100_000  # keywords; the lexicon is configuration, and its size is checked on load


def lexicon_from_table(lexicon: DataFrame) -> dict[str, list[str]]:
    """Lexicon from ``(aspect, aspect_order, keyword)``; more than MAX_LEXICON rows raise."""
    rows = bounded(lexicon.select("aspect", "aspect_order", "keyword").distinct(), MAX_LEXICON, "lexicon").collect()
    found: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.aspect_order, r.aspect, r.keyword)):
        found.setdefault(row.aspect, []).append(row.keyword)
    return found


def aspect_keyword_match(keyword: str | Column, lowered: Column, prepared: Column, mode: str = "substring") -> Column:
    """Is the keyword in the lower-cased raw text or in the prepared text? Substrings count: "ram"
    matches "ramah". ``mode='word'`` asks for whole words instead."""
    word = F.lit(keyword) if isinstance(keyword, str) else keyword
    inside = lowered.contains(word) | prepared.contains(word)
    if mode == "substring":
        return inside
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), word, F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.when(inside, F.rlike(lowered, quoted) | F.rlike(prepared, quoted)).otherwise(False)


WORD_CHAR = r"[\p{L}\p{N}_]"
WAYS = 5  # alternatives that a pattern tries one by one


def _trie_pattern(words: Sequence[str]) -> str:
    """A pattern that matches the longest of the words at a place; common beginnings are written once.

    Many ways to go on are split by classes of their first characters, so few are tried.
    """

    def char(c: str) -> str:
        return c if c.isascii() and c.isalnum() else rf"\x{{{ord(c):x}}}"

    def either(heads: dict[str, list[str]]) -> str:
        if len(heads) <= WAYS:
            ways = [char(c) + branch(rest) for c, rest in heads.items()]
        else:
            step, order = -(-len(heads) // WAYS), list(heads)
            runs = [order[i : i + step] for i in range(0, len(order), step)]
            ways = [f"(?=[{''.join(map(char, run))}]){either({c: heads[c] for c in run})}" for run in runs]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    def branch(group: Sequence[str]) -> str:
        heads: dict[str, list[str]] = {}
        for word in sorted(group):
            if word:
                heads.setdefault(word[0], []).append(word[1:])
        more = either(heads) if heads else ""
        return f"(?:{more})?" if more and "" in group else more

    return branch(words)


def _places(text: Column, words: Sequence[str], mode: str) -> Column:
    """The longest word at each place of a text, distinct: one pattern for all words, tried at every place, so
    the cost of a text hardly grows with their number."""
    edge = ("", "") if mode == "substring" else (rf"(?<!{WORD_CHAR})", rf"(?!{WORD_CHAR})")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"{edge[0]}(?=({_trie_pattern(words)}){edge[1]})"), F.lit(1)))


def _with_beginnings(found: Column, words: Sequence[str], mode: str) -> Column:
    """``found``, and the words that begin one of them at the same place. ``words`` is sorted."""
    begun: dict[str, list[str]] = {}  # word -> those that it begins with
    stack: list[str] = []
    for word in words:
        while stack and not word.startswith(stack[-1]):
            stack.pop()
        heads = [h for h in stack if mode == "substring" or not (word[len(h)].isalnum() or word[len(h)] == "_")]
        if heads:
            begun[word] = heads
        stack.append(word)
    if not begun:
        return F.array_sort(found)
    known = F.create_map(*[x for word, heads in begun.items() for x in (F.lit(word), F.lit(heads))])
    more = F.flatten(F.transform(found, lambda w: F.coalesce(F.try_element_at(known, w), F.array().cast("array<string>"))))
    return F.array_sort(F.array_union(found, more))


def aspect_tag(
    df: DataFrame,
    text: str,
    lexicon: Lexicon = ASPECT_KEYWORDS,
    prepared: str | None = None,
    mode: str = "substring",
) -> DataFrame:
    """Add ``keywords`` (sorted distinct matches in the raw or the prepared text) and ``aspects``
    (matched aspects, lexicon order).

    Narrow: no join, no shuffle, and one pattern whatever the number of keywords.
    """
    words = sorted({w for group in lexicon.values() for w in group})
    searched = F.lower(F.coalesce(F.col(text), F.lit("")))
    if prepared:  # no keyword holds the character between the two
        searched = F.concat(searched, F.lit("\0"), F.coalesce(F.col(prepared), F.lit("")))
    real = [w for w in words if w]
    none = F.array().cast("array<string>")
    # In a column of its own, or the texts would be searched once per use.
    base = df.withColumn("_found", _places(searched, real, mode) if real else none)
    found = _with_beginnings(F.col("_found"), real, mode)
    if len(real) < len(words):  # the empty keyword is in every text
        found = F.concat(F.array(F.lit("")), found)
    tagged = base.withColumn("keywords", found).drop("_found")
    aspects = [
        F.when(F.arrays_overlap("keywords", F.lit(list(group))), F.lit(aspect))
        for aspect, group in lexicon.items()
        if group
    ]
    return tagged.withColumn("aspects", F.array_compact(F.array(*aspects)))


def product_sums(tagged: DataFrame, by: Sequence[str], lexicon: Lexicon, sentiment: str) -> DataFrame:
    """One row per product: review counts, and ``stats`` = array of (aspect, aspect_order, total,
    positive) with every aspect of the lexicon.

    One shuffle carries 2 + 2 * aspects sums per product and map task. A hot product is combined
    map-side, and a review counts once per aspect without any distinct.
    """
    positive = F.coalesce((F.col(sentiment) == POSITIVE).cast("int"), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("total_reviews"), F.sum(positive).alias("positive_count")]
    for i, aspect in enumerate(lexicon):
        has = F.array_contains("aspects", aspect)
        aggs.append(F.sum(has.cast("int")).alias(f"_t{i}"))
        aggs.append(F.sum(F.when(has, positive).otherwise(0)).alias(f"_p{i}"))
    stats = F.array(
        *[
            F.struct(
                F.lit(aspect).alias("aspect"),
                F.lit(i).alias("aspect_order"),
                F.col(f"_t{i}").alias("total"),
                F.col(f"_p{i}").alias("positive"),
            )
            for i, aspect in enumerate(lexicon)
        ]
    )
    return tagged.groupBy(*by).agg(*aggs).select(*by, "total_reviews", "positive_count", stats.alias("stats"))


def aspect_stats(tagged: DataFrame, by: Sequence[str], lexicon: Lexicon = ASPECT_KEYWORDS, sentiment: str = "sentiment") -> DataFrame:
    """``(*by, aspect, aspect_order, total, positive)``; aspects nobody mentions have zeros."""
    return product_sums(tagged, by, lexicon, sentiment).select(*by, F.inline("stats"))


def sentiment_pct(df: DataFrame, by: Sequence[str], sentiment: str = "sentiment", neutral: str = "negative") -> DataFrame:
    """Positive share in percent. Neutral reviews count as negative; ``neutral='separate'`` reports
    them in a column of their own."""
    positive = F.count(F.when(F.col(sentiment) == POSITIVE, 1))
    aggs = [F.count(F.lit(1)).alias("total_reviews"), positive.alias("positive_count")]
    if neutral == "separate":
        aggs.append(F.count(F.when(F.col(sentiment) == "netral", 1)).alias("neutral_count"))
    rest = F.col("total_reviews") - F.col("positive_count")
    if neutral == "separate":
        rest = rest - F.col("neutral_count")
    out = df.groupBy(*by).agg(*aggs).withColumn("negative_count", rest)
    return out.withColumn("general_score", F.col("positive_count") / F.col("total_reviews") * 100)


def score_of(total: Column, positive: Column, digits: int = 1) -> Column:
    return F.when(total > 0, round_score(positive / total * 100, digits)).otherwise(F.lit(0.0))


def aspect_scores(stats: DataFrame, digits: int = 1) -> DataFrame:
    """Add ``score``: positive share in percent, rounded half-even; 0 when nobody mentions it."""
    return stats.withColumn("score", score_of(F.col("total"), F.col("positive"), digits))


def valid_aspects(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("total") > 0)


def aspect_scores_map(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(*by, aspect_scores)`` as a map aspect → score, in lexicon order."""
    entry = F.struct("aspect_order", "aspect", "score")
    ordered = F.sort_array(F.collect_list(entry))
    pairs = F.transform(ordered, lambda e: F.struct(e["aspect"].alias("key"), e["score"].alias("value")))
    return scores.groupBy(*by).agg(F.map_from_entries(pairs).alias("aspect_scores"))


def best_worst_aspect(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best and worst mentioned aspect by rounded score; ties go to the first in the lexicon."""
    seen = valid_aspects(scores)
    high = F.struct("score", (-F.col("aspect_order")).alias("o"), "aspect")
    low = F.struct("score", F.col("aspect_order").alias("o"), "aspect")
    picked = seen.groupBy(*by).agg(F.max(high).alias("_best"), F.min(low).alias("_worst"))
    return picked.select(
        *by,
        F.col("_best.aspect").alias("best_aspect"),
        F.col("_best.score").alias("best_score"),
        F.col("_worst.aspect").alias("worst_aspect"),
        F.col("_worst.score").alias("worst_score"),
    )


def _sentence(template: str, slot: str, value: Column) -> Column:
    before, after = template.split("{" + slot + "}")
    return F.concat(F.lit(before), value, F.lit(after))


def verdict_summary(
    best: Column,
    worst: Column,
    worst_score: Column,
    low: float = 60,
    templates: Sequence[str] = (SUMMARY_BEST, SUMMARY_WORST, SUMMARY_NONE),
) -> Column:
    """Sentence naming the best aspect, and the worst one if it scores below ``low``; a general
    sentence when no aspect is mentioned (``best`` null)."""
    praise = _sentence(templates[0], "best", F.upper(best))
    blame = F.when(worst_score < low, _sentence(templates[1], "worst", F.upper(worst))).otherwise("")
    return F.when(best.isNull(), F.lit(templates[2])).otherwise(F.concat(praise, blame))


def product_results(sums: DataFrame, by: Sequence[str], digits: int = 1) -> DataFrame:
    """From :func:`product_sums` to one scored row per product, without a further shuffle: the few
    aspects of a product are an array, and best and worst are array operations."""
    scored = F.transform(
        "stats",
        lambda s: F.struct(
            s["aspect"].alias("aspect"),
            s["aspect_order"].alias("aspect_order"),
            s["total"].alias("total"),
            s["positive"].alias("positive"),
            score_of(s["total"], s["positive"], digits).alias("score"),
        ),
    )
    seen = F.filter("scored", lambda s: s["total"] > 0)
    best = F.array_max(
        F.transform("seen", lambda s: F.struct(s["score"].alias("score"), (-s["aspect_order"]).alias("o"), s["aspect"].alias("aspect")))
    )
    worst = F.array_min(
        F.transform("seen", lambda s: F.struct(s["score"].alias("score"), s["aspect_order"].alias("o"), s["aspect"].alias("aspect")))
    )
    pct = F.col("positive_count") / F.col("total_reviews") * 100
    pairs = F.transform("scored", lambda s: F.struct(s["aspect"].alias("key"), s["score"].alias("value")))
    return (
        sums.withColumn("scored", scored)
        .withColumn("seen", seen)
        .withColumn("_best", best)
        .withColumn("_worst", worst)
        .select(
            *by,
            pct.alias("general_score"),
            F.map_from_entries(pairs).alias("aspect_scores"),
            "total_reviews",
            "positive_count",
            (F.col("total_reviews") - F.col("positive_count")).alias("negative_count"),
            verdict_label(pct).alias("verdict"),
            verdict_summary(F.col("_best.aspect"), F.col("_worst.aspect"), F.col("_worst.score")).alias("description"),
        )
    )

