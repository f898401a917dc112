"""Personal data by weak supervision.

Candidates of every kind are found by patterns, leftmost and not overlapping: those of the base rules and
looser ones (spelled-out addresses, phone numbers without a plus sign, grouped digits, ...). Three labelers vote
on each candidate, yes, no or nothing: ``regex`` (a strict form), ``gazetteer`` (known mail hosts, calling codes,
card issuers, address ranges) and ``context`` (words before the candidate). The numbers of candidates by kind
and votes are few; expectation-maximisation over them estimates each labeler's reliability and, for each
pattern of votes, how likely it is right. A logistic span classifier is then trained on these soft labels
from features of the candidate itself (length, digits, separators, votes) and decides on looser candidates.
Base spans always stay; looser ones that overlap them, or each other, give way.

Texts are read by built-in expressions only. Positions follow from the lengths of the pieces between matches.
Patterns are written so that no text makes them backtrack at length: runs are possessive and start at their
first character.

Defined results: null and empty texts have no spans. Rows that repeat are each returned. Without candidates
nothing is learned and only base spans are given. Only ``id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.html import let
from reviewloom.llm.common import documents, text_or_empty
from reviewloom.operators.bounded import few_rows
from reviewloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
# A run of characters that a match may begin with is tried from its first character or the end of the last match.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",  # shorter runs of digits fail the rule anyway
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:\(at\)|\[at\]|\{at\}| at )\s?[A-Za-z0-9-]{1,63}+(?:\s?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.)\s?[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\s?[0-9]{1,3}+){3}+(?![0-9.])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}+[._/]){3}+[0-9]{1,7}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}+|\(?0?[1-9][0-9]{1,3}+\)?)[\x20.-][0-9]{3,4}+(?:[\x20.-][0-9]{2,4}+){1,3}+(?![0-9A-Za-z.-]?[0-9A-Za-z])",
}
# Public mail hosts, common calling codes, first digits of card issuers, words that announce a kind.
MAIL_HOSTS = "gmail|googlemail|yahoo|hotmail|outlook|live|icloud|aol|gmx|web|mail|proton|protonmail|orange|free"
CALLING = r"^(?:\+|00)(?:1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|50[0-9]|59[0-9]|67[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|62|65)"
CONTEXT = {
    "email": r"(?:e-?mail|mailto|contact|write|correo|courriel|kontakt|adresse)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?:\bip\b|host|server|address|addr|adresse|client|from|login)\W*(?:\w+\W+){0,2}$",
    "card": r"(?:card|visa|mastercard|amex|karte|carte|tarjeta|credit|payment|paid)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?:phone|tel|telefon|telefono|teléfono|téléphone|call|mobile|cell|fax|ruf|whatsapp)\W*(?:\w+\W+){0,2}$",
}
AGAINST = r"(?:version|isbn|order|invoice|page|item|serial|token|sku|ref|section|chapter|no)\W*$"
BEFORE = 40  # characters before a candidate that the context labeler reads
LABELERS = ("regex", "gazetteer", "context")
VOTES, FEATURES = ("v0", "v1", "v2"), ("f0", "f1")
THRESHOLD = 0.5
RUN = 256
SPANS = "array<struct<start:int,end:int,value:string,before:string>>"
PLACED = "array<struct<start:int,order:int,end:int,kind:string,base:boolean>>"
ROUNDS = 100


def with_matches(rows: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` plus, for each name, the array of (start, end, value) of all matches of a pattern in ``_x``, in
    code points. The condition beside a pattern is cheap and must hold wherever the pattern can match."""
    none = F.array().cast("array<string>")
    values = [F.when(hint, F.regexp_extract_all("_x", F.lit(p), F.lit(0))).otherwise(none).alias(f"_v_{n}") for n, (p, hint) in patterns.items()]
    found = rows.select("*", *values)
    pieces = [F.when(F.size(f"_v_{n}") > 0, F.split("_x", p, -1)).alias(f"_p_{n}") for n, (p, _) in patterns.items()]
    found = found.select("*", *pieces)
    return found.select(*rows.columns, *[spans(F.col(f"_v_{n}"), F.col(f"_p_{n}")).alias(n) for n in patterns])


def spans(values: Column, pieces: Column) -> Column:
    """Places of the matches ``values`` between the ``pieces`` of a text, with the ``BEFORE`` characters in front."""
    paired = F.zip_with(values, F.slice(pieces, 1, F.size(values)), lambda v, p: F.struct(v.alias("v"), p.alias("p")))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))

    def step(s: Column, e: Column) -> Column:
        return F.struct((s["at"] + F.length(e["p"]) + F.length(e["v"])).alias("at"), F.right(F.concat(s["tail"], e["p"], e["v"]), F.lit(BEFORE)).alias("tail"))

    def placed(s: Column, e: Column) -> Column:
        start = s["at"] + F.length(e["p"])
        return span(start, start + F.length(e["v"]), e["v"], F.right(F.concat(s["tail"], e["p"]), F.lit(BEFORE)))

    found = swept(paired, begin, step, lambda s, e: F.lit(True), placed, SPANS)
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast(SPANS))


def span(start: Column, end: Column, value: Column, before: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), value.alias("value"), before.alias("before"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_rule(kind: str, value: Column) -> Column:
    """The base rule's condition on a match."""
    count = F.length(digits(value))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")).between(1, 3) & (F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).try_cast("int") <= 255)),
        "card": count.between(12, 19) & F.call_function("luhn_check", digits(value)),
        "phone": count.between(9, 15),
    }[kind]


def holds(kind: str):
    return lambda s: base_rule(kind, s["value"])


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, value: Column, before: Column) -> list[Column]:
    """The three labelers' votes on a looser candidate: 1 yes, -1 no, 0 nothing."""
    number, count = digits(value), F.length(digits(value))
    lowered = F.lower(value)
    strict = {
        "email": vote(lowered.rlike(r"[\[({](?:at)[\])}]"), lowered.rlike(r"^\S{1,2}\s|\s(?:the|a|an|this|that|all|once|least|most|first|last|home|work)\b")),
        "ip": vote(F.forall(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda p: p.try_cast("int") <= 255), F.exists(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda p: p.try_cast("int") > 255)),
        "card": vote(count.between(12, 19) & F.call_function("luhn_check", number), ~count.between(12, 19) | ~F.call_function("luhn_check", number)),
        "phone": vote(count.between(9, 15), ~count.between(9, 15)),
    }[kind]
    known = {
        "email": vote(lowered.rlike(rf"\b(?:{MAIL_HOSTS})\b|\b(?:com|org|net|edu|de|fr|es|uk)$"), F.lit(False)),
        "ip": vote(number.rlike("^(?:10|127|172|192)"), number.rlike("^0")),
        "card": vote(number.rlike(ISSUERS), ~number.rlike(ISSUERS)),
        "phone": vote(F.regexp_replace(value, "[^0-9+]", "").rlike(CALLING), number.rlike("^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])")),
    }[kind]
    around = F.lower(before)
    return [strict, known, vote(around.rlike(CONTEXT[kind]), around.rlike(AGAINST))]


def features(value: Column) -> list[Column]:
    """Coarse features of a candidate, small integers."""
    separators = F.length(F.regexp_replace(value, "[0-9A-Za-z]", ""))
    return [F.least(F.length(digits(value)), F.lit(19)), F.least(separators, F.lit(9))]


@dataclass(frozen=True)
class SpanModel:
    """Per kind: weights of digits, separators, their squares, each labeler's yes and no, and the bias."""

    weights: dict[str, tuple[float, ...]]
    reliability: dict[str, dict[str, float]]

    def accepted(self, s: Column) -> Column:
        """Whether the classifier takes the candidate ``s``, a struct of ``candidates``."""
        found = F.lit(False)
        squares = [s[f] * s[f] / 100 for f in FEATURES]
        inputs = [F.lit(1.0), *(s[f] / 10 for f in FEATURES), *squares, *((s[v] == y).cast("double") for v in VOTES for y in (1, -1))]
        for kind, w in self.weights.items():
            total = F.lit(0.0)
            for weight, x in zip(w, inputs):
                total = total + F.lit(float(weight)) * x
            found = F.when(s["order"] == KINDS.index(kind), total >= math.log(THRESHOLD / (1 - THRESHOLD))).otherwise(found)
        return found


def expectation_maximisation(counts: dict[tuple[int, ...], int]) -> tuple[dict[tuple[int, ...], float], list[dict[int, float]], float]:
    """From the numbers of candidates by votes: for each pattern its probability of being right, for each
    labeler the probability of a vote given a right candidate, and the share of right ones.

    Labelers are taken as independent given the truth; they start as somewhat better than chance, and votes
    are smoothed, so labelers that never vote do no harm.
    """
    share = 0.5
    hit = [{1: 0.5, 0: 0.4, -1: 0.1} for _ in LABELERS]
    miss = [{1: 0.1, 0: 0.4, -1: 0.5} for _ in LABELERS]
    right: dict[tuple[int, ...], float] = {}
    total = sum(counts.values())
    for _ in range(ROUNDS):
        for pattern in counts:
            yes, no = share, 1 - share
            for k, v in enumerate(pattern):
                yes, no = yes * hit[k][v], no * miss[k][v]
            right[pattern] = yes / (yes + no)
        mass = sum(n * right[p] for p, n in counts.items())
        share = (mass + 1) / (total + 2)
        for k in range(len(LABELERS)):
            for v in (1, 0, -1):
                seen = sum(n * right[p] for p, n in counts.items() if p[k] == v)
                all_ = sum(n for p, n in counts.items() if p[k] == v)
                # The prior keeps the meaning of yes and no.
                hit[k][v] = (seen + 10 * {1: 0.5, 0: 0.4, -1: 0.1}[v]) / (mass + 10)
                miss[k][v] = (all_ - seen + 10 * {1: 0.1, 0: 0.4, -1: 0.5}[v]) / (total - mass + 10)
    return right, hit, share


def train_classifier(cells: list[tuple[tuple[int, ...], tuple[int, int], int]], right: dict[tuple[int, ...], float], steps: int = 2000, rate: float = 0.5) -> tuple[float, ...]:
    """Logistic weights from (votes, features, number) cells and the soft labels of their votes."""
    rows = []
    for pattern, (a, b), n in cells:
        x = [1.0, a / 10, b / 10, (a / 10) ** 2, (b / 10) ** 2] + [float(v == s) for v in pattern for s in (1, -1)]
        rows.append((x, right[pattern], n))
    total = sum(n for *_, n in rows)
    w = [0.0] * len(rows[0][0])
    for _ in range(steps):
        gradient = [1e-3 * v for v in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(a * b for a, b in zip(w, x))))))
            for i, a in enumerate(x):
                gradient[i] += (p - y) * a * n / total
        w = [a - rate * g for a, g in zip(w, gradient)]
    return tuple(w)


def with_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _x (text), and per kind ``base_<kind>`` (matches that fail the rule dropped, without another
    try) and ``loose_<kind>``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("_x"))
    hints = {
        "base_email": F.col("_x").contains("@"), "base_ip": F.col("_x").rlike(r"[0-9]\.[0-9]"), "base_card": F.col("_x").rlike("[0-9]{2}|[0-9][ -][0-9]"), "base_phone": F.col("_x").rlike(r"\+[0-9]"),
        "loose_email": F.col("_x").rlike(r"(?i)[\[({ ]at[\])} ]"), "loose_ip": F.col("_x").rlike(r"[0-9]\s?[\[(]"), "loose_card": F.col("_x").rlike(r"[0-9]{4}[._/][0-9]{4}"), "loose_phone": F.col("_x").rlike(r"[0-9]\)?[\x20.-][0-9]{3}"),
    }
    patterns = {f"base_{k}": BASE[k] for k in KINDS} | {f"loose_{k}": LOOSE[k] for k in KINDS}
    found = with_matches(rows, {n: (p, hints[n]) for n, p in patterns.items()})
    held = [F.filter(f"base_{k}", holds(k)).alias(f"base_{k}") for k in KINDS]
    return found.select("doc_id", "_x", *held, *[f"loose_{k}" for k in KINDS])


def swept(spans_: Column, begin: Column, step, keeps, value, kind: str) -> Column:
    """One pass over an array in order: the ``value`` (state, element) of every element that ``keeps`` holds for, where
    ``step`` gives the next state. Elements are passed in blocks of ``RUN``, so long arrays cost no more than their length."""

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / RUN).cast("int")), lambda k: F.slice(x, k * RUN + 1, RUN))

    def one(acc: Column, e: Column) -> Column:
        found = F.when(keeps(acc["s"], e), F.concat(acc["found"], F.array(value(acc["s"], e)))).otherwise(acc["found"])
        return F.struct(step(acc["s"], e).alias("s"), found.alias("found"))

    def block(acc: Column, some: Column) -> Column:
        own = F.aggregate(some, F.struct(acc["s"].alias("s"), F.array().cast(kind).alias("found")), one)
        return let(own, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["found"], F.array(r["found"])).alias("found")))

    start = F.struct(begin.alias("s"), F.array().cast(f"array<{kind}>").alias("found"))
    return let(spans_, lambda x: F.flatten(F.aggregate(blocks(x), start, block)["found"]))


def free(loose: Column, taken: Column) -> Column:
    """The spans of ``loose`` that overlap none of ``taken``: a pass forward that knows how far those before reach,
    and one back that knows where those behind begin."""
    marks = F.transform(taken, lambda t: F.struct(t["start"].alias("start"), F.lit(0).alias("k"), t["end"].alias("end"), F.lit("").alias("value"), F.lit("").alias("before")))

    def among(spans_: Column) -> Column:
        return F.sort_array(F.concat(marks, F.transform(spans_, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("k"), t["end"].alias("end"), t["value"].alias("value"), t["before"].alias("before")))))

    def plain(_, e: Column) -> Column:
        return span(e["start"], e["end"], e["value"], e["before"])

    is_taken = lambda e: e["k"] == 0
    ahead = swept(among(loose), F.lit(0), lambda s, e: F.when(is_taken(e), F.greatest(s, e["end"])).otherwise(s), lambda s, e: ~is_taken(e) & (s <= e["start"]), plain, SPANS)
    back = lambda kept: swept(F.reverse(among(kept)), F.lit(2**31 - 1), lambda s, e: F.when(is_taken(e), F.least(s, e["start"])).otherwise(s), lambda s, e: ~is_taken(e) & (e["end"] <= s), plain, SPANS)
    return F.when((F.size(loose) > 0) & (F.size(taken) > 0), F.reverse(let(ahead, back))).otherwise(loose)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, per kind ``base_<kind>`` (start, end), and ``loose``: (start, order, end, votes, features) of the
    looser candidates beside them. Written, so the texts are searched once."""
    taken = F.concat(*[F.col(f"base_{k}") for k in KINDS])

    def judged(order: int, kind: str):
        def of(s):
            cast = [v.alias(n) for v, n in zip(votes(kind, s["value"], s["before"]), VOTES)]
            return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), *cast, *[f.alias(n) for f, n in zip(features(s["value"]), FEATURES)])

        return F.transform(free(F.col(f"loose_{kind}"), taken), of)

    loose = F.concat(*[judged(i, k) for i, k in enumerate(KINDS)])
    base = [F.transform(f"base_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(f"base_{k}") for k in KINDS]
    return cut_lineage(with_spans(docs, doc_id, text).select("doc_id", *base, loose.alias("loose")))


def learn(found: DataFrame) -> SpanModel:
    """EM and the span classifier over all looser ``candidates``."""
    names = ["order", *VOTES, *FEATURES]
    cells = found.select(F.explode("loose").alias("s")).select(*[F.col(f"s.{n}") for n in names])
    rows = few_rows(cells.groupBy(*names).count(), len(KINDS) * 27 * 20 * 10, "vote cells")  # cannot be more
    weights, reliability = {}, {}
    for order, k in enumerate(KINDS):
        own = sorted((tuple(r[v] for v in VOTES), tuple(r[f] for f in FEATURES), r["count"]) for r in rows if r["order"] == order)
        if not own:
            continue
        counts: dict[tuple[int, ...], int] = {}
        for pattern, _, n in own:
            counts[pattern] = counts.get(pattern, 0) + n
        right, hit, _ = expectation_maximisation(counts)
        weights[k] = train_classifier(own, right)
        reliability[k] = {name: hit[i][1] for i, name in enumerate(LABELERS)}
    return SpanModel(weights, reliability)


def find(found: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, base_<kind> arrays and ``spans`` of ``candidates``: (start, order, end, kind, base), base spans and
    those that the classifier takes. Of overlapping looser spans the first stays."""

    def placed(s, kind: Column, order: Column, base: bool):
        return F.struct(s["start"].alias("start"), order.alias("order"), s["end"].alias("end"), kind.alias("kind"), F.lit(base).alias("base"))

    def base_of(order: int, kind: str):
        return F.transform(f"base_{kind}", lambda s: placed(s, F.lit(kind), F.lit(order), True))

    names = F.array(*[F.lit(k) for k in KINDS])
    taken = F.transform(F.filter("loose", model.accepted), lambda s: placed(s, F.get(names, s["order"]), s["order"], False))
    every = F.sort_array(F.concat(*[base_of(i, k) for i, k in enumerate(KINDS)], taken))
    rows = found.select("doc_id", *[f"base_{k}" for k in KINDS], every.alias("_all"))
    rows = rows.withColumn("_extra", F.filter("_all", lambda s: ~s["base"]))

    # Of the looser spans in order, one stays if none before it reaches into it.
    first = swept(F.col("_extra"), F.lit(0), lambda s, e: F.greatest(s, e["end"]), lambda s, e: s <= e["start"], lambda _, e: e, PLACED)
    clear = F.when(F.size("_extra") > 0, F.sort_array(F.concat(F.filter("_all", lambda s: s["base"]), first))).otherwise(F.col("_all"))
    return rows.select("doc_id", *[f"base_{k}" for k in KINDS], clear.alias("spans"))


def joined(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    seen = candidates(docs)
    found = find(seen, learn(seen))
    base = joined(F.filter("spans", lambda s: s["base"]))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op2_personal_data": op2_personal_data}
