"""Expressions over captured HTML. Pattern-based, JVM-side; no page is ever parsed row by row in Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.text import strip

NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
NAMES = "\u0002".join(f"{name}\u0001{text}" for name, text in html5.items())  # one literal, read as a map once
# A tag, with quoted values that may hold ">"; declarations and stray end marks too. Other "<" are text.
TAG = r"""</?[A-Za-z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|<[!?/][^>]*>"""
# What may follow "&": old names need no semicolon, unless they could be the name of a URL's parameter.
REFERENCE = r"^(?:#[xX]?[0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=])))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once. Inside lambdas Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def drop_noise(html: Column) -> Column:
    """Remove scripts, styles and comments."""
    return F.regexp_replace(html, NOISE, "")


def _reference(piece: Column) -> Column:
    """Decode the reference that a piece of text after "&" starts with, if it is one."""
    # The public HTML 5 names, with their semicolon where they need one.
    names = F.str_to_map(F.lit(NAMES), F.lit("\u0002"), F.lit("\u0001"))
    hexa = F.regexp_extract(piece, r"^#[xX]0*([0-9A-Fa-f]{1,6});", 1)
    deci = F.regexp_extract(piece, r"^#0*([0-9]{1,7});", 1)
    code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(deci != "", deci).otherwise("").try_cast("int")
    valid = let(code, lambda c: F.when(c.between(1, 0x10FFFF) & ~c.between(0xD800, 0xDFFF), c))
    numeric = F.decode(F.unhex(F.lpad(F.hex(valid), 8, "0")), "UTF-32")
    named = F.try_element_at(names, F.regexp_extract(piece, r"^[A-Za-z0-9]+;?", 0))
    char = F.when(piece.startswith("#"), numeric).otherwise(named)
    rest = F.regexp_replace(piece, r"^#?[A-Za-z0-9]+;?", "")
    return let(char, lambda c: F.when(c.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(c, rest)))


def decode_entities(text: Column) -> Column:
    """Decode named, decimal and hexadecimal character references, each once.

    The text is split at "&", so only pieces that look like a reference are worked on.
    """

    def one(piece: Column) -> Column:
        plain = F.concat(F.lit("&"), piece)
        return F.when(F.rlike(piece, F.lit(REFERENCE)), _reference(piece)).otherwise(plain)

    def whole(pieces: Column) -> Column:
        later = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(later, ""))

    return let(text, lambda t: F.when(t.contains("&"), let(F.split(t, "&", -1), whole)).otherwise(t))


def inner_text(html: Column) -> Column:
    """Text of a fragment: tags removed, entities decoded, ends stripped."""
    return strip(decode_entities(F.regexp_replace(html, TAG, "")))


def compact_text(html: Column) -> Column:
    """Text with every run between two tags stripped on its own, then joined without separators."""
    runs = F.split(html, TAG, -1)
    return F.array_join(F.transform(runs, lambda r: strip(decode_entities(r))), "")


# ---------------------------------------------------------------- whole elements
# A tag with its attributes: quoted values may hold ">".
MARK = r"""<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>"""
# Elements without contents.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RUN = 128  # tags folded together, so that long pages do not copy all their elements at each tag
OPENED = "array<struct<tag:string,attrs:string,parent:int,start:int,inside:int>>"
CLOSED = "array<struct<i:int,until:int,end:int>>"
STACK = "array<struct<i:int,tag:string>>"


def tree(html: Column) -> Column:
    """All elements of a fragment in document order: tag, attrs (the start tag's), parent (place in the array, -1
    at the top), and where the start tag, the contents and the end tag begin and end, counted from 0.

    One fold over the tags with a stack of open elements. An end tag closes the innermost open element of its
    name and everything still open inside; one without a partner is passed over; what is never closed ends with
    the fragment. Names are lower case.
    """

    def marks(values: Column, gaps: Column) -> Column:
        def one(v: Column, gap: Column) -> Column:
            name = F.lower(F.regexp_extract(v, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
            return let(name, lambda n: F.struct(n.alias("tag"), v.startswith("</").alias("closes"), (n.isin(VOID) | v.endswith("/>")).alias("empty"), v.alias("v"), F.length(gap).alias("gap")))

        return F.zip_with(values, F.slice(gaps, 1, F.size(values)), one)

    none = {"opened": F.array().cast(OPENED), "closed": F.array().cast(CLOSED)}

    def state(at, n, stack, opened, closed):
        return F.struct(at.alias("at"), n.alias("n"), stack.alias("stack"), opened.alias("opened"), closed.alias("closed"))

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + m["gap"]
        end = start + F.length(m["v"])
        parent = F.coalesce(F.get(s["stack"], F.size(s["stack"]) - 1)["i"], F.lit(-1))
        fresh = F.struct(m["tag"].alias("tag"), m["v"].alias("attrs"), parent.alias("parent"), start.alias("start"), end.alias("inside"))
        opened = F.concat(s["opened"], F.array(fresh))
        done = F.concat(s["closed"], F.array(F.struct(s["n"].alias("i"), end.alias("until"), end.alias("end"))))
        pushed = F.concat(s["stack"], F.array(F.struct(s["n"].alias("i"), m["tag"].alias("tag"))))
        more = s["n"] + 1
        place = F.array_max(F.transform(s["stack"], lambda e, k: F.when(e["tag"] == m["tag"], k)))

        def popped(k: Column) -> Column:
            gone = F.slice(s["stack"], k + 1, F.size(s["stack"]) - k)
            ends = F.transform(gone, lambda e, j: F.struct(e["i"].alias("i"), start.alias("until"), F.when(j == 0, end).otherwise(start).alias("end")))
            return state(end, s["n"], F.slice(s["stack"], F.lit(1), k), s["opened"], F.concat(s["closed"], ends))

        closing = let(place, lambda k: F.when(k.isNull(), state(end, s["n"], s["stack"], s["opened"], s["closed"])).otherwise(popped(k)))
        return F.when(m["closes"], closing).when(m["empty"], state(end, more, s["stack"], opened, done)).otherwise(state(end, more, pushed, opened, s["closed"]))

    def block(s: Column, marks_: Column) -> Column:
        begin = state(s["at"], s["n"], s["stack"], none["opened"], none["closed"])
        return let(F.aggregate(marks_, begin, step), lambda r: state(r["at"], r["n"], r["stack"], F.concat(s["opened"], F.array(r["opened"])), F.concat(s["closed"], F.array(r["closed"]))))

    def whole(marks_: Column) -> Column:
        size = F.size(marks_)
        blocks = F.transform(F.sequence(F.lit(0), F.floor(size / RUN).cast("int")), lambda k: F.slice(marks_, k * RUN + 1, RUN))
        begin = state(F.lit(0), F.lit(0), F.array().cast(STACK), F.array().cast(f"array<{OPENED}>"), F.array().cast(f"array<{CLOSED}>"))
        return let(F.aggregate(blocks, begin, block), finished)

    def finished(r: Column) -> Column:
        length = F.length(html)
        rest = F.transform(r["stack"], lambda e: F.struct(e["i"].alias("i"), length.alias("until"), length.alias("end")))
        ends = F.array_sort(F.concat(F.flatten(r["closed"]), rest))
        return F.zip_with(
            F.flatten(r["opened"]), ends,
            lambda o, c: F.struct(o["tag"].alias("tag"), o["attrs"].alias("attrs"), o["parent"].alias("parent"), o["start"].alias("start"), o["inside"].alias("inside"), c["until"].alias("until"), c["end"].alias("end")),
        )

    return let(marks(F.regexp_extract_all(html, F.lit(MARK), F.lit(0)), F.split(html, MARK, -1)), whole)


def contents(html: Column, element: Column) -> Column:
    """What lies between an element's start and end tag."""
    return F.substr(html, element["inside"] + 1, element["until"] - element["inside"])


def attribute(element: Column, name: str, empty: bool = False, decode: bool = True) -> Column:
    """Value of an attribute in double, single or no quotes; null when there is none, or when it is empty and
    ``empty`` is not asked for. References are decoded unless ``decode`` is off, as for names that need none."""
    spaces = r"""(?:\s|(?<=["']))"""
    pattern = rf"""(?is)^<[^\s>]+(?:[^"'>]|"[^"]*"|'[^']*')*?{spaces}{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    raw = F.regexp_extract(element["attrs"], pattern, 1)
    value = F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2")
    found = F.when(raw != "", let(value, decode_entities) if decode else value)
    return found if empty else F.nullif(found, F.lit(""))


def child_count(tree_: Column, number: Column) -> Column:
    """Children of the element at place ``number``: its elements, and the text runs between them."""
    own = F.get(tree_, number)
    inner = F.filter(tree_, lambda e: e["parent"] == number)
    edges = F.concat(F.transform(inner, lambda e: e["start"]), F.array(own["until"]))
    after = F.concat(F.array(own["inside"]), F.transform(inner, lambda e: e["end"]))
    runs = F.filter(F.zip_with(after, edges, lambda a, b: b > a), lambda x: x)
    return F.size(inner) + F.size(runs)


def texts_of(html: Column, tree_: Column, condition: Callable[[Column], Column]) -> Column:
    """Texts of the elements that meet a condition, in document order."""
    return F.transform(F.filter(tree_, condition), lambda e: inner_text(contents(html, e)))


def first_text(html: Column, tree_: Column, condition: Callable[[Column], Column]) -> Column:
    """Text of the first element that meets a condition, null when none does."""
    return let(F.get(F.filter(tree_, condition), F.lit(0)), lambda e: F.when(e.isNotNull(), inner_text(contents(html, e))))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def first_match(texts: Column, condition: Callable[[Column], Column]) -> Column:
    """First element of an array that meets ``condition``, null when none does."""
    return F.get(F.filter(texts, condition), F.lit(0))
