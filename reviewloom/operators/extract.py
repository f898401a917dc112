"""Extraction of links and reviews from captured pages ``(page_id, url, html)``.

Every operator is narrow except the de-duplication of URLs and the pagination rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom.constants import (
    AD_HOST_PREFIX,
    DATE_MARKERS,
    DATE_WORDS,
    NOT_REVIEW_TEXT,
    NOT_USERNAME,
    RATING_WORD,
    URL_IGNORE,
)
from reviewloom.functions.arrays import unfold
from reviewloom.functions.html import (
    attribute,
    child_count,
    compact_text,
    contains_any,
    contents,
    drop_noise,
    first_match,
    first_text,
    let,
    texts_of,
    tree,
)
from reviewloom.functions.text import clean_text
from reviewloom.functions.urls import SCHEME, resolve_url



ANCHOR = r"""(?i)<a(?=[\s/])(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
BASE_TAG = r"""(?i)<base(?=[\s/])(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""


# --- links ------------------------------------------------------------------------------------
def extract_links(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",), base: str | None = "url") -> DataFrame:
    """One row per ``<a href>`` on a page, the link absolute: resolved against the page's address in ``base``, or
    against the page's own ``<base href>``. Without ``base`` the references are as they stand. A reference that needs
    an address the page does not have gives no row."""
    page = F.col("_page")
    rows = pages.select(*keep, *([F.col(base).alias("_url")] if base else []), drop_noise(F.col(html)).alias("_page"))
    marks = F.regexp_extract_all(page, F.lit(ANCHOR), F.lit(0))
    hrefs = F.filter(F.transform(marks, lambda m: attribute(F.struct(m.alias("attrs")), "href", empty=True)), lambda h: h.isNotNull())
    rows = rows.withColumn("_hrefs", hrefs)
    if base is None:
        return unfold(rows, keep, F.col("_hrefs"), "href")
    # Most pages declare no address of their own.
    declared = attribute(F.struct(F.regexp_extract(page, BASE_TAG, 0).alias("attrs")), "href")
    home = F.when(F.rlike(page, F.lit("(?i)<base")), let(declared, lambda d: F.coalesce(resolve_url(F.col("_url"), d), d, F.col("_url")))).otherwise(F.col("_url"))
    rows = rows.filter(F.size("_hrefs") > 0).withColumn("_home", home)
    # Resolved inside the array: a filter on the links would else resolve them again.
    whole = F.transform("_hrefs", lambda r: F.coalesce(resolve_url(F.col("_home"), r), F.when(F.rlike(r, F.lit(SCHEME)), r)))
    return unfold(rows, keep, F.filter(whole, lambda link: link.isNotNull()), "href")


def filter_product_urls(
    links: DataFrame, domain: str, ignore: Sequence[str] | None = None, min_len: int = 35, url: str = "href"
) -> DataFrame:
    """Keep product links: on the domain, on no ignored page, at least ``min_len`` characters long
    with the query string still on."""
    banned = [AD_HOST_PREFIX + domain, *URL_IGNORE] if ignore is None else list(ignore)
    link = F.col(url)
    return links.filter(
        link.isNotNull() & link.contains(domain) & ~contains_any(link, banned) & (F.length(link) >= min_len)
    )


def canonicalize_product_url(url: Column | str) -> Column:
    """Drop the query string and point to the review page."""
    col = F.col(url) if isinstance(url, str) else url
    return F.concat(F.substring_index(col, "?", 1), F.lit("/review"))


def distinct_urls(links: DataFrame, url: str = "url") -> DataFrame:
    return links.select(url).distinct()


# --- review containers ------------------------------------------------------------------------
def select_review_containers(
    pages: DataFrame,
    html: str = "html",
    markers: Sequence[str] = tuple(DATE_MARKERS),
    article_bounds: tuple[int, int] = (50, 3000),
    div_bounds: tuple[int, int] = (50, 2000),
    child_bounds: tuple[int, int] = (3, 30),
    keep: Sequence[str] = ("page_id", "url"),
    variant: str = "new",
) -> DataFrame:
    """Review containers of each page by the first strategy that finds any: review cards; articles
    that look like reviews; divs that look like reviews, nested ones each for itself. ``variant='old'`` falls back
    from cards to all articles. All bounds are exclusive. Returns ``(*keep, strategy, container_no, container)``.
    """
    page, elements = F.col("_page"), F.col("_tree")
    base = pages.select(*keep, drop_noise(F.col(html)).alias("_page"))
    base = base.withColumn("_tree", tree(page))

    def fits(text: Column, bounds: tuple[int, int]) -> Column:
        return (F.length(text) > bounds[0]) & (F.length(text) < bounds[1]) & contains_any(text, markers)

    def boxes(condition) -> Column:
        return F.transform(F.filter(elements, condition), lambda e: contents(page, e))

    cards = boxes(lambda e: (e["tag"] == "div") & (attribute(e, "data-testid", decode=False) == "reviewCard"))
    base = base.withColumn("_cards", F.when(page.contains("reviewCard"), cards).otherwise(F.array().cast("array<string>")))
    no_cards = F.size("_cards") == 0
    articles = boxes(lambda e: e["tag"] == "article")
    if variant == "old":
        base = base.withColumn("_articles", F.when(no_cards, articles))
        options = [("card", F.col("_cards")), ("article", F.col("_articles"))]
    else:
        lo, hi = child_bounds
        base = base.withColumn("_articles", F.when(no_cards, F.filter(articles, lambda a: fits(compact_text(a), article_bounds))))
        # The text decides first, so children are counted for few.
        numbered = F.transform(elements, lambda e, i: F.struct(i.alias("i"), e.alias("e")))
        likely = F.filter(numbered, lambda x: (x["e"]["tag"] == "div") & fits(compact_text(contents(page, x["e"])), div_bounds))
        divs = F.filter(likely, lambda x: let(child_count(elements, x["i"]), lambda n: (n > lo) & (n < hi)))
        base = base.withColumn("_divs", F.when(F.size("_articles") == 0, F.transform(divs, lambda x: contents(page, x["e"]))))
        options = [("card", F.col("_cards")), ("article", F.col("_articles")), ("div", F.col("_divs"))]
    strategy, chosen = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for name, found in reversed(options):
        strategy = F.when(F.size(found) > 0, F.lit(name)).otherwise(strategy)
        chosen = F.when(F.size(found) > 0, found).otherwise(chosen)
    picked = base.select(*keep, strategy.alias("strategy"), chosen.alias("_chosen"))
    return unfold(picked, [*keep, "strategy"], F.col("_chosen"), "container", "container_no")


# --- fields of one container ------------------------------------------------------------------
def _with_tree(container: Column, elements: Column | None, body) -> Column:
    """``body`` of the container's elements, which are read here unless they are given."""
    return body(elements) if elements is not None else let(tree(container), body)


def _is(tag: str, attr: str | None = None, value: str | None = None):
    return lambda e: (e["tag"] == tag) & (F.coalesce(attribute(e, attr, decode=False) == value, F.lit(False)) if attr else F.lit(True))


def extract_username(container: Column, banned: Sequence[str] = tuple(NOT_USERNAME), variant: str = "new", elements: Column | None = None) -> Column:
    def of(found: Column) -> Column:
        named = first_text(container, found, _is("span", "data-testid", "proName"))
        if variant == "old":
            fallback = first_text(container, found, lambda e: (e["tag"] == "span") & F.coalesce(attribute(e, "class", decode=False).contains("name") | attribute(e, "class", decode=False).contains("Name"), F.lit(False)))
        else:
            plain = lambda t: (F.length(t) > 3) & (F.length(t) < 50) & ~contains_any(t, banned)
            fallback = first_match(texts_of(container, found, _is("span")), plain)
        return F.coalesce(named, fallback, F.lit("Anonymous"))

    return _with_tree(container, elements, of)


def extract_rating(container: Column, word: str = RATING_WORD, variant: str = "new", default: str = "5", elements: Column | None = None) -> Column:
    """Rating as a string digit. Without a usable label it is ``default``, see :func:`rating_defaulted`."""
    return F.coalesce(_rating(container, word, variant, elements), F.lit(default))


def rating_defaulted(container: Column, word: str = RATING_WORD, variant: str = "new", elements: Column | None = None) -> Column:
    """True where the page states no rating, so that the default cannot pass for a real one."""
    return _rating(container, word, variant, elements).isNull()


def _rating(container: Column, word: str, variant: str, elements: Column | None) -> Column:
    def of(found: Column) -> Column:
        icons = F.filter(found, _is("div", "data-testid", "icnStarRating"))
        icon = let(F.get(icons, F.lit(0)), lambda e: F.when(e.isNotNull(), attribute(e, "aria-label", decode=False)))
        if variant == "old":
            return F.nullif(F.get(F.split(icon, " ", -1), F.lit(1)), F.lit(""))
        labels = F.transform(F.filter(found, lambda e: F.lower(e["attrs"]).contains("aria-label")), lambda e: attribute(e, "aria-label", decode=False))
        label = F.get(F.filter(labels, lambda v: F.coalesce(F.lower(v).contains(word), F.lit(False))), F.lit(0))
        return F.nullif(F.regexp_extract(F.coalesce(label, icon), r"(\p{Nd})", 1), F.lit(""))

    return _with_tree(container, elements, of)


def extract_review_text(container: Column, banned: Sequence[str] = tuple(NOT_REVIEW_TEXT), variant: str = "new", elements: Column | None = None) -> Column:
    """Review text, empty string when none is found."""

    def of(found: Column) -> Column:
        item = F.nullif(first_text(container, found, _is("span", "data-testid", "lblItemUlasan")), F.lit(""))
        if variant == "old":
            options = [
                item,
                F.nullif(first_text(container, found, lambda e: (e["tag"] == "span") & e["attrs"].rlike(r"""(?i)\bdata-testid\s*=\s*(""|'')""")), F.lit("")),
                first_match(texts_of(container, found, _is("p")), lambda t: (F.length(t) > 10) & ~t.contains(DATE_MARKERS[0])),
            ]
        else:
            sized = lambda t: (F.length(t) > 20) & (F.length(t) < 2000)
            options = [
                item,
                first_match(texts_of(container, found, _is("span")), lambda t: sized(t) & ~contains_any(t, banned)),
                first_match(texts_of(container, found, _is("p")), lambda t: sized(t) & ~t.contains(DATE_MARKERS[0])),
            ]
        return F.coalesce(*options, F.lit(""))

    return _with_tree(container, elements, of)


def extract_date_text(container: Column, words: Sequence[str] = tuple(DATE_WORDS), variant: str = "new", elements: Column | None = None) -> Column:
    def of(found: Column) -> Column:
        if variant == "old":
            stamped = lambda e: (e["tag"] == "p") & F.coalesce(attribute(e, "class", decode=False).rlike("timestamp|date"), F.lit(False))
            date = F.coalesce(first_text(container, found, stamped), first_match(texts_of(container, found, _is("p")), lambda t: contains_any(t, DATE_MARKERS)))
        else:
            texts = texts_of(container, found, lambda e: e["tag"].isin("p", "span", "div"))
            date = first_match(texts, lambda t: (F.length(t) < 50) & contains_any(t, words))
        return F.coalesce(date, F.lit("Unknown"))

    return _with_tree(container, elements, of)


def validate_review(df: DataFrame, review: str = "Review", min_len: int = 10) -> DataFrame:
    """Drop rows without text or with fewer than ``min_len`` characters."""
    return df.filter(F.length(review) >= max(min_len, 1))


def filter_by_rating(df: DataFrame, ratings: Sequence[int | str] | None = None, rating: str = "Rating") -> DataFrame:
    """Keep the asked ratings; ``None`` or ``["ALL"]`` keeps everything."""
    wanted = None if ratings is None else [str(r) for r in ratings]
    if wanted is None or "ALL" in wanted:
        return df
    return df.filter(F.col(rating).isin(wanted))


def extract_reviews(
    containers: DataFrame, keep: Sequence[str] = ("page_id", "container_no"), variant: str = "new", min_len: int = 10
) -> DataFrame:
    """The review record of each container, without those that hold no review text."""
    box, found = F.col("container"), F.col("_tree")  # the elements are read once
    record = F.struct(
        F.col("url").alias("Source_URL"),
        extract_username(box, variant=variant, elements=found).alias("Username"),
        extract_review_text(box, variant=variant, elements=found).alias("Review"),
        extract_rating(box, variant=variant, elements=found).alias("Rating"),
        rating_defaulted(box, variant=variant, elements=found).alias("rating_defaulted"),
        extract_date_text(box, variant=variant, elements=found).alias("Date"),
    )
    # Unfolding a one-element array keeps the filter behind the extraction: pushed below it, the
    # filter would extract every text a second time.
    rows = containers.withColumn("_tree", tree(box)).select(*keep, F.inline(F.array(record)))
    return validate_review(rows, min_len=min_len if variant == "new" else 1).withColumn(
        "Cleaned_Review", clean_text("Review")
    )


# --- pagination -------------------------------------------------------------------------------
def stop_after_empty_pages(
    rows: DataFrame,
    product: str,
    page_no: str,
    keys: Sequence[str],
    max_empty: int = 2,
    max_pages: int | None = 100,
) -> DataFrame:
    """Rows that a crawl would have kept, whole: first sightings on pages before the first run of
    ``max_empty`` pages without a new review, and within ``max_pages`` (None: no limit). Of several rows
    of one page with the same keys the smallest stays.

    A page without reviews is a row whose keys are all null. The ordered window holds one
    row per page of a product, because the per-page counts are aggregated first.
    """
    inside = rows if max_pages is None else rows.filter(F.col(page_no) <= max_pages)
    real = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
    others = [c for c in rows.columns if c not in (product, page_no, *keys)]
    first = inside.filter(real).groupBy(product, *keys).agg(F.min(F.struct(page_no, *others)).alias("_row"))
    first = first.select(product, *keys, "_row.*")
    fresh = first.groupBy(product, page_no).agg(F.count(F.lit(1)).alias("_new"))
    pages = inside.select(product, page_no).distinct().join(fresh, [product, page_no], "left")
    order = W.partitionBy(product).orderBy(page_no)
    recent = order.rowsBetween(-(max_empty - 1), 0)
    pages = (
        pages.withColumn("_new", F.coalesce("_new", F.lit(0)))
        .withColumn("_seen", F.count(F.lit(1)).over(recent))
        .withColumn("_got", F.sum("_new").over(recent))
    )
    stop = F.when((F.col("_seen") == max_empty) & (F.col("_got") == 0), F.col(page_no))
    stops = pages.withColumn("_stop", F.min(stop).over(order.rowsBetween(W.unboundedPreceding, 0)))
    open_pages = stops.filter(F.col("_stop").isNull()).select(product, page_no)
    return first.join(open_pages, [product, page_no], "left_semi").select(*rows.columns)
