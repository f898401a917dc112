import html as stdlib_html
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import html as H
from reviewloom.operators import extract as X

CARD = (
    '<div data-testid="reviewCard"><div class="top"><span data-testid="proName"> Budi </span>'
    '<div data-testid="icnStarRating" aria-label="bintang 4"></div></div>'
    "<span>Layar &amp; baterai sangat bagus sekali</span><p>3 hari lalu</p></div>"
)


def first(spark, text, fn):
    return spark.createDataFrame([(text,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text", ["a &amp; b", "&lt;p&gt; &eacute;&#233;&#xe9; &#128512;", "&unknown; & &;", "&amp;lt;", "no refs", "&#0; &#xD800;"])
def test_entities(spark, text):
    want = text if "&#0;" in text else stdlib_html.unescape(text)
    assert first(spark, text, H.decode_entities) == want


def test_text_of_fragments(spark):
    assert first(spark, "<p> a <b>b</b>\n c </p>", H.inner_text) == "a b\n c"
    assert first(spark, "<p> a <b>b</b>\n c > d </p>", H.compact_text) == "abc > d"


def pages(spark, *bodies):
    return spark.createDataFrame([(i, f"https://s/p{i}?x=1", b) for i, b in enumerate(bodies)], "page_id int, url string, html string")


def test_cards_with_nested_divs_end_where_they_close(spark):
    body = f"<body><div>{CARD}<div>between</div>{CARD}</div><div>after</div></body>"
    out = X.select_review_containers(pages(spark, body)).collect()
    assert [r.strategy for r in out] == ["card", "card"]
    inner = CARD[len('<div data-testid="reviewCard">') : -len("</div>")]
    assert [r.container for r in out] == [inner, inner]


def test_fallback_order(spark):
    long = "x" * 60
    article = f"<article>{long} WIB</article>"
    leaf = f"<div><span>{long} lalu</span><p>b</p><p>c</p><p>d</p></div>"
    out = {r.page_id: r.strategy for r in X.select_review_containers(pages(spark, CARD + article, article + leaf, f"<article>{long}</article>" + leaf, "<p>none</p>")).collect()}
    assert out == {0: "card", 1: "article", 2: "div"}
    old = {r.page_id: r.strategy for r in X.select_review_containers(pages(spark, CARD, f"<article>{long}</article>", leaf), variant="old").collect()}
    assert old == {0: "card", 1: "article"}


def test_fields(spark):
    row = X.extract_reviews(X.select_review_containers(pages(spark, CARD))).first()
    assert (row.Username, row.Rating, row.rating_defaulted) == ("Budi", "4", False)
    assert row.Review == "Layar & baterai sangat bagus sekali"
    assert row.Cleaned_Review == "layar  baterai sangat bagus sekali" and row.Date == "3 hari lalu"


@pytest.mark.parametrize(
    "fragment,name",
    [("<span>abc</span><span>Budi S</span>", "Budi S"), ("<span>Beli di toko</span>", "Anonymous"), ("", "Anonymous")],
)
def test_username_fallbacks(spark, fragment, name):
    assert first(spark, fragment, X.extract_username) == name


def test_old_variants(spark):
    assert first(spark, '<span class="userName">Siti</span>', lambda c: X.extract_username(c, variant="old")) == "Siti"
    assert first(spark, '<div data-testid="icnStarRating" aria-label="bintang 2"></div>', lambda c: X.extract_rating(c, variant="old")) == "2"
    assert first(spark, "<p>short</p><p>long enough text</p>", lambda c: X.extract_review_text(c, variant="old")) == "long enough text"
    assert first(spark, '<p class="timestamp">kemarin</p>', lambda c: X.extract_date_text(c, variant="old")) == "kemarin"


def test_missing_rating_is_flagged(spark):
    assert first(spark, "<p>x</p>", X.extract_rating) == "5" and first(spark, "<p>x</p>", X.rating_defaulted) is True


def test_short_reviews_go(spark):
    df = spark.createDataFrame([("123456789",), ("1234567890",), (None,), ("",)], "Review string")
    assert X.validate_review(df).count() == 1


def test_length_is_measured_with_the_query(spark):
    urls = ["https://x.example.com/a?" + "q" * 20, "https://x.example.com/a", "https://ta.example.com/" + "b" * 30, "https://x.example.com/search?" + "c" * 20]
    df = spark.createDataFrame([(u,) for u in urls], "href string")
    kept = X.filter_product_urls(df, "example.com")
    assert [r.u for r in kept.select(X.canonicalize_product_url("href").alias("u")).collect()] == ["https://x.example.com/a/review"]


def crawl(rows, max_empty=2, max_pages=100):
    """Plain restatement of the rule for one product."""
    seen, kept, empty = set(), [], 0
    for page in sorted({p for p, _ in rows}):
        if page > max_pages:
            break
        new = sorted({r for p, r in rows if p == page and r is not None} - seen)
        seen |= set(new)
        kept += [(page, r) for r in new]
        empty = 0 if new else empty + 1
        if empty >= max_empty:
            break
    return kept


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "a"), (6, "c")],
        [(1, None), (2, None), (3, "a")],
        [(1, "a"), (99, "b"), (100, "c"), (101, "d")],
        [(1, "a"), (2, None), (3, "a"), (4, "z")],
    ],
)
def test_pagination_rule(spark, rows):
    df = spark.createDataFrame([("p", n, r) for n, r in rows], "product string, page int, review string")
    out = X.stop_after_empty_pages(df, "product", "page", ["review"]).collect()
    assert sorted((r.page, r.review) for r in out) == crawl(rows)


def test_filter_by_rating(spark):
    df = spark.createDataFrame([("1",), ("5",)], "Rating string")
    assert X.filter_by_rating(df, [1]).count() == 1 and X.filter_by_rating(df, ["ALL"]).count() == 2


def test_html_5_references(spark):
    texts = ["it&apos;s", "&lbrack;x&rbrack;", "a&nbsp b", "&#00000065;", "&#x0000041;", "?a=1&copy=2", "&unknown; &", "&amp;lt;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(H.decode_entities(F.col("t"))).collect()]
    assert got == ["it's", "[x]", "a  b", "A", "A", "?a=1&copy=2", "&unknown; &", "&lt;"]


def test_pagination_keeps_whole_rows(spark):
    rows = [("p", 1, "u", "r", 5), ("p", 1, "u", "r", 4), ("p", 2, "u", "r", 3), ("p", 3, "u", "s", 1), ("p", 200, "v", "t", 2)]
    df = spark.createDataFrame(rows, "product string, page_no int, username string, review string, rating int")
    got = X.stop_after_empty_pages(df, "product", "page_no", ["username", "review"], max_pages=None)
    assert got.columns == df.columns
    assert sorted(tuple(r) for r in got.collect()) == [("p", 1, "u", "r", 4), ("p", 3, "u", "s", 1), ("p", 200, "v", "t", 2)]


# --- whole elements ---------------------------------------------------------------------------
class PlainTree(HTMLParser):
    """Elements by the same rule, from the standard library's parser: an end tag closes down to its partner."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open = [], []

    def handle_starttag(self, tag, attrs):
        self.found.append([tag, dict(attrs), self.open[-1] if self.open else -1, ""])
        if tag not in H.VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag, attrs):
        self.found.append([tag, dict(attrs), self.open[-1] if self.open else -1, ""])

    def handle_endtag(self, tag):
        places = [k for k, i in enumerate(self.open) if self.found[i][0] == tag]
        if places:
            del self.open[places[-1] :]

    def handle_data(self, data):
        for i in self.open:
            self.found[i][3] += data


FRAGMENTS = [
    "<div><span>a<span>b</span>c</span></div><p>d<p>e</p>f",
    "<DIV Class=x data-testid='y z'><Br><img src=a>text<br/></div></span>after",
    '<a href="x>y" title=\'q"r\'>k &amp; l</a><b>open <i>both</b> tail',
    "no tags, a < b and c > d", "", "<p>" * 40 + "deep" + "</p>" * 25, "<ul>" + "<li>x" * 300 + "</ul><em>y</em>",
]


@pytest.mark.parametrize("text", FRAGMENTS)
def test_elements_against_the_standard_parser(spark, text):
    plain = PlainTree()
    plain.feed(text)
    plain.close()
    frame = spark.createDataFrame([(text,)], "x string").withColumn("t", H.tree(F.col("x")))
    fields = F.transform("t", lambda e: F.struct(e["tag"].alias("tag"), e["parent"].alias("parent"), H.decode_entities(F.regexp_replace(H.contents(F.col("x"), e), H.TAG, "")).alias("text")))
    got = frame.select(fields.alias("f")).first()["f"]
    assert [(r["tag"], r["parent"], r["text"]) for r in got] == [(t, p, x) for t, _, p, x in plain.found]


def test_given_pages_against_the_standard_parser(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", H.drop_noise(F.col("html")).alias("x")).withColumn("t", H.tree(F.col("x")))
    for r in rows.select("x", F.transform("t", lambda e: F.struct(e["tag"].alias("tag"), e["parent"].alias("parent"))).alias("t")).limit(60).collect():
        plain = PlainTree()
        plain.feed(r["x"])
        plain.close()
        assert [(e["tag"], e["parent"]) for e in r["t"]] == [(t, p) for t, _, p, _ in plain.found]


@pytest.mark.parametrize(
    "tag,want",
    [('<a x="1">', "1"), ("<a x='1 2'>", "1 2"), ("<a x=1>", "1"), ("<A b='x=9' X = \"a > b\">", "a > b"), ("<a data-x=1>", None), ("<a x>", None), ("<a b x=1&amp;2 c>", "1&2"), ('<a b="y"x=3>', "3")],
)
def test_attributes_in_any_quotes(spark, tag, want):
    assert first(spark, tag, lambda c: H.attribute(F.get(H.tree(c), F.lit(0)), "x")) == want


def test_nested_markup_is_whole(spark):
    card = (
        "<section><div class=r data-testid='reviewCard'><p>3 hari lalu</p><span data-testid=proName>Budi <b>S</b></span><div aria-label='2 Bintang'></div>"
        "<div><span data-testid='lblItemUlasan'>Layar <span>sangat <span>bagus</span></span> dan awet</span></div></div>after</section>"
    )
    row = X.extract_reviews(X.select_review_containers(pages(spark, card))).first()
    assert (row.Username, row.Rating, row.Review, row.Date) == ("Budi S", "2", "Layar sangat bagus dan awet", "3 hari lalu")


def test_divs_count_their_children(spark):
    text = "<p>3 hari lalu</p>" + "<p>bagus sekali barangnya</p>" * 2
    three, four = f"<div>{text}</div>", f"<div>{text}<i></i></div>"
    out = {r.page_id: r.container for r in X.select_review_containers(pages(spark, three, four, f"<div><div>{four}</div></div>", f"<div>{text}loose</div>", "<div>" + "<b>lalu abc</b>" * 30 + "</div>")).collect()}
    assert out == {1: f"{text}<i></i>", 2: f"{text}<i></i>", 3: f"{text}loose"}


def test_container_queries_keep_review_divs_of_few_children(spark, tmp_path):
    from reviewloom.workload import queries

    html = "<body><div>" + "the product is good " * 5 + "<b>fine</b></div></body>"
    spark.createDataFrame([(1, "http://x", html), (2, "http://y", "<p>none</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    docs = "doc_id long, source string, lang string, text string, n_chars long"
    spark.createDataFrame([], docs).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("select_review_containers", "extract_username", "extract_rating", "extract_date_text"):
        assert [(r.page_id, r.container_no) for r in queries()[name](spark, str(tmp_path)).collect()] == [(1, 0)], name
