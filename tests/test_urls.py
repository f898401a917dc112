"""References resolved by the public rules."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from reviewloom.functions.urls import resolve_url
from reviewloom.operators import extract as X

BASE = "http://a/b/c/d;p?q"
# The examples of RFC 3986, section 5.4.
EXAMPLES = [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"),
    ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"),
    (";x", "http://a/b/c/;x"), ("g;x", "http://a/b/c/g;x"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"),
    ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../", "http://a/"), ("../../g", "http://a/g"),
    ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), (".g", "http://a/b/c/.g"), ("g..", "http://a/b/c/g.."),
    ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("g;x=1/../y", "http://a/b/c/y"), ("g?y/../x", "http://a/b/c/g?y/../x"),
]


def resolved(spark, rows):
    frame = spark.createDataFrame(rows, "i int, base string, ref string")
    return [r[0] for r in frame.orderBy("i").select(resolve_url(F.col("base"), F.col("ref"))).collect()]


def test_published_examples(spark):
    assert resolved(spark, [(i, BASE, r) for i, (r, _) in enumerate(EXAMPLES)]) == [want for _, want in EXAMPLES]


@pytest.mark.parametrize("base", ["https://shop.example.com", "https://shop.example.com/", "https://shop.example.com/a/b?x=1#f"])
def test_against_the_standard_library(spark, base):
    refs = ["x", "/x?y=1", "//other/z", "../x", "../../x/./y", "?q=2", "https://h2/p", "mailto:a@b", "x/y/../z", " spaced "]
    assert resolved(spark, [(i, base, r) for i, r in enumerate(refs)]) == [urljoin(base, r.strip()) for r in refs]


def test_nulls(spark):
    assert resolved(spark, [(0, None, "x"), (1, "http://a/", None)]) == [None, None]


def test_links_are_absolute_and_found_in_any_quotes(spark):
    html = (
        "<a href=p1>1</a><A class='x' HREF='/s/p2?a=1&amp;b=2'>2</A><a data-href='no'>3</a><a title=\"a > b\" href=\"../p3\">4</a><a href=''>5</a>"
        "<script>x = '<a href=no>'</script><!-- <a href=no> --><abbr href=no>"
    )
    pages = spark.createDataFrame([(1, "https://shop.example.com/t/q", html), (2, "https://h/x", "<base href='https://shop.example.com/z/'>" + "<a href=p4>"), (3, None, "<a href=p5><a href=https://h/6>")], "page_id int, url string, html string")
    got = sorted((r.page_id, r.href) for r in X.extract_links(pages).collect())
    shop = "https://shop.example.com"
    assert got == [(1, f"{shop}/p3"), (1, f"{shop}/s/p2?a=1&b=2"), (1, f"{shop}/t/p1"), (1, f"{shop}/t/q"), (2, f"{shop}/z/p4"), (3, "https://h/6")]
    raw = sorted(r.href for r in X.extract_links(pages.filter("page_id = 1"), base=None).collect())
    assert raw == ["", "../p3", "/s/p2?a=1&b=2", "p1"]


def test_relative_product_links_reach_the_url_list(spark):
    pages = spark.createDataFrame([(1, "https://www.shop-example.com/list/all", "<a href='/store/a-long-product-name-1?src=x'><a href=../store/a-long-product-name-1>")], "page_id int, url string, html string")
    links = X.filter_product_urls(X.extract_links(pages), "shop-example.com")
    got = X.distinct_urls(links.select(X.canonicalize_product_url("href").alias("url"))).collect()
    assert [r.url for r in got] == ["https://www.shop-example.com/store/a-long-product-name-1/review"]
