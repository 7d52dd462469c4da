"""URL functions on single values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailbase.functions import urls

CASES = [
    ("HTTPS://Ex.COM/A", "https://b.com/", "https://ex.com/A"),
    ("https://ex.com:443/a", "https://b.com/", "https://ex.com/a"),
    ("http://ex.com:80", "https://b.com/", "http://ex.com/"),
    ("http://ex.com:8080/a", "https://b.com/", "http://ex.com:8080/a"),
    ("https://ex.com/a#section", "https://b.com/", "https://ex.com/a"),
    ("https://ex.com/a?utm_source=x&fbclid=1&k=2", "https://b.com/", "https://ex.com/a?k=2"),
    ("https://ex.com/a?", "https://b.com/", "https://ex.com/a"),
    ("https://ex.com//a///b", "https://b.com/", "https://ex.com/a/b"),
    ("/page?x=1", "https://base.com/blog/", "https://base.com/page?x=1"),
    ("next", "https://base.com/blog/post", "https://base.com/blog/next"),
    ("../up/./x", "https://base.com/a/b/c", "https://base.com/a/up/x"),
    ("../../../x", "https://base.com/a/b", "https://base.com/x"),
    ("..", "https://base.com/a/b/c", "https://base.com/a/"),
    ("?q=1", "https://base.com/a/b?z=2", "https://base.com/a/b?q=1"),
    ("#top", "https://base.com/a?z=2", "https://base.com/a?z=2"),
    ("//other.org/x", "https://base.com/a", "https://other.org/x"),
    ("https://ex.com/?b=2&a=1", "https://b.com/", "https://ex.com/?a=1&b=2"),
    ("https://ex.com/?a=2&a=1", "https://b.com/", "https://ex.com/?a=2&a=1"),
    ("https://ex.com/?q=a+b&r=~*", "https://b.com/", "https://ex.com/?q=a+b&r=~%2A"),
    ("javascript:void(0)", "https://b.com/", "javascript:void(0)"),
    ("/Ciónue", "http://a.com/x", "http://a.com/Ciónue"),
]


def test_canonical_urls(spark):
    rows = spark.createDataFrame(CASES, "href string, base string, want string")
    got = rows.select("href", "want", urls.url_struct(F.col("href"), F.col("base")).alias("u")).collect()
    assert [(r.href, r.u.canonical) for r in got] == [(r.href, r.want) for r in got]
    assert all(len(r.u.url_key) == 16 and r.u.raw == r.href for r in got)


def test_canonical_is_idempotent(spark):
    rows = spark.createDataFrame(CASES, "href string, base string, want string")
    once = rows.select(urls.url_struct(F.col("href"), F.col("base"))["canonical"].alias("c"))
    assert once.filter(urls.canonical_url(F.col("c")) != F.col("c")).count() == 0


def test_tracking_does_not_change_the_key(spark):
    row = spark.range(1).select(*[urls.fingerprint(urls.canonical_url(F.lit(u))).alias(k) for k, u in (("a", "https://e.com/x?k=1"), ("b", "https://e.com/x?UTM_source=z&k=1"))]).first()
    assert row.a == row.b


@pytest.mark.parametrize(("host", "want"), [("www.example.com", "example.com"), ("sub.example.com", "sub.example.com"), ("a.b.example.com", "b.example.com"), ("www.com", "www.com"), ("m.www.example.org", "example.org"), ("localhost", "localhost"), ("", ""), ("blog.m.com", "m.com")])
def test_reg_domain(spark, host, want):
    assert spark.range(1).select(urls.reg_domain(F.lit(host)).alias("d")).first().d == want


def test_path_signal(spark):
    for url, want in (("/about", 0.0), ("https://e.com/docs/api", 1.0), ("/products/widget", 0.5), ("/blog/login", 0.0), ("", 0.5)):
        assert spark.range(1).select(urls.path_signal(F.lit(url)).alias("s")).first().s == want


def test_resolve_equals_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["https://base.com/a/b/c?x=1#f", "http://h.org", "https://h.org/"]
    hrefs = ["x", "./x", "../x", "../../x", "/x/../y", "?q", "", "x?y#z", "//o.net/p", "https://z.com/q", "a/b/../../c", "g;x=1/../y"]
    rows = spark.createDataFrame([(h, b) for h in hrefs for b in bases], "href string, base string")
    for r in rows.select("href", "base", urls.resolve(F.col("href"), F.col("base")).alias("u")).collect():
        assert r.u.rstrip("/") == urljoin(r.base, r.href).rstrip("/"), (r.href, r.base)


@given(st.lists(st.tuples(st.sampled_from("abc"), st.text(alphabet="xyz é*~", max_size=4)), max_size=5))
@settings(max_examples=15, deadline=None)
def test_query_cleaning_equals_form_encoding(spark, pairs):
    from urllib.parse import parse_qsl, urlencode

    query = urlencode(pairs)
    want = urlencode(sorted(parse_qsl(query, keep_blank_values=True), key=lambda p: p[0]))
    assert spark.range(1).select(urls.clean_query(F.lit(query)).alias("q")).first().q == want
