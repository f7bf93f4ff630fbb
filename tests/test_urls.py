"""URL functions against the standard library's splitting and joining."""

from __future__ import annotations

from urllib.parse import unquote, urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from spindrift.functions import urls as U

URLS = [
    "https://example.com/a/b?x=1&y=2#frag", "http://user:pw@Example.COM:8080/A/B.html;v=1?q=%20#", "//cdn.example.net/x", "javascript:alert(1)", "mailto:a@b.c", "https://example.com",
    "https://example.com/path with spaces/a|b", "https://example.com/%XX/%zz", "ftp://files.example.com/v1.2/page", "https://[::1]:443/x", "/just/a/path?x", "", "   https://example.com/lead",
    "https://example.com/a//b///c/", "https://example.com/?a=1&a=2&b=&c", "https://münchen.example/straße", "data:text/plain,hello", "https://example.com/a\tb\nc",
]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, url string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("url"))).collect()]


@pytest.mark.parametrize("part", ["scheme", "netloc", "path", "query", "fragment"])
def test_parts_equal_library(spark, part):
    got = column(spark, URLS, getattr(U, part))
    want = [getattr(urlparse(u.lstrip(" ")), part) for u in URLS]
    assert got == want


def test_bad_ports_have_no_parts(spark):
    urls = ["https://example.com:99999/x", "https://example.com:abc/x", "https://[::1/x"]
    assert column(spark, urls, U.scheme) == [""] * 3
    assert column(spark, urls, U.path) == [""] * 3


def test_depth_extension_params(spark):
    assert column(spark, ["https://e.com/a/b/", "https://e.com", "a/b/c", None], U.path_depth) == [2, 0, 3, 0]
    assert column(spark, ["/v1.2/page", "/a/b.PDF", "/a", "/x.abcdefghijkl"], U.extension_of_path) == [None, "pdf", None, None]
    assert column(spark, ["/v1.2/page", "/v1.2/page.txt"], U.extension_of_file) == [None, "txt"]
    assert column(spark, ["https://e.com/?a=1&&b", "https://e.com/?", "https://e.com/"], U.query_param_count) == [3, 0, 0]


def test_decoding_keeps_plus_and_bad_escapes(spark):
    texts = ["a%20b", "a+b", "50%", "%zz%41", "", "é%C3%A9"]
    assert column(spark, texts, U.decoded) == [unquote(t) for t in texts]


def test_normalizing(spark):
    urls = ["https://E.com/a/?b=2&a=1&utm_source=x#f", "https://e.com", "https://e.com/a///"]
    assert column(spark, urls, U.normalized_url) == ["https://E.com/a?a=1&b=2", "https://e.com/", "https://e.com/a"]
    assert column(spark, ["HTTPS://E.com/A/#x", "//e.com//", "https://e.com/"], U.canonical_url) == ["https://e.com/A", "https://e.com", "https://e.com/"]


def test_resolving(spark):
    from spindrift.operators import graph

    source = "https://e.com/a/b?x"
    links = ["", "#top", "//x.com/y", "/root", "https://o.com/", "../up", "same", "?q=1", "/a/../b", "mailto:a@b.c", "httpfoo"]
    df = spark.createDataFrame([(source, x) for x in links], "src string, link string")
    got = {r["link"]: r["dst"] for r in graph.resolved(df).collect()}
    plain = {"": None, "#top": None, "//x.com/y": "https://x.com/y", "/root": "https://e.com/root", "https://o.com/": "https://o.com/", "httpfoo": "httpfoo"}
    assert got == {x: plain[x] if x in plain else urljoin(source, x) for x in links}


def test_fragment_classes(spark):
    assert column(spark, ["top", "/route", "!x", "1a", "é"], U.fragment_class) == ["anchor", "route", "route", "other", "other"]


def test_canonical_urls_are_themselves(spark):
    """Plain URLs skip the search for parts, with the result of that search."""
    rows = ["https://a.com", "https://a.com/", "https://a.com/b", "https://a.com/b/", "https://a.com//", "https://a.com/b\n", "https://a.com/b\n\n", "https://a.com\n", " https://a.com/b", "https://a.com/b ", "https://a.com/b;p", "https://a.com/b?q", "https://a.com/b?", "https://a.com/b#",
            "HTTPS://a.com/b", "https://A.com/b", "https://a.com:80/b", "https://u@a.com/b", "https://[::1]/b", "https://[a/b", "a+b.c-d://x-y.z/B%20C", "//a.com/b", "a.com/b", "https:///b", "", None, "https://a.com/é", "https://a.com/b\u0085", "https://é.com/b", "https://a.com/b/c"]
    df = spark.createDataFrame([(r,) for r in rows], "url string")
    got = df.select(*[f(F.col("url"), remove_fragment=a, remove_query=b).alias(f"{f.__name__}{a}{b}") for f in (U.canonical_url, U._canonical_url) for a in (True, False) for b in (True, False)]).collect()
    assert all(r[i] == r[i + 4] for r in got for i in range(4))
    searched = df.where(F.col("url").rlike(U.CANONICAL)).select("url").collect()
    assert [r["url"] for r in searched] == ["https://a.com", "https://a.com/b", "a+b.c-d://x-y.z/B%20C", "https://a.com/é", "https://a.com/b\u0085", "https://a.com/b/c"]


def test_parts_found_once(spark):
    """parsed() has what each function finds, and simple URLs don't go through them."""
    from spindrift.operators import graph

    rows = ["https://a.com", "https://a.com/", "https://a.com/b/c.html", "https://a.com//b//", "https://a.com\n", "https://a.com/b\n", " https://a.com/b", "https://a.com/b c", "https://a.com/b;p", "https://a.com/b?q=1&r", "https://a.com/b#f%20g", "HTTPS://a.com/b",
            "https://A.com/b", "https://a.com:80/b", "https://u:p@a.com/b", "https://[::1]:8080/b", "https://[a/b", "a+b.c-d://x-y.z/B%20C", "//a.com/b", "a.com/b", "https:///b", "mailto:a@b.c", "", None, "https://a.com/é", "https://é.com/b", "https://a.com/b\u0085"]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, url string")
    own = df.select("n", *[f(F.col("url")).alias(name) for name, f in U.PARTS.items()]).orderBy("n").collect()
    once = U.parsed(df)
    assert once.select("n", *[U.part(once, name).alias(name) for name in U.PARTS]).orderBy("n").collect() == own
    assert df.where(F.col("url").rlike(U.SIMPLE)).count() == 7
    for a, b in zip(df.select(F.regexp_replace(U.path(F.col("url")), r"^/+|/+$", "").alias("p")).collect(), df.select(graph.simplified(F.col("url")).alias("p")).collect(), strict=True):
        assert b["p"] == ("/".join(a["p"].split("/")[-2:]) or "root")
