"""URLs that need no work take a short way, with the results of the long one."""

import pytest
from pyspark.sql import functions as F

from pagesieve.functions import urls as U

URLS = [
    "https://e.com/", "https://e.com", "http://a-b.e.com/x/y.js?v=1&w=a:b@c#top", "https://e.com/a/../b", "https://e.com/a/.b/c", "https://e.com/a/%2e%2E/b", "https://e.com/.", "https://e.com/a.",
    "https://E.com/A", "HTTPS://e.com/a", "https://e.com:443/a", "http://e.com:8080/a", "https://u:p@e.com/a", "https://u@e.com/a?b", "https://1.2.3.4/a", "http://e.1/a", "http://0x7f.1/a", "https://e.0x1/a",
    "https://localhost/a", "https://e..com/a", "https://-e.com/", "https://e.com./a", "https://e.com/a b", "https://e.com/ü", "https://ü.com/a", "https://e.com/a'b", "https://e.com/?q='x'", "https://e.com/a\\b",
    "https://e.com/a|b^c[d]", "https://e.com/a?x=<y>", "https://e.com/a?b?c/../d", "https://e.com/a#b c", "https://e.com/a#", "https://e.com/a?#b", " https://e.com/a", "https://e.com/a\n", "https://e.com/a\r\nb",
    "https:///e.com/a", "https:/e.com/a", "https://e.com//a//b", "https://e.com?a/b", "https://e_f.com/a", "https://e.com/a@b", "https://e.com/@a/x:1;y=(2)*!$,~", "//e.com/a", "/a", "mailto:a@e.com", "data:x", "", None,
    "https://e.com/" + "a/" * 20000 + "b", "https://" + "a." * 20000 + "com/x",
]


def results(spark):
    u, page = F.col("u"), F.lit("https://e.com/p")
    made = {
        "norm": U.normalize_url(u), "raw": U.normalize_url(u, "raw"), "href": U.href(u), "http": U.http_url(u, browser=True), "seen": U.normalize_url(u, browser=True), "host": U.url_host(u),
        "host_seen": U.url_host(u, browser=True), "origin": U.url_origin(u), "path": U.url_path(u), "third": U.is_third_party(u, page),
    }
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(URLS)], "i int, u string").select("i", *[v.alias(k) for k, v in made.items()])
    return {r["i"]: r.asDict() for r in rows.collect()}


@pytest.fixture
def long_way(monkeypatch):
    """The same builders, no URL being plain; expressions are kept for a session, so they are built anew."""

    def use():
        monkeypatch.setattr(U, "_PLAIN", r"(?!)")
        for name in ("normalize_url", "href", "http_url", "url_host", "url_origin", "url_path", "is_third_party"):
            monkeypatch.setattr(U, name, getattr(U, name).__wrapped__)

    return use


def test_short_and_long_way_agree(spark, long_way):
    short = results(spark)
    long_way()
    assert short == results(spark)


def test_most_urls_take_the_short_way(spark):
    rows = spark.createDataFrame([(x,) for x in URLS[:3]], "u string").select(F.col("u").rlike(U._PLAIN).alias("p")).collect()
    assert [r["p"] for r in rows] == [True, False, True]
