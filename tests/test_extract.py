import pytest

from pagesieve.operators import extract as X
from pagesieve.operators.schema import with_schemas

PAGE = """<!DOCTYPE html><html lang="en-GB"><head><title> A &amp; B
 c</title><meta name="Description" content="he said &quot;x&quot;"><META NAME=viewport CONTENT=wide>
<link rel="shortcut CANONICAL" href="/q?a=1#z"><script>var t="</p><a href='/no'>";</script>
<!-- <a href="/c">c</a> <h1>no</h1> --><link rel=alternate hreflang=de href=/de>
<meta property="og:type" content="a"><meta property="og:TYPE" content="b"></head>
<body><h1>Hi <b>you</b></h1><h3></h3><ul><li>a<li>b</ul><p hidden id=s class="x y z">secret words<p>vis
<a href="/x" rel="nofollow ugc"><img alt="pic" src=i.png srcset="/s1.png 1x, http://t.co/s2.png 2x"></a>
<a href="?p=1" title="t > x">  </a><a name=q>none</a><a href="javascript:go()">J</a>
<svg><text>drawn</text></svg><noscript>off</noscript>
<div itemtype="https://schema.org/ItemList"></div><div itemtype="http://schema.org/Product"><span><a href="/deal">d</a></span></div><a href="/out">o</a>
<script type="application/ld+json"> {"@type":"Product"} </script><script src="/a.js" defer></script></body></html>"""


@pytest.fixture(scope="module")
def facts(spark):
    pages = spark.createDataFrame([(1, "https://ex.com/dir/p", PAGE), (2, "https://ex.com/", ""), (3, "https://ex.com/", None)], "page_id long, url string, html string")
    return {r["page_id"]: r.asDict(True) for r in with_schemas(X.extract_facts(pages)).collect()}, pages


def test_meta(facts):
    f = facts[0][1]
    assert (f["title"], f["description"], f["viewport"], f["lang"]) == ("A & B c", 'he said "x"', "wide", "en-GB")
    assert f["canonical"] == {"count": 1, "href": "https://ex.com/q?a=1#z", "raw": "/q?a=1#z"}
    assert f["hreflang"] == [{"idx": 0, "lang": "de", "ref": "/de"}]
    assert f["open_graph"] == {"og:type": "b"}


def test_comments_and_scripts_are_no_markup(facts):
    f = facts[0][1]
    assert [(h["level"], h["text"]) for h in f["headings"]] == [(1, "Hi you"), (3, "")]
    assert [l["raw_href"] for l in f["links"]] == ["/x", "?p=1", "javascript:go()", "/deal", "/out"]


def test_link_labels(facts):
    assert [l["label"] for l in facts[0][1]["links"]] == ["pic", "t > x", "J", "d", "o"]


def test_visibility(facts):
    t = facts[0][1]["text"]
    assert t["hidden"] == 2 and t["roots"] == [{"element": "p#s.x.y", "reason": "hidden attribute"}]
    assert t["visible"] == 9  # Hi you a b vis none J d o; svg and noscript are not read


def test_microdata_listing_links(facts):
    s = facts[0][1]["signals"]
    assert s["listing_refs"] == ["/deal"] and (s["product_microdata"], s["itemlist_microdata"]) == (1, 1)


def test_empty_pages(facts):
    for key in (2, 3):
        f = facts[0][key]
        assert f["title"] == "" and f["links"] == [] and f["canonical"]["count"] == 0 and f["text"]["all"] == 0


def test_resources(facts, spark):
    rows = {(r["url"], r["kind"], r["source"], r["active"]) for r in X.dom_resources(facts[1]).collect()}
    assert rows == {
        ("https://ex.com/dir/i.png", "image", "dom", False), ("https://ex.com/s1.png", "image", "srcset", False),
        ("http://t.co/s2.png", "image", "srcset", False), ("https://ex.com/a.js", "javascript", "dom", True),
    }


def test_long_input_does_not_overflow(spark):
    html = "<body><p title='" + "x" * 200_000 + "'>" + "word " * 100_000 + "<!--" + "y" * 200_000
    pages = spark.createDataFrame([(1, "https://ex.com/", html)], "page_id long, url string, html string")
    row = X.extract_facts(pages, "text", "dom", "headings").first()
    assert row["text"]["visible"] == 100_000


def test_head_signals_stop_at_head_end(spark):
    html = '<head><link rel=canonical href="/a"><meta name=bingbot content=noindex></head><link rel=canonical href=/b>'
    pages = spark.createDataFrame([(1, "https://ex.com/", html)], "page_id long, url string, html string")
    row = X.head_signals(pages).first()
    assert row["canonical"] == ["https://ex.com/a"] and row["robots"] == []
