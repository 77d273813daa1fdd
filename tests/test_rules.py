import pytest
from pyspark.sql import functions as F

from pagesieve.operators import content as C
from pagesieve.operators import hreflangs as H
from pagesieve.operators import images as IM
from pagesieve.operators import indexability as N
from pagesieve.operators import issues as I
from pagesieve.operators import regression as R
from pagesieve.operators import robots as RB
from pagesieve.operators import schema as S
from pagesieve.operators import security as SEC
from pagesieve.operators import timing as T
from pagesieve.operators.extract import extract_facts, link_kind

lit = F.lit


def evaluate(spark, html, url="https://ex.com/a", **extra):
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    df = S.with_schemas(extract_facts(pages, *I.FACTS_NEEDED))
    for name, column in extra.items():
        df = df.withColumn(name, column)
    return I.with_score(I.evaluate(df))


GOOD = (
    '<html lang=en><head><title>A good title for a page</title><meta name=description content="' + "d" * 80 + '">'
    '<meta name=viewport content=x><link rel=canonical href="https://ex.com/a"></head><body><h1>One</h1><h2>Two</h2></body>'
)


def test_healthy_page_has_no_issues(spark):
    row = evaluate(spark, GOOD).first()
    assert row["issues"] == [] and row["score"] == 100 and row["band"] == "good"


def test_error_status_and_header_directives(spark):
    row = evaluate(spark, GOOD, status=lit(503), x_robots=F.array(lit("NOINDEX, nofollow"))).first()
    assert [i["id"] for i in row["issues"]] == ["robots.header.noindex", "robots.nofollow", "http.error"]
    assert row["score"] == 55 and row["issues"][-1]["title"] == "HTTP 503"


def test_score_never_negative(spark):
    html = "<title></title><link rel=canonical href=/x><link rel=canonical href=/y><meta name=robots content=noindex>" + '<script type="application/ld+json">{</script>'
    row = evaluate(spark, html, status=lit(500)).first()
    assert row["score"] == 0 and row["critical"] == 5


def test_oversized_images_need_a_render_log(spark):
    render = F.array(F.struct(lit(0).alias("idx"), lit(900).alias("natural_width"), lit(100).alias("rendered_width")))
    ids = [i["id"] for i in evaluate(spark, GOOD, render=render).first()["issues"]]
    assert ids == ["images.oversized"]


@pytest.mark.parametrize(
    "href, kind",
    [("JavaScript:x", "javascript"), ("mailto:a", "mailto"), ("tel:1", "tel"), ("#a", "fragment"), ("../x", "http"), ("foo", "other"), (" ", "empty")],
)
def test_link_kind(value, href, kind):
    assert value(link_kind(lit(href))) == kind


def hops(*pairs):
    return F.array(*[F.struct(lit(a).alias("from"), lit(b).alias("to"), lit(301).alias("status")) for a, b in pairs])


def test_redirect_diagnostics(value):
    a, b, c = "https://e.com/a", "https://e.com/b", "https://e.com/c"
    assert value(N.redirect_diagnostics(hops((a, b), (b, c)))).asDict() == {"hops": 2, "loop": False, "excessive": False}
    assert value(N.redirect_diagnostics(hops((a, b), (b, a))))["loop"] is True
    assert value(N.redirect_diagnostics(hops(*[(a + str(i), a + str(i + 1)) for i in range(6)])))["excessive"] is True


def test_canonical_diagnostics(value):
    d = value(N.canonical_diagnostics(lit("https://e.com/a/?x=1"), lit("http://e.com/a")))
    assert d.asDict() == {
        "cross_domain": False, "protocol_mismatch": True, "hostname_mismatch": False, "trailing_slash_mismatch": True, "query_mismatch": True,
    }


@pytest.mark.parametrize(
    "tag, ok", [("en", True), ("en-gb", True), ("zh-hant-TW", True), ("es-419", True), ("X-DEFAULT", True), ("english_1", False), ("e", False), ("", False), ("de-1996", True)]
)
def test_hreflang_tags(value, tag, ok):
    assert value(H.valid_tag(lit(tag))) is ok


def test_hreflang_normalise(value):
    assert value(H.normalize_tag(lit("ZH-hans-cn"))) == "zh-Hans-CN"
    assert value(H.has_noindex(F.array(lit("max-snippet:5; noindex")))) is True


def test_text_width(value):
    assert value(C.text_width_px(lit("W1 a"), 100)) == 90 + 28 + 32 + 54
    assert value(C.text_width_px(lit(""), 20)) == 0


def test_languages(value):
    assert value(C.first_header_language(F.array(lit("en_US;q=1, de")))) == "en-us"
    assert value(C.valid_language(lit("english!"))) is False


def test_csp_and_hsts(value):
    csp = lit("default-src 'self'; script-src a.com; SCRIPT-SRC * 'unsafe-eval'; frame-ancestors 'none'")
    assert value(SEC.csp_risks(csp)) == ["'unsafe-eval'", "*"]
    assert value(SEC.has_frame_ancestors(csp)) is True
    assert value(SEC.csp_risks(lit(""))) == []
    assert value(SEC.parse_hsts(lit("max-age=0; Preload; includeSubDomains"))).asDict() == {"max_age": 0, "include_subdomains": True, "preload": True}


@pytest.mark.parametrize(
    "rule, path, hit",
    [("/a", "/ab", True), ("/a$", "/ab", False), ("/*.php$", "/x/y.php", True), ("/*.php$", "/x.php?q", False), ("/a+b", "/a+b", True), ("/a.b", "/axb", False)],
)
def test_robots_rule_regex(value, rule, path, hit):
    assert value(F.regexp_like(lit(path), RB.rule_regex(lit(rule)))) is hit


def test_robots_longest_match_and_ties(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a\nDisallow: /a/b/c\nAllow: /a/*/c/d\n"
    docs = spark.createDataFrame([("e.com", "https://e.com/robots.txt", 200, text)], "host string, robots_url string, status int, text string")
    pages = spark.createDataFrame([(1, "https://e.com/a"), (2, "https://e.com/a/b/c"), (3, "https://e.com/a/b/c/d"), (4, "https://other.com/a")], "page_id long, url string")
    got = {r["page_id"]: (r["allowed"], r["rule_line"]) for r in RB.robots_eval(pages, docs).collect()}
    assert got == {1: (True, 3), 2: (False, 4), 3: (True, 5), 4: (True, None)}


def test_robots_groups_continue_until_a_rule(spark):
    text = "User-agent: a\nUser-agent: b\nCrawl-delay: 3\nUser-agent: c\nDisallow: /x\nUser-agent: d\nDisallow: /y"
    docs = spark.createDataFrame([("e.com", text)], "host string, text string")
    agents = {(r["agent"], r["group_id"]) for r in RB.robots_agents(docs).collect()}
    assert agents == {("a", 1), ("b", 1), ("c", 1), ("d", 2)}


def test_resource_kinds(value):
    assert value(T.resource_kind(lit("other"), lit("https://e.com/a.WOFF2?x=1"))) == "font"
    assert value(T.resource_kind(lit("xmlhttprequest"), lit("https://e.com/a"))) == "fetch"
    assert value(T.classify_host(lit("www.google-analytics.com")))["category"] == "analytics"
    assert value(T.classify_host(lit("notgoogle-analytics.com")))["category"] == "other"
    assert value(T.classify_host(lit("cdn.shop.com"))).asDict() == {"category": "cdn", "confidence": "hostname-heuristic"}


def test_image_helpers(value):
    assert value(IM.image_format(lit("image/JPEG; q=1"), lit("https://e.com/a.png"))) == "JPEG"
    assert value(IM.image_format(lit(None).cast("string"), lit("https://e.com/a.svgz"))) == "SVG"
    assert value(IM.bytes_label(lit(2048))) == "2.0 KB" and value(IM.bytes_label(lit(204800))) == "200 KB" and value(IM.bytes_label(lit(0))) == "—"
    assert value(IM.size_from_range(lit(206), lit("bytes 0-0/345"), lit("1"))).asDict() == {"size_bytes": 345, "size_source": "content-range"}
    assert value(IM.should_range_fallback(lit(405), lit(9), lit(""))) is True
    assert value(IM.should_range_fallback(lit(404), lit(0), lit(""))) is False


def test_regression_noise_thresholds(value):
    d = lambda a, b, n: value(R.performance_direction(lit(float(a)), lit(float(b)), n))
    assert d(100, 109, 10) is None and d(100, 115, 10) is None and d(100, 130, 10) == "regression" and d(100, 50, 10) == "improvement"
    assert d(0, 50, 10) is None
    assert value(R.count_direction(lit(1), lit(2))) == "regression" and value(R.count_direction(lit(1), lit(1))) == "changed"


def test_availability(value):
    assert value(S.normalize_availability(lit("https://schema.org/OutOfStock"))) == "outofstock"
    assert value(S.normalize_availability(lit("In Stock"))) == "instock"


def test_schema_nodes_and_summary(spark):
    raw = ['{"@context":{"@type":"Skip"},"@graph":[{"@type":["Thing","Product"],"name":" A  b ","offers":[],"brand":["X"]},{"@type":"Offer","price":10.0}]}', "{bad", "[1, NaN]"]
    df = S.with_schemas(spark.createDataFrame([(1, raw)], "page_id long, jsonld array<string>"))
    row = df.select("schemas", S.product_summary(F.col("schemas")).alias("p")).first()
    assert [s["valid"] for s in row["schemas"]] == [True, False, False]
    assert row["schemas"][0]["types"] == ["Offer", "Product", "Thing"]
    assert row["p"].asDict() == {"name": "A b", "has_offers": True, "sku": "", "brand": "X"}
    offer = S.product_offers(S.with_product_nodes(df)).first()
    assert offer["offer_count"] == 1 and offer["price"] == "10"
