"""Page source for rules the raw corpus lacks.

Each page of the ``pages`` table gets head and body fragments that follow from its
``page_id`` alone, so the SQL side can state the expected answer without reading HTML.
``SEED_SQL`` is that statement: one CTE row per page with the seeded values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import per_session
from .registry import keys, table

def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _if(cond: Column, *parts) -> Column:
    return F.coalesce(F.when(cond, _cat(*parts)), F.lit(""))


def _mod(n: int) -> Column:
    return (F.col("page_id") % n).cast("int")


def _lang(x: Column) -> Column:
    return F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (x % 3 + 1).cast("int"))


def with_neighbours(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Add u (URL without fragment), origin, path and the URLs of related pages."""
    P = F.col("page_id")
    urls = known.select("page_id", F.regexp_replace("url", "#.*$", "").alias("u"))
    out = pages.withColumns(
        {
            "u": F.regexp_replace("url", "#.*$", ""),
            "origin": F.regexp_extract("url", r"^(https?://[^/]+)", 1),
            "path": F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1),
        }
    )
    for name, key in (("nxt", P + 1), ("prv", P - 1), ("t1", 2 * P + 1), ("t2", 2 * P + 2)):
        side = urls.select(F.col("page_id").alias("k"), F.col("u").alias(name))
        out = out.withColumn("k_", key).join(side, F.col("k_") == F.col("k"), "left").drop("k", "k_")
    return out


def _jsonld() -> Column:
    P = F.col("page_id")
    d = _mod(10)
    product = _cat(
        '{"@type":"Product"',
        _if(d != 1, ',"name":"Item ', P.cast("string"), '"'),
        _if(d != 3, ',"image":["/img/', P.cast("string"), '.png"]'),
        _if(d != 5, ',"sku":"S', P.cast("string"), '"'),
        _if(d != 7, ',"gtin13":"', F.lpad(P.cast("string"), 13, "0"), '"'),
        _if(d != 9, ',"brand":{"@type":"Brand","name":"Brand ', _mod(6).cast("string"), '"}'),
        _if(
            _mod(12) == 5,
            ',"offers":{"@type":"Offer","price":"', P.cast("string"),
            '.50","priceCurrency":"EUR","availability":"https://schema.org/InStock"}',
        ),
        _if(
            _mod(12) == 9,
            ',"offers":{"@type":"AggregateOffer","lowPrice":', P.cast("string"), ',"highPrice":', (P + 5).cast("string"),
            ',"availability":"http://schema.org/OutOfStock"}',
        ),
        _if(_mod(24) == 5, ',"aggregateRating":{"@type":"AggregateRating","ratingValue":4.5,"reviewCount":', P.cast("string"), "}"),
        "}",
    )
    graph = F.when(
        _mod(8) == 1,
        _cat('{"@context":"https://schema.org","@graph":[', product, ',{"@type":"BreadcrumbList","itemListElement":[]}]}'),
    ).otherwise(product)
    item = lambda i: F.when(
        _mod(8) == 2, _cat('{"@type":"ListItem","item":{"@id":"', F.col("origin"), "/item/", P.cast("string"), f'-{i}"}}}}')
    ).otherwise(_cat('{"@type":"ListItem","url":"', F.col("origin"), "/item/", P.cast("string"), f'-{i}"}}'))
    listing = _cat('{"@type":"ItemList","itemListElement":[', item(1), ",", item(2), ",", item(3), "]}")
    body = (
        F.when(_mod(4) == 1, graph)
        .when(_mod(4) == 2, listing)
        .when(_mod(16) == 3, F.lit('{"@type":"Product",}'))
        .when(_mod(16) == 7, F.lit('{"@type":["CollectionPage","WebPage"],"name":"c"}'))
        .when(_mod(16) == 11, F.lit('{"@type":"Article","author":{"@type":"Person","name":"x"}}'))
        .when(_mod(16) == 15, F.lit('{"@type":"SearchResultsPage"}'))
    )
    return _if(body.isNotNull(), '<script type="application/ld+json">', body, "</script>")


@per_session
def _head() -> Column:
    P = F.col("page_id")
    u, nxt, prv, origin = F.col("u"), F.col("nxt"), F.col("prv"), F.col("origin")
    k = _mod(8).cast("string")
    alt = lambda lang, href: ['<link rel="alternate" hreflang="', lang, '" href="', href, '">']
    partner = F.when(_mod(2) == 0, nxt).otherwise(prv)
    partner_id = F.when(_mod(2) == 0, P + 1).otherwise(P - 1)
    canon = lambda href: ['<link rel="canonical" href="', href, '">']
    return _cat(
        _if(_mod(6) != 0, '<meta name="description" content="', F.trim(F.repeat(F.lit("word "), _mod(40))), '">'),
        _if(_mod(2) == 0, '<meta name="viewport" content="width=device-width">'),
        _if(_mod(5).isin(1, 3), *canon(u)),
        _if(_mod(5) == 2, *canon(nxt)),
        _if(_mod(5) == 3, *canon(_cat(origin, "/other"))),
        _if(_mod(5) == 4, *canon(F.col("path"))),
        _if(_mod(7) == 0, '<meta name="robots" content="noindex">'),
        _if(_mod(7) == 1, '<meta name="robots" content="index, nofollow">'),
        _if(_mod(7) == 2, '<meta name="robots" content="Index NOINDEX">'),
        _if(_mod(7) == 3, '<meta name="googlebot" content="noarchive">'),
        _if(_mod(8) != 6, *alt(_lang(P), u)),
        _if(_mod(4) != 3, *alt(_lang(partner_id), partner)),
        _if(_mod(9) == 0, *alt("english_1", u)),
        _if(_mod(10) == 0, *alt("x-default", u)),
        _if(_mod(20) == 0, *alt("X-Default", _cat(origin, "/"))),
        _if(_mod(15) == 1, *alt(_lang(P), u)),
        _jsonld(),
        _if(_mod(11) == 0, '<meta property="og:type" content="website"><meta property="og:type" content="product">'),
        _if(_mod(11) == 1, '<meta property="og:type" content="article">'),
        _if(_mod(11) == 2, '<meta name="twitter:card" content="summary">'),
        _if(_mod(11) == 3, '<link rel="next" href="', nxt, '">'),
        _if(_mod(11) == 4, '<link rel="prev" href="', prv, '">'),
        _cat('<script src="https://cdn', k, '.example.net/app.js" async></script>'),
        _if(_mod(3) == 0, '<script src="https://cdn', k, '.example.net/app.js"></script>'),
        _if(_mod(4) == 0, '<script src="http://www.google-analytics.com/ga.js" defer></script>'),
        _if(_mod(5) == 0, '<script type="module" src="/js/m', _mod(7).cast("string"), '.js"></script>'),
        _cat('<link rel="stylesheet" href="/css/site', k, '.css">'),
        _if(_mod(6) == 1, '<link rel="stylesheet" href="/css/site', k, '.css">'),
        _if(_mod(7) == 5, '<link rel="stylesheet" media="print" href="/css/print.css">'),
        _if(_mod(3) == 1, '<link rel="preload" href="/fonts/f', k, '.woff2" as="font" type="font/woff2" crossorigin>'),
        _if(_mod(3) == 2, '<link rel="preconnect" href="https://cdn', k, '.example.net">'),
    )


@per_session
def _body() -> Column:
    P = F.col("page_id")
    pid = P.cast("string")
    image = lambda i: _if(
        _mod(3) > i,
        '<img src="/img/', pid, f'-{i}.png"',
        _if((_mod(2) == 0) | F.lit(i > 0), ' alt="a"'),
        _if(_mod(5) == 0, ' width="100" height="50"'),
        _if(_mod(4) == 2, ' loading="lazy"'),
        _if(_mod(6) == 2, ' srcset="/img/', pid, f'-{i}.png 1x, http://img.example.net/', pid, '.png 2x"'),
        ">",
    )
    return _cat(
        image(0),
        image(1),
        _if(F.col("t1").isNotNull(), '<a href="', F.col("t1"), '">Read more</a>'),
        _if(F.col("t2").isNotNull(), '<a href="', F.col("t2"), '" rel="nofollow sponsored">child ', _mod(5).cast("string"), "</a>"),
        _if(_mod(8) == 1, '<a href="javascript:void(0)">js</a>'),
        _if(_mod(8) == 2, '<a href="mailto:a@b.c">mail</a>'),
        _if(_mod(9) == 2, '<a href="', F.col("origin"), "/empty-", _mod(4).cast("string"), '"></a>'),
        _if(_mod(9) == 3, '<a href="/about" aria-label="About us" rel="ugc"></a>'),
        _if(_mod(4) == 2, *[f'<a href="/list?color=c{i}&amp;page={i}">c{i}</a>' for i in range(1, 13)]),
        _if(_mod(3) == 0, "<h2>Sub</h2>"),
        _if(_mod(3) == 1, "<h4>Deep</h4>"),
        _if(_mod(13) == 0, "<h1>Second</h1>"),
        _if(_mod(17) == 0, "<h3></h3>"),
        _if(_mod(5) == 1, "<div hidden>one two three</div>"),
        _if(_mod(5) == 2, '<div style="display:none" id="x', pid, '" class="a b c">four five</div>'),
        _if(_mod(5) == 3, '<span aria-hidden="true">six</span>'),
        _if(_mod(5) == 4, '<div style="visibility: hidden">s <p hidden>t u</p></div>'),
        _if(_mod(12) == 0, '<form role="search"><input type="search"></form>'),
        _if(
            _mod(11) == 5,
            '<div itemscope itemtype="https://schema.org/Product"><a href="/p/', pid, '">item</a></div>',
        ),
        _if(
            _mod(11) == 6,
            '<ul itemscope itemtype="https://schema.org/ItemList"><li itemprop="itemListElement"><a href="/i/1">one</a></li>'
            '<li itemprop="itemListElement"><a href="/i/2">two</a></li></ul>',
        ),
        _if(_mod(10) == 5, '<iframe src="http://ads.example.org/f.html"></iframe>'),
    )


def seeded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with the seeded fragments after ``<head>`` and before ``<footer>``."""
    rows = with_neighbours(table(spark, sf_dir, "pages"), keys(spark, sf_dir)).withColumns({"head_": _head(), "body_": _body()})
    html = F.replace(F.col("html"), F.lit("<head>"), F.concat(F.lit("<head>"), F.col("head_")))
    html = F.replace(html, F.lit("<footer>"), F.concat(F.col("body_"), F.lit("<footer>")))
    return rows.select("page_id", "url", html.alias("html"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch results per page that follow from ``page_id``: status, redirects and headers."""
    pages = keys(spark, sf_dir)
    return with_neighbours(pages, pages).select(*_fetch_columns())


@per_session
def _fetch_columns() -> list[Column]:
    P = F.col("page_id")
    h = lambda name, cond, *values: F.when(cond, F.struct(F.lit(name).alias("k"), F.array(*[F.lit(v) for v in values]).alias("v")))
    yes = F.lit(True)
    headers = F.map_from_entries(
        F.filter(
            F.array(
                h("Content-Type", yes, "text/html; charset=utf-8"),
                h("X-Robots-Tag", _mod(19) == 0, "noindex"),
                h("X-Robots-Tag", (_mod(19) == 1), "nofollow, noarchive"),
                h("Content-Language", _mod(4) == 0, "de, en"),
                h("Content-Language", _mod(4) == 1, "en-US;q=1"),
                h("Content-Security-Policy", _mod(6) == 0, "default-src 'self'; script-src * 'unsafe-eval'"),
                h("Content-Security-Policy", _mod(6) == 1, "default-src 'self'; frame-ancestors 'none'"),
                h("Content-Security-Policy-Report-Only", _mod(6) == 2, "default-src 'self'"),
                h("Strict-Transport-Security", _mod(5) == 0, "max-age=31536000; includeSubDomains"),
                h("Strict-Transport-Security", _mod(5) == 1, "max-age=0"),
                h("X-Frame-Options", _mod(7) == 0, "DENY"),
                h("X-Frame-Options", _mod(7) == 1, "ALLOWALL"),
                h("Referrer-Policy", _mod(3) == 0, "strict-origin"),
                h("Referrer-Policy", _mod(3) == 1, "no-referrer, unsafe-url"),
                h("Permissions-Policy", _mod(2) == 0, "geolocation=()"),
                h("X-Content-Type-Options", _mod(4) == 0, "nosniff"),
                h("X-Content-Type-Options", _mod(4) == 1, "none"),
            ),
            lambda x: x.isNotNull(),
        )
    )
    hop = lambda a, b: F.struct(a.alias("from"), b.alias("to"), F.lit(301).alias("status"))
    old = F.concat(F.col("origin"), F.lit("/old"))
    mid = F.concat(F.col("origin"), F.lit("/mid"))
    chain = (
        F.when(_mod(17) == 0, F.array(hop(old, F.col("u"))))
        .when(_mod(17) == 1, F.array(hop(old, mid), hop(mid, F.col("u"))))
        .when(_mod(34) == 2, F.array(hop(F.col("u"), mid), hop(mid, F.col("u"))))
        .when(_mod(34) == 19, F.array(*[hop(old, mid), hop(mid, old)] * 3))
        .otherwise(F.array().cast("array<struct<from:string,to:string,status:int>>"))
    )
    error = F.when(_mod(29) == 7, F.lit("timeout")).otherwise(F.lit(""))
    status = (
        F.when(error != "", F.lit(0)).when(_mod(13) == 5, F.lit(404)).when(_mod(26) == 7, F.lit(503)).otherwise(F.lit(200))
    )
    return [
        "page_id",
        F.col("u").alias("url"),
        F.when(F.size(chain) > 0, chain[0]["from"]).otherwise(F.col("u")).alias("initial_url"),
        status.cast("int").alias("status"),
        (F.size(chain) > 0).alias("redirected"),
        F.col("u").alias("final_url"),
        error.alias("error"),
        headers.alias("headers"),
        chain.alias("redirect_chain"),
        F.timestamp_seconds(F.lit(1704067200) + P).alias("captured_at"),
    ]


# SQL counterpart: what the fragments say, as columns per page.
BASE_SQL = """
b AS (
  SELECT page_id AS p, url, regexp_replace(url, '#.*$', '') AS u,
         regexp_extract(url, '^(https?)', 1) AS scheme,
         regexp_extract(url, '^https?://([^/]+)', 1) AS host,
         regexp_extract(url, '^(https?://[^/]+)', 1) AS origin,
         regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path,
         regexp_extract(url, '(\\?[^#]*)', 1) AS query,
         replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&'), '  ', ' ') AS title,
         regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
         html
  FROM pages
)"""

SEED_SQL = (
    BASE_SQL
    + """,
s AS (
  SELECT b.*, n.u AS nxt, r.u AS prv, c1.u AS t1, c2.u AS t2,
    CASE WHEN b.p % 6 = 0 THEN '' ELSE trim(repeat('word ', (b.p % 40)::INT)) END AS description,
    CASE WHEN b.p % 2 = 0 THEN 'width=device-width' ELSE '' END AS viewport,
    CASE WHEN b.p % 5 = 0 OR (b.p % 5 = 2 AND n.u IS NULL) THEN 0 WHEN b.p % 5 = 3 THEN 2 ELSE 1 END AS canon_count,
    CASE WHEN b.p % 5 IN (1, 3) THEN b.u WHEN b.p % 5 = 2 THEN coalesce(n.u, '') WHEN b.p % 5 = 4 THEN b.origin || b.path ELSE '' END AS canon_href,
    CASE b.p % 7 WHEN 0 THEN 'noindex' WHEN 1 THEN 'index, nofollow' WHEN 2 THEN 'Index NOINDEX' WHEN 3 THEN 'noarchive' ELSE '' END AS robots,
    CASE WHEN b.p % 29 = 7 THEN 0 WHEN b.p % 13 = 5 THEN 404 WHEN b.p % 26 = 7 THEN 503 ELSE 200 END AS status,
    CASE b.p % 19 WHEN 0 THEN 'noindex' WHEN 1 THEN 'nofollow, noarchive' ELSE '' END AS xrobots,
    CASE WHEN b.p % 17 = 0 THEN 1 WHEN b.p % 17 = 1 THEN 2 WHEN b.p % 34 = 2 THEN 2 WHEN b.p % 34 = 19 THEN 6 ELSE 0 END AS hops
  FROM b
  LEFT JOIN b n ON n.p = b.p + 1 LEFT JOIN b r ON r.p = b.p - 1
  LEFT JOIN b c1 ON c1.p = 2 * b.p + 1 LEFT JOIN b c2 ON c2.p = 2 * b.p + 2
)"""
)
