"""Extraction queries: what one page says, on raw and on seeded pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from .registry import keys, query, table
from .seed import BASE_SQL, SEED_SQL, seeded_pages

_NAV = """
nav AS (
  SELECT p, u, origin, i - 1 AS idx, regexp_extract(a, 'href="([^"]*)"', 1) AS raw, regexp_extract(a, '>([^<]*)<', 1) AS label
  FROM (SELECT p, u, origin, unnest(l) AS a, generate_subscripts(l, 1) AS i
        FROM (SELECT p, u, origin, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM b))
)"""


@query(
    "page_meta",
    f"WITH {BASE_SQL} SELECT p AS page_id, trim(title) AS title, lang, '' AS description, '' AS viewport FROM b",
)
def page_meta(spark, sf_dir):
    return X.extract_facts(table(spark, sf_dir, "pages"), "title", "lang", "description", "viewport").drop("url", "base")


@query(
    "page_meta_seeded",
    f"WITH {SEED_SQL} SELECT p AS page_id, trim(title) AS title, lang, description, viewport FROM s",
)
def page_meta_seeded(spark, sf_dir):
    return X.extract_facts(seeded_pages(spark, sf_dir), "title", "lang", "description", "viewport").drop("url", "base")


@query(
    "canonicals",
    f"""WITH {SEED_SQL} SELECT p AS page_id, canon_count::INT AS canonical_count, canon_href AS canonical_href,
        CASE WHEN p % 5 = 4 THEN path ELSE canon_href END AS canonical_raw FROM s""",
)
def canonicals(spark, sf_dir):
    return X.extract_facts(seeded_pages(spark, sf_dir), "canonical").select(
        "page_id",
        F.col("canonical.count").alias("canonical_count"),
        F.col("canonical.href").alias("canonical_href"),
        F.col("canonical.raw").alias("canonical_raw"),
    )


@query(
    "robots_meta",
    f"""WITH {SEED_SQL} SELECT p AS page_id, CASE WHEN p % 7 = 3 THEN 'googlebot' ELSE 'robots' END AS name,
        robots AS content FROM s WHERE robots <> ''""",
)
def robots_meta(spark, sf_dir):
    return X.explode_items(X.extract_facts(seeded_pages(spark, sf_dir), "robots"), "robots")


@query(
    "head_signals",
    f"""WITH {SEED_SQL} SELECT p AS page_id, canon_count::INT AS canonicals, canon_href AS first_canonical,
        ((p % 8 <> 6)::INT + (p % 4 <> 3)::INT + (p % 9 = 0)::INT + (p % 10 = 0)::INT + (p % 20 = 0)::INT + (p % 15 = 1)::INT) AS alternates,
        robots AS robots FROM s""",
)
def head_signals(spark, sf_dir):
    return X.head_signals(seeded_pages(spark, sf_dir)).select(
        "page_id",
        F.size("canonical").alias("canonicals"),
        F.coalesce(F.get("canonical", F.lit(0)), F.lit("")).alias("first_canonical"),
        F.size("hreflang").alias("alternates"),
        F.array_join(F.transform("robots", lambda r: r["content"]), "|").alias("robots"),
    )


@query(
    "headings",
    f"""WITH {SEED_SQL}, hs AS (
      SELECT p, 0 AS o, 1 AS level, trim(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&quot;', '"'), '&amp;', '&')) AS text FROM s
      UNION ALL SELECT p, 1, 2, 'Sub' FROM s WHERE p % 3 = 0
      UNION ALL SELECT p, 2, 4, 'Deep' FROM s WHERE p % 3 = 1
      UNION ALL SELECT p, 3, 1, 'Second' FROM s WHERE p % 13 = 0
      UNION ALL SELECT p, 4, 3, '' FROM s WHERE p % 17 = 0)
    SELECT p AS page_id, (row_number() OVER (PARTITION BY p ORDER BY o) - 1)::INT AS idx, level::INT AS level, text FROM hs""",
)
def headings(spark, sf_dir):
    return X.explode_items(X.extract_facts(seeded_pages(spark, sf_dir), "headings"), "headings")


@query(
    "links_raw",
    f"""WITH {BASE_SQL}, {_NAV} SELECT p AS page_id, idx::INT AS idx, raw AS raw_href, label, 'http' AS kind, true AS internal FROM nav""",
)
def links_raw(spark, sf_dir):
    return X.links(table(spark, sf_dir, "pages")).select("page_id", "idx", "raw_href", "label", "kind", "internal")


# Links of the seeded pages: the navigation links of the page, then the seeded ones in order.
LINKS_SQL = (
    SEED_SQL
    + ","
    + _NAV
    + """,
lk0 AS (
  SELECT p, origin, idx AS o, raw, origin || raw AS href, label, 'http' AS kind, '' AS rel FROM nav
  UNION ALL SELECT p, origin, 100, t1, t1, 'Read more', 'http', '' FROM s WHERE t1 IS NOT NULL
  UNION ALL SELECT p, origin, 101, t2, t2, 'child ' || (p % 5), 'http', 'nofollow sponsored' FROM s WHERE t2 IS NOT NULL
  UNION ALL SELECT p, origin, 102, 'javascript:void(0)', 'javascript:void(0)', 'js', 'javascript', '' FROM s WHERE p % 8 = 1
  UNION ALL SELECT p, origin, 103, 'mailto:a@b.c', 'mailto:a@b.c', 'mail', 'mailto', '' FROM s WHERE p % 8 = 2
  UNION ALL SELECT p, origin, 104, origin || '/empty-' || (p % 4), origin || '/empty-' || (p % 4), '', 'http', '' FROM s WHERE p % 9 = 2
  UNION ALL SELECT p, origin, 105, '/about', origin || '/about', 'About us', 'http', 'ugc' FROM s WHERE p % 9 = 3
  UNION ALL SELECT p, origin, 106 + i, '/list?color=c' || i || '&page=' || i, origin || '/list?color=c' || i || '&page=' || i, 'c' || i, 'http', ''
    FROM s, (SELECT unnest(range(1, 13)) AS i) WHERE p % 4 = 2
  UNION ALL SELECT p, origin, 130, '/p/' || p, origin || '/p/' || p, 'item', 'http', '' FROM s WHERE p % 11 = 5
  UNION ALL SELECT p, origin, 131, '/i/1', origin || '/i/1', 'one', 'http', '' FROM s WHERE p % 11 = 6
  UNION ALL SELECT p, origin, 132, '/i/2', origin || '/i/2', 'two', 'http', '' FROM s WHERE p % 11 = 6
),
lk AS (
  SELECT p, origin, raw, href, label, kind, (row_number() OVER (PARTITION BY p ORDER BY o) - 1)::INT AS idx,
         kind = 'http' AND starts_with(href, origin || '/') AS internal, rel LIKE '%nofollow%' AS nofollow,
         rel LIKE '%sponsored%' AS sponsored, rel LIKE '%ugc%' AS ugc
  FROM lk0
)"""
)


@query(
    "links",
    f"""WITH {LINKS_SQL} SELECT p AS page_id, idx, raw AS raw_href, label, kind, internal, nofollow, sponsored, ugc FROM lk""",
)
def links(spark, sf_dir):
    return X.links(seeded_pages(spark, sf_dir)).select(
        "page_id", "idx", "raw_href", "label", "kind", "internal", "nofollow", "sponsored", "ugc"
    )


IMAGES_SQL = (
    SEED_SQL
    + """,
img AS (
  SELECT p, origin, u, i::INT AS idx, origin || '/img/' || p || '-' || i || '.png' AS src, (p % 2 = 0 OR i > 0) AS alt_present,
    CASE WHEN p % 4 = 2 THEN 'lazy' ELSE '' END AS loading, CASE WHEN p % 5 = 0 THEN '100' ELSE '' END AS width_attr,
    CASE WHEN p % 5 = 0 THEN '50' ELSE '' END AS height_attr, p % 6 = 2 AS has_srcset
  FROM s, (SELECT unnest([0, 1]) AS i) WHERE i < p % 3
)"""
)


@query(
    "images",
    f"WITH {IMAGES_SQL} SELECT p AS page_id, idx, src, alt_present, loading, width_attr, height_attr, has_srcset FROM img",
)
def images(spark, sf_dir):
    return X.images(seeded_pages(spark, sf_dir)).select(
        "page_id", "idx", "src", "alt_present", "loading", "width_attr", "height_attr", (F.col("srcset") != "").alias("has_srcset")
    )


HREFLANG_SQL = (
    SEED_SQL
    + """,
hl AS (
  SELECT p, u, tag, href, (row_number() OVER (PARTITION BY p ORDER BY o) - 1)::INT AS idx FROM (
    SELECT p, u, 0 AS o, ['en', 'de', 'fr'][(p % 3 + 1)::INT] AS tag, u AS href FROM s WHERE p % 8 <> 6
    UNION ALL SELECT p, u, 1, ['en', 'de', 'fr'][((CASE WHEN p % 2 = 0 THEN p + 1 ELSE p - 1 END) % 3 + 1)::INT], CASE WHEN p % 2 = 0 THEN nxt ELSE prv END
      FROM s WHERE p % 4 <> 3
    UNION ALL SELECT p, u, 2, 'english_1', u FROM s WHERE p % 9 = 0
    UNION ALL SELECT p, u, 3, 'x-default', u FROM s WHERE p % 10 = 0
    UNION ALL SELECT p, u, 4, 'X-Default', origin || '/' FROM s WHERE p % 20 = 0
    UNION ALL SELECT p, u, 5, ['en', 'de', 'fr'][(p % 3 + 1)::INT], u FROM s WHERE p % 15 = 1
  ) WHERE href IS NOT NULL
)"""
)


@query("hreflang_edges", f"WITH {HREFLANG_SQL} SELECT p AS page_id, idx, tag AS lang, href FROM hl")
def hreflang_edges(spark, sf_dir):
    return X.hreflang(seeded_pages(spark, sf_dir)).select("page_id", "idx", "lang", "href")


@query(
    "social_meta",
    f"""WITH {SEED_SQL} SELECT p AS page_id,
        CASE p % 11 WHEN 0 THEN 'product' WHEN 1 THEN 'article' ELSE '' END AS og_type,
        CASE p % 11 WHEN 2 THEN 'summary' ELSE '' END AS twitter_card FROM s""",
)
def social_meta(spark, sf_dir):
    facts = X.extract_facts(seeded_pages(spark, sf_dir), "open_graph", "twitter")
    return facts.select(
        "page_id",
        F.coalesce(F.try_element_at("open_graph", F.lit("og:type")), F.lit("")).alias("og_type"),
        F.coalesce(F.try_element_at("twitter", F.lit("twitter:card")), F.lit("")).alias("twitter_card"),
    )


# Text of the raw pages without markup; scripts and styles sit in the head there.
BODY_TEXT = r"""replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '<!--[^>]*-->', '', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&')"""


@query(
    "text_word_count",
    f"""WITH {BASE_SQL} SELECT p AS page_id, len(list_filter(regexp_split_to_array({BODY_TEXT}, '\\s+'), lambda x: x <> ''))::INT AS text_word_count FROM b""",
)
def text_word_count(spark, sf_dir):
    return X.extract_facts(table(spark, sf_dir, "pages"), "text_word_count").select("page_id", "text_word_count")


@query(
    "page_signals",
    f"""WITH {SEED_SQL} SELECT p AS page_id, 1 AS articles, CASE WHEN p % 12 = 0 THEN 2 ELSE 0 END AS search_controls,
        (p % 11 = 5)::INT AS product_microdata, (p % 11 = 6)::INT AS itemlist_microdata,
        CASE p % 11 WHEN 5 THEN '/p/' || p WHEN 6 THEN '/i/1|/i/2' ELSE '' END AS listing,
        CASE WHEN p % 11 = 3 THEN coalesce(nxt, '') ELSE '' END AS rel_next,
        CASE WHEN p % 11 = 4 THEN coalesce(prv, '') ELSE '' END AS rel_prev FROM s""",
)
def page_signals(spark, sf_dir):
    s = X.extract_facts(seeded_pages(spark, sf_dir), "signals").select("page_id", "signals.*")
    return s.withColumn("listing", F.array_join("listing_refs", "|")).drop("listing_refs")


SCRIPTS_SQL = (
    SEED_SQL
    + """,
sc AS (
  SELECT p, u, origin, url, type, async_, defer_, inline_bytes, (row_number() OVER (PARTITION BY p ORDER BY o) - 1)::INT AS idx,
         coalesce(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, url <> '' AND NOT starts_with(url, origin || '/') AS third_party FROM (
    SELECT p, u, origin, 0 AS o, '' AS url, 'application/ld+json' AS type, false AS async_, false AS defer_, NULL::INT AS inline_bytes
      FROM s WHERE p % 4 IN (1, 2) OR p % 16 IN (3, 7, 11, 15)
    UNION ALL SELECT p, u, origin, 1, 'https://cdn' || (p % 8) || '.example.net/app.js', 'classic', true, false, 0 FROM s
    UNION ALL SELECT p, u, origin, 2, 'https://cdn' || (p % 8) || '.example.net/app.js', 'classic', false, false, 0 FROM s WHERE p % 3 = 0
    UNION ALL SELECT p, u, origin, 3, 'http://www.google-analytics.com/ga.js', 'classic', false, true, 0 FROM s WHERE p % 4 = 0
    UNION ALL SELECT p, u, origin, 4, origin || '/js/m' || (p % 7) || '.js', 'module', false, false, 0 FROM s WHERE p % 5 = 0
    UNION ALL SELECT p, u, origin, 5, '', 'classic', false, false, length(regexp_extract(html, '<script>([^/]*</p>[^<]*)</script>', 1))::INT FROM s)
)"""
)


@query(
    "scripts",
    f"""WITH {SCRIPTS_SQL} SELECT p AS page_id, idx, url <> '' AS external, url, host, third_party, async_ AS is_async, defer_ AS is_defer,
        type = 'module' AS module, type, inline_bytes, true AS in_head FROM sc""",
)
def scripts(spark, sf_dir):
    rows = X.scripts(seeded_pages(spark, sf_dir))
    return rows.select(
        "page_id", "idx", "external", "url", "host", "third_party", F.col("async").alias("is_async"), F.col("defer").alias("is_defer"),
        "module", "type", F.when(F.col("type") != "application/ld+json", F.col("inline_bytes")).alias("inline_bytes"), "in_head",
    )


STYLES_SQL = (
    SEED_SQL
    + """,
st AS (
  SELECT p, u, origin, url, media, (row_number() OVER (PARTITION BY p ORDER BY o) - 1)::INT AS idx FROM (
    SELECT p, u, origin, 0 AS o, origin || '/css/site' || (p % 8) || '.css' AS url, 'all' AS media FROM s
    UNION ALL SELECT p, u, origin, 1, origin || '/css/site' || (p % 8) || '.css', 'all' FROM s WHERE p % 6 = 1
    UNION ALL SELECT p, u, origin, 2, origin || '/css/print.css', 'print' FROM s WHERE p % 7 = 5)
)"""
)


@query("stylesheets", f"WITH {STYLES_SQL} SELECT p AS page_id, idx, url, media, false AS third_party FROM st")
def stylesheets(spark, sf_dir):
    return X.stylesheets(seeded_pages(spark, sf_dir)).select("page_id", "idx", "url", "media", "third_party")


@query(
    "inline_styles",
    f"""WITH {BASE_SQL} SELECT p AS page_id, 0 AS idx, length(regexp_extract(html, '<style>([^<]*)</style>', 1))::INT AS bytes, 'all' AS media FROM b""",
)
def inline_styles(spark, sf_dir):
    return X.explode_items(X.extract_facts(table(spark, sf_dir, "pages"), "inline_styles"), "inline_styles")


@query(
    "resource_hints",
    f"""WITH {SEED_SQL} SELECT p AS page_id, 'preload' AS rel, origin || '/fonts/f' || (p % 8) || '.woff2' AS url, 'font' AS as_, true AS crossorigin FROM s WHERE p % 3 = 1
        UNION ALL SELECT p, 'preconnect', 'https://cdn' || (p % 8) || '.example.net/', '', false FROM s WHERE p % 3 = 2""",
)
def resource_hints(spark, sf_dir):
    rows = X.resource_hints(seeded_pages(spark, sf_dir))
    return rows.select("page_id", "rel", "url", F.col("as").alias("as_"), "crossorigin")


@query(
    "dom_stats",
    f"""WITH {BASE_SQL} SELECT p AS page_id, len(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--[^>]*-->', '', 'g'), '<script>.*?</script>', '<script>'), '<[a-z]'))::INT AS nodes,
        CASE WHEN html LIKE '%<b>%<br>%' OR html LIKE '%<li><a %' THEN 6 ELSE 5 END AS max_depth FROM b""",
)
def dom_stats(spark, sf_dir):
    return X.extract_facts(table(spark, sf_dir, "pages"), "dom").select("page_id", "dom.*")


# Unicode words of the raw body text, counted piece by piece between tags.
RAW_WORDS = r"""list_sum(list_transform(string_split_regex(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '<!--[^>]*-->', '', 'g'), '&quot;', '"'), '&amp;', '&'), '&middot;', '·'), '<[^>]*>'), lambda x: len(regexp_extract_all(x, '[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*'))))"""


@query(
    "text_scan",
    f"""WITH {SEED_SQL}, w AS (SELECT p, ({RAW_WORDS} - 1)::BIGINT AS base,
          (CASE WHEN t1 IS NULL THEN 0 ELSE 2 END + CASE WHEN t2 IS NULL THEN 0 ELSE 2 END + (p % 8 = 1)::INT + (p % 8 = 2)::INT
           + CASE WHEN p % 4 = 2 THEN 12 ELSE 0 END + (p % 3 < 2)::INT + (p % 13 = 0)::INT + (p % 11 = 5)::INT
           + CASE WHEN p % 11 = 6 THEN 2 ELSE 0 END) AS seen,
          [0, 3, 2, 1, 3][(p % 5 + 1)::INT] AS hidden FROM s)
        SELECT p AS page_id, (base + seen)::INT AS visible, hidden::INT AS hidden, (base + seen + hidden)::INT AS all_words,
          CASE p % 5 WHEN 1 THEN 'div:hidden attribute' WHEN 2 THEN 'div#x' || p || '.a.b:display:none' WHEN 3 THEN 'span:aria-hidden'
            WHEN 4 THEN 'div:visibility:hidden' ELSE '' END AS roots FROM w""",
)
def text_scan(spark, sf_dir):
    t = X.extract_facts(seeded_pages(spark, sf_dir), "text").select("page_id", "text.*")
    roots = F.transform("roots", lambda r: F.concat(r["element"], F.lit(":"), r["reason"]))
    return t.select("page_id", "visible", "hidden", F.col("all").alias("all_words"), F.array_join(roots, "|").alias("roots"))


RESOURCES_SQL = (
    SCRIPTS_SQL
    + """,
"""
    + STYLES_SQL.split("st AS")[0].replace(SEED_SQL + ",", "").strip()
    + "st AS"
    + STYLES_SQL.split("st AS")[1]
    + ","
    + "img AS"
    + IMAGES_SQL.split("img AS")[1]
    + """,
dr AS (
  SELECT p, url, 'javascript' AS kind, 'dom' AS source, true AS active FROM sc WHERE url <> ''
  UNION ALL SELECT p, url, 'css', 'dom', true FROM st
  UNION ALL SELECT p, 'http://ads.example.org/f.html', 'iframe', 'dom', true FROM s WHERE p % 10 = 5
  UNION ALL SELECT p, src, 'image', 'dom', false FROM img
  UNION ALL SELECT p, src, 'image', 'srcset', false FROM img WHERE has_srcset
  UNION ALL SELECT p, 'http://img.example.net/' || p || '.png', 'image', 'srcset', false FROM img WHERE has_srcset
)"""
)


@query("dom_resources", f"WITH {RESOURCES_SQL} SELECT p AS page_id, url, kind, source, active FROM dr")
def dom_resources(spark, sf_dir):
    return X.dom_resources(seeded_pages(spark, sf_dir)).drop("page_url")


# --- markup that is no markup, and references no browser takes at their word ---

HOSTILE = [
    """<html lang="en"><head><title>T&#x110000;&#xD800;&#0;&#99999999;&#128; &copy p""",
    """ &check; &unknown; &amp;lt; &#65 &#x42;</title></head><body><h1>Real """,
    """</h1><textarea><a href="/x">no</a><h1>no</h1></textarea><xmp><a href="/y">no</a></xmp><iframe src="/f"><a href="/z">no</a></iframe>"""
    """<template><a href="/t">no</a><img src="/t.png"><template><h2>no</h2></template><h1>no</h1></template><noscript><a href="/n">no</a><img src="/n.png"></noscript>"""
    """</template><!-- <a href="/c">no</a> --><script>"<a href='/s'>no</a>"</script><a href="/real?a=1&copy=2&amp;b=&#x80;">yes """,
    """</a><img src="/real.png" alt=""></body></html>""",
]


@query(
    "hostile_pages",
    """SELECT page_id, 'T' || repeat(chr(65533), 4) || chr(8364) || ' ' || chr(169) || ' p' || page_id || ' ' || chr(10003) || ' &unknown; &lt; A B' AS title, 1 AS links,
         '/real?a=1&copy=2&b=' || chr(8364) AS href, 'yes ' || page_id AS label, 1 AS headings, 'Real ' || page_id AS heading, 1 AS images, '/real.png' AS src FROM pages""",
)
def hostile_pages(spark, sf_dir):
    p = F.col("page_id").cast("string")
    html = F.concat(*[x for piece in HOSTILE[:-1] for x in (F.lit(piece), p)], F.lit(HOSTILE[-1]))
    facts = X.extract_facts(keys(spark, sf_dir).withColumn("html", html), "title", "links", "headings", "images")
    first = lambda c, f: F.get(F.col(c), F.lit(0))[f]
    return facts.select(
        "page_id", "title", F.size("links").alias("links"), first("links", "raw_href").alias("href"), first("links", "label").alias("label"),
        F.size("headings").alias("headings"), first("headings", "text").alias("heading"), F.size("images").alias("images"), first("images", "src").alias("src"),
    )
