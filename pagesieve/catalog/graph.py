"""Multi-page queries: links, robots, sitemaps, hreflang, canonical chains, crawls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import canonicals, crawl as crawling
from ..operators import extract as X
from ..operators import hreflangs as H
from ..operators import indexability as N
from ..operators import links as L
from ..operators import robots as RB
from ..operators import sitemaps as SM
from ..plans.audit import page_facts, stored
from .facts import HREFLANG_SQL, LINKS_SQL
from .pages import VERDICT
from ..functions.sql import register
from .registry import keys, query, table
from .seed import BASE_SQL, SEED_SQL, fetch_log, seeded_pages


def link_results(spark, sf_dir):
    """Two checks per page URL: a stale failure and the fetch result."""
    log = fetch_log(spark, sf_dir)
    fresh = log.select("url", "status", "redirected", "final_url", "error", F.col("captured_at").alias("checked_at"))
    stale = fresh.select(
        "url", F.lit(500).alias("status"), F.lit(False).alias("redirected"), F.col("url").alias("final_url"), F.lit("").alias("error"),
        (F.col("checked_at") - F.expr("INTERVAL 1 DAY")).alias("checked_at"),
    )
    return fresh.unionByName(stale)


# Results by URL and the state they give a link.
RESULTS_SQL = """
res AS (SELECT u AS href, status, hops > 0 AS redirected, CASE WHEN p % 29 = 7 THEN 'timeout' ELSE '' END AS error,
          CASE WHEN p % 29 = 7 OR status = 0 THEN 'unknown' WHEN status >= 400 THEN 'broken' WHEN hops > 0 THEN 'redirect' ELSE 'ok' END AS state FROM s)"""
# The raw navigation links carry characters that URLs must encode; only their plain part is compared here.
_HTTP = "kind = 'http'"


def _links(spark, sf_dir):
    return X.links(seeded_pages(spark, sf_dir))


_LABEL = "lower(trim(regexp_replace(replace(replace(label, '&amp;', '&'), '&quot;', '\"'), '\\s+', ' ', 'g')))"


@query(
    "anchor_conflicts",
    f"WITH {LINKS_SQL} SELECT {_LABEL} AS label, count(DISTINCT href) AS urls, count(*) AS links FROM lk WHERE {_HTTP} AND {_LABEL} <> '' GROUP BY 1 HAVING count(DISTINCT href) > 1",
)
def anchor_conflicts(spark, sf_dir):
    return L.anchor_conflicts(_links(spark, sf_dir))


@query(
    "anchor_conflicts_by_page",
    f"WITH {LINKS_SQL} SELECT p AS page_id, {_LABEL} AS label, count(DISTINCT href) AS urls, count(*) AS links FROM lk WHERE {_HTTP} AND {_LABEL} <> '' GROUP BY 1, 2 HAVING count(DISTINCT href) > 1",
)
def anchor_conflicts_by_page(spark, sf_dir):
    return L.anchor_conflicts(_links(spark, sf_dir), ("page_id",))


@query(
    "multi_anchor_targets",
    f"WITH {LINKS_SQL} SELECT count(*) AS targets, sum(labels)::BIGINT AS labels, sum(links)::BIGINT AS links FROM (SELECT href, count(DISTINCT {_LABEL}) AS labels, count(*) AS links FROM lk WHERE {_HTTP} AND {_LABEL} <> '' GROUP BY 1 HAVING count(DISTINCT {_LABEL}) > 1)",
)
def multi_anchor_targets(spark, sf_dir):
    rows = L.multi_anchor_targets(_links(spark, sf_dir))
    return rows.agg(F.count("*").alias("targets"), F.coalesce(F.sum("labels"), F.lit(0)).alias("labels"), F.coalesce(F.sum("links"), F.lit(0)).alias("links")).selectExpr(
        "targets", "CASE WHEN targets = 0 THEN NULL ELSE labels END AS labels", "CASE WHEN targets = 0 THEN NULL ELSE links END AS links"
    )


@query(
    "conflict_members",
    f"WITH {LINKS_SQL}, g AS (SELECT {_LABEL} AS label FROM lk WHERE {_HTTP} GROUP BY 1 HAVING count(DISTINCT href) > 1) SELECT {_LABEL} AS label, count(DISTINCT href) AS urls, count(*)::BIGINT AS links FROM lk WHERE {_HTTP} AND {_LABEL} <> '' AND {_LABEL} IN (SELECT label FROM g) GROUP BY 1",
)
def conflict_members(spark, sf_dir):
    links = stored(_links(spark, sf_dir))
    rows = L.conflict_members(links, L.anchor_conflicts(links), "label", "url")
    return rows.groupBy("label").agg(F.count("*").alias("urls"), F.sum("links").alias("links"))


@query(
    "anchor_summary",
    f"WITH {LINKS_SQL} SELECT p AS page_id, count(*) FILTER (WHERE {_HTTP}) AS http_links, count(*) FILTER (WHERE {_HTTP} AND {_LABEL} IN ({', '.join(repr(x) for x in L.GENERIC_ANCHORS)})) AS generic, count(*) FILTER (WHERE {_HTTP} AND {_LABEL} = '') AS empty FROM lk GROUP BY p",
)
def anchor_summary(spark, sf_dir):
    return L.anchor_summary(_links(spark, sf_dir))


@query(
    "filter_links",
    f"""WITH {LINKS_SQL}, {RESULTS_SQL} SELECT f, count(*) AS links FROM (
        SELECT 'all' AS f FROM lk UNION ALL SELECT 'external' FROM lk WHERE {_HTTP} AND NOT internal UNION ALL SELECT 'nofollow' FROM lk WHERE nofollow
        UNION ALL SELECT 'sponsored' FROM lk WHERE sponsored UNION ALL SELECT 'ugc' FROM lk WHERE ugc
        UNION ALL SELECT 'generic' FROM lk WHERE {_HTTP} AND {_LABEL} IN ({', '.join(repr(x) for x in L.GENERIC_ANCHORS)})
        UNION ALL SELECT 'broken' FROM lk JOIN res USING (href) WHERE state = 'broken' UNION ALL SELECT 'redirecting' FROM lk JOIN res USING (href) WHERE state = 'redirect') GROUP BY f""",
)
def filter_links(spark, sf_dir):
    rows = L.with_results(_links(spark, sf_dir), link_results(spark, sf_dir))
    names = ["all", "external", "nofollow", "sponsored", "ugc", "generic", "broken", "redirecting"]
    generic = (F.col("kind") == "http") & L.is_generic_anchor(F.col("label"))
    flags = {
        "all": F.lit(True), "external": F.expr("kind = 'http' AND NOT internal"), "nofollow": F.col("nofollow"), "sponsored": F.col("sponsored"),
        "ugc": F.col("ugc"), "generic": generic, "broken": F.col("state") == "broken", "redirecting": F.col("state") == "redirect",
    }
    hits = F.array_compact(F.array(*[F.when(flags[n], F.lit(n)) for n in names]))
    return rows.select(F.explode(hits).alias("f")).groupBy("f").agg(F.count("*").alias("links"))


@query(
    "broken_link_filter",
    f"WITH {LINKS_SQL}, {RESULTS_SQL} SELECT p AS page_id, idx FROM lk JOIN res USING (href) WHERE state = 'broken'",
)
def broken_link_filter(spark, sf_dir):
    return L.filter_links(L.with_results(_links(spark, sf_dir), link_results(spark, sf_dir)), "broken").select("page_id", "idx")


@query(
    "link_results_latest",
    f"WITH {SEED_SQL}, {RESULTS_SQL} SELECT href AS norm, status::INT AS status, redirected, error FROM res",
)
def link_results_latest(spark, sf_dir):
    return L.link_results_latest(link_results(spark, sf_dir)).select("norm", "status", "redirected", "error")


@query(
    "link_summary",
    f"""WITH {LINKS_SQL}, {RESULTS_SQL} SELECT p AS page_id, count(*) AS checked, count(*) FILTER (WHERE state = 'ok') AS ok, count(*) FILTER (WHERE state = 'redirect') AS redirect,
        count(*) FILTER (WHERE state = 'broken') AS broken, count(*) FILTER (WHERE state = 'unknown') AS unknown, count(*) FILTER (WHERE state = 'redirect' AND internal) AS internal_redirect
        FROM (SELECT p, href, arg_min(internal, idx) AS internal FROM lk WHERE {_HTTP} GROUP BY p, href) JOIN res USING (href) GROUP BY p""",
)
def link_summary(spark, sf_dir):
    return L.link_summary(_links(spark, sf_dir), link_results(spark, sf_dir))


@query(
    "select_targets",
    f"WITH {LINKS_SQL} SELECT p AS page_id, count(*) AS targets FROM (SELECT href, min((p, idx)) AS f, arg_min(p, (p, idx)) AS p FROM lk WHERE {_HTTP} AND href NOT IN (SELECT u FROM s) GROUP BY href) GROUP BY p",
)
def select_targets(spark, sf_dir):
    rows = L.select_targets(_links(spark, sf_dir), checked=link_results(spark, sf_dir))
    return rows.groupBy("page_id").agg(F.count("*").alias("targets"))


@query(
    "page_targets",
    f"""WITH {LINKS_SQL}, t AS (SELECT p, href, min(idx) AS idx FROM lk WHERE {_HTTP} GROUP BY p, href)
        SELECT p AS page_id, rn::INT AS rn, n > 10 AS capped, idx FROM (SELECT p, idx, row_number() OVER (PARTITION BY p ORDER BY idx) AS rn, count(*) OVER (PARTITION BY p) AS n FROM t) WHERE rn <= 10""",
)
def page_targets(spark, sf_dir):
    links = _links(spark, sf_dir)
    first = L.first_occurrences(links).select("page_id", "norm", "idx")
    return L.page_targets(links, 10).join(first, ["page_id", "norm"]).select("page_id", "rn", "capped", "idx")


@query(
    "broken_links",
    f"WITH {LINKS_SQL}, {RESULTS_SQL} SELECT href AS norm, status::INT AS status, p AS page_id, idx, label FROM lk JOIN res USING (href) WHERE state = 'broken'",
)
def broken_links(spark, sf_dir):
    return L.broken_links(_links(spark, sf_dir), link_results(spark, sf_dir))


# --- robots.txt: one document per host, by class of its first page ---


def robots_docs(spark, sf_dir):
    pages = keys(spark, sf_dir).select(
        "page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("origin")
    )
    hosts = pages.groupBy("host").agg(F.min(F.struct("page_id", "origin")).alias("f"))
    k, origin = F.col("f.page_id"), F.col("f.origin")
    ks = k.cast("string")
    text = (
        F.when(k % 4 == 0, F.lit("# main\nUser-agent: *\nDisallow: /de/\nAllow: /de/1\nDisallow: /*?page=\n"))
        .when(
            k % 4 == 1,
            F.concat(
                F.lit("Disallow: /early\r\nUser-agent: *\r\nDisallow: /\r\n\r\nUser-agent: Googlebot\r\nUser-agent: Otherbot\r\nDisallow: /fr/\r\nAllow: /fr/*5$\r\nSitemap: /maps/"),
                ks, F.lit(".xml\r\n"),
            ),
        )
        .when(
            k % 4 == 2,
            F.lit(
                "User-agent:\nno colon here\nUser-agent: Google\nDisallow:\nSitemap:\nSitemap: https://maps.example.net/index-0.xml\n"
                "Sitemap: /sitemap.xml # main\nSitemap: /sitemap.xml\nUser-agent: Goo\nDisallow: /\n"
            ),
        )
        .otherwise(F.lit(""))
    )
    status = F.when(k % 8 == 7, 500).when(k % 4 == 3, 404).otherwise(200)
    return hosts.select(
        "host", origin.alias("origin"), F.concat(origin, F.lit("/robots.txt")).alias("robots_url"), status.alias("status"), text.alias("text"), k.alias("k")
    )


ROBOTS_SQL = """
rh AS (SELECT host, min(p) AS k, arg_min(origin, p) AS origin FROM s GROUP BY host),
rr AS (
  SELECT host, 1 AS group_id, type, path, line FROM rh, (SELECT * FROM (VALUES ('disallow', '/de/', 3), ('allow', '/de/1', 4), ('disallow', '/*?page=', 5)) t(type, path, line)) WHERE k % 4 = 0
  UNION ALL SELECT host, g, type, path, line FROM rh, (SELECT * FROM (VALUES (1, 'disallow', '/', 3), (2, 'disallow', '/fr/', 7), (2, 'allow', '/fr/*5$', 8)) t(g, type, path, line)) WHERE k % 4 = 1
  UNION ALL SELECT host, g, type, path, line FROM rh, (SELECT * FROM (VALUES (1, 'disallow', '', 4), (2, 'disallow', '/', 10)) t(g, type, path, line)) WHERE k % 4 = 2
),
re AS (
  SELECT p, s.u, s.host, s.path || s.query AS full_path, rh.k, CASE
    WHEN rh.k % 4 = 0 THEN CASE WHEN s.path || s.query LIKE '/%?page=%' THEN 'disallow:5' WHEN s.path || s.query LIKE '/de/1%' THEN 'allow:4' WHEN s.path || s.query LIKE '/de/%' THEN 'disallow:3' ELSE '' END
    WHEN rh.k % 4 = 1 THEN CASE WHEN regexp_matches(s.path || s.query, '^/fr/.*5$') THEN 'allow:8' WHEN s.path || s.query LIKE '/fr/%' THEN 'disallow:7' ELSE '' END
    ELSE '' END AS hit
  FROM s JOIN rh USING (host)
)"""


@query("robots_rules", f"WITH {SEED_SQL}, {ROBOTS_SQL} SELECT host, group_id, type, path, line FROM rr")
def robots_rules(spark, sf_dir):
    return RB.robots_rules(robots_docs(spark, sf_dir))


@query(
    "robots_agents",
    f"""WITH {SEED_SQL}, {ROBOTS_SQL} SELECT host, g AS group_id, agent, line FROM rh, (SELECT * FROM (VALUES (0, 1, '*', 2), (1, 1, '*', 2), (1, 2, 'googlebot', 5), (1, 2, 'otherbot', 6), (2, 1, 'google', 3), (2, 2, 'goo', 9)) t(c, g, agent, line)) WHERE k % 4 = c""",
)
def robots_agents(spark, sf_dir):
    return RB.robots_agents(robots_docs(spark, sf_dir))


@query(
    "robots_warnings",
    f"""WITH {SEED_SQL}, {ROBOTS_SQL} SELECT host, line, message FROM rh, (SELECT * FROM (VALUES (1, 1, 'disallow appears before a User-agent group.'), (2, 1, 'Empty User-agent directive.'),
        (2, 2, 'Directive is missing a colon.'), (2, 5, 'Empty Sitemap directive.')) t(c, line, message)) WHERE k % 4 = c""",
)
def robots_warnings(spark, sf_dir):
    return RB.robots_warnings(robots_docs(spark, sf_dir))


@query(
    "robots_sitemaps",
    f"""WITH {SEED_SQL}, {ROBOTS_SQL} SELECT host, origin || '/maps/' || k || '.xml' AS sitemap, 9 AS line FROM rh WHERE k % 4 = 1
        UNION ALL SELECT host, 'https://maps.example.net/index-0.xml', 6 FROM rh WHERE k % 4 = 2 UNION ALL SELECT host, origin || '/sitemap.xml', 7 FROM rh WHERE k % 4 = 2""",
)
def robots_sitemaps(spark, sf_dir):
    return RB.robots_sitemaps(robots_docs(spark, sf_dir))


@query(
    "robots_groups",
    f"""WITH {SEED_SQL}, {ROBOTS_SQL} SELECT host, CASE k % 4 WHEN 1 THEN 2 ELSE 1 END AS group_id, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE 6 END AS weight FROM rh WHERE k % 4 < 3""",
)
def robots_groups(spark, sf_dir):
    return RB.robots_groups(RB.robots_agents(robots_docs(spark, sf_dir)))


@query(
    "robots_eval",
    f"""WITH {SEED_SQL}, {ROBOTS_SQL} SELECT p AS page_id, full_path AS path, hit NOT LIKE 'dis%' AS allowed, split_part(hit, ':', 1) AS rule_type, CASE WHEN hit = '' THEN NULL ELSE split_part(hit, ':', 2)::INT END AS rule_line FROM re""",
)
def robots_eval(spark, sf_dir):
    pages = keys(spark, sf_dir)
    return RB.robots_eval(pages, robots_docs(spark, sf_dir)).select("page_id", "path", "allowed", "rule_type", "rule_line")


@query(
    "robots_status",
    f"""WITH {SEED_SQL}, {ROBOTS_SQL} SELECT p AS page_id, CASE WHEN k % 8 = 7 THEN 'unknown' WHEN k % 4 = 3 THEN 'allowed' WHEN hit LIKE 'dis%' THEN 'blocked' ELSE 'allowed' END AS state FROM re""",
)
def robots_status(spark, sf_dir):
    pages = keys(spark, sf_dir)
    return RB.robots_status(pages, robots_docs(spark, sf_dir)).select("page_id", "state")


@query(
    "indexability_with_robots",
    f"""WITH {SEED_SQL}, {ROBOTS_SQL}, z AS (SELECT s.*, re.hit, re.k FROM s JOIN re USING (p))
        SELECT p AS page_id, CASE WHEN status >= 400 THEN 'Error' WHEN k % 4 < 3 AND hit LIKE 'dis%' THEN 'Blocked' ELSE {VERDICT} END AS verdict FROM z""",
)
def indexability_with_robots(spark, sf_dir):
    pages = seeded_pages(spark, sf_dir)
    blocked = RB.robots_status(table(spark, sf_dir, "pages"), robots_docs(spark, sf_dir)).select(
        "page_id", (F.col("state") == "blocked").alias("robots_blocked")
    )
    df = page_facts(pages, "canonical", "robots", fetch_log=fetch_log(spark, sf_dir)).join(blocked, "page_id", "left")
    return N.indexability(df).select("page_id", "verdict")


@query(
    "sitemap_seeds",
    f"""WITH {SEED_SQL}, {ROBOTS_SQL} SELECT host, origin || '/maps/' || k || '.xml' AS sitemap, true AS declared FROM rh WHERE k % 4 = 1
        UNION ALL SELECT host, unnest(['https://maps.example.net/index-0.xml', origin || '/sitemap.xml']), true FROM rh WHERE k % 4 = 2
        UNION ALL SELECT host, origin || '/sitemap.xml', false FROM rh WHERE k % 4 IN (0, 3)""",
)
def sitemap_seeds(spark, sf_dir):
    docs = robots_docs(spark, sf_dir)
    return RB.sitemap_seeds(docs.select("host", "origin"), docs)


# --- sitemaps: a document per 50 pages, an index per 100 documents ---


def sitemap_texts(spark, sf_dir):
    pages = keys(spark, sf_dir).select("page_id", F.regexp_replace("url", "#.*$", "").alias("u"))
    p = F.col("page_id")
    xml = F.replace(F.col("u"), F.lit("&"), F.lit("&amp;"))
    day = F.lpad(((p % 28) + 1).cast("string"), 2, "0")
    entry = (
        F.when(p % 3 == 0, F.concat(F.lit("<url><loc> "), xml, F.lit("</loc><lastmod>2024-01-"), day, F.lit("</lastmod></url>")))
        .when(p % 3 == 1, F.concat(F.lit("<sm:url x='1'><loc><![CDATA["), F.col("u"), F.lit("#frag]]></loc></sm:url>")))
        .when(p % 5 == 0, F.lit("<url><lastmod>2024</lastmod></url>"))
        .otherwise(F.lit(""))
    )
    bucket = F.floor(p / 50)
    maps = pages.groupBy(bucket.alias("b")).agg(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))).alias("es"))
    body = F.array_join(F.transform("es", lambda x: x["e"]), "")
    docs = maps.select(
        F.concat(F.lit("https://maps.example.net/"), F.col("b").cast("string"), F.lit(".xml")).alias("sitemap_url"),
        F.when(F.col("b") % 7 == 6, F.lit("<html>gone</html>")).otherwise(
            F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit("</urlset>"))
        ).alias("text"),
    )
    group = F.floor(F.col("b") / 100)
    index = maps.select("b").groupBy(group.alias("g")).agg(F.array_sort(F.collect_list("b")).alias("bs"))
    names = F.transform("bs", lambda b: F.concat(F.lit("<sitemap><loc>/"), b.cast("string"), F.lit(".xml</loc></sitemap>")))
    me = F.concat(F.lit("https://maps.example.net/index-"), F.col("g").cast("string"), F.lit(".xml"))
    indexes = index.select(
        me.alias("sitemap_url"),
        F.concat(F.lit("<sitemapindex>"), F.array_join(names, ""), F.lit("<sitemap><loc>"), me, F.lit("</loc></sitemap><sitemap></sitemap></sitemapindex>")).alias("text"),
    )
    return docs.unionByName(indexes)


SITEMAP_SQL = """
se AS (SELECT p, 'https://maps.example.net/' || (p // 50) || '.xml' AS sitemap_url, u AS loc, CASE WHEN p % 3 = 0 THEN '2024-01-' || lpad((p % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS lastmod
       FROM s WHERE p % 3 IN (0, 1) AND (p // 50) % 7 <> 6),
bk AS (SELECT DISTINCT p // 50 AS b FROM s)"""


@query(
    "sitemap_entries",
    f"""WITH {SEED_SQL}, {SITEMAP_SQL} SELECT sitemap_url, 'urlset' AS type, loc, lastmod FROM se
        UNION ALL SELECT 'https://maps.example.net/index-' || (b // 100) || '.xml', 'sitemapindex', 'https://maps.example.net/' || b || '.xml', '' FROM bk
        UNION ALL SELECT DISTINCT 'https://maps.example.net/index-' || (b // 100) || '.xml', 'sitemapindex', 'https://maps.example.net/index-' || (b // 100) || '.xml', '' FROM bk""",
)
def sitemap_entries(spark, sf_dir):
    return SM.sitemap_entries(sitemap_texts(spark, sf_dir)).select("sitemap_url", "type", "loc", "lastmod")


@query(
    "sitemap_warnings",
    f"""WITH {SEED_SQL}, {SITEMAP_SQL} SELECT 'https://maps.example.net/' || b || '.xml' AS sitemap_url, 'Sitemap root is not urlset or sitemapindex.' AS message FROM bk WHERE b % 7 = 6
        UNION ALL SELECT 'https://maps.example.net/' || (p // 50) || '.xml', 'A URL entry is missing loc.' FROM s WHERE p % 3 = 2 AND p % 5 = 0 AND (p // 50) % 7 <> 6
        UNION ALL SELECT DISTINCT 'https://maps.example.net/index-' || (b // 100) || '.xml', 'A sitemap entry is missing loc.' FROM bk""",
)
def sitemap_warnings(spark, sf_dir):
    return SM.sitemap_warnings(sitemap_texts(spark, sf_dir))


@query(
    "sitemap_expand",
    f"""WITH {SEED_SQL}, {SITEMAP_SQL}, {ROBOTS_SQL} SELECT host, 'https://maps.example.net/index-0.xml' AS sitemap_url, 0 AS level FROM rh WHERE k % 4 = 2
        UNION ALL SELECT host, 'https://maps.example.net/' || b || '.xml', 1 FROM rh, bk WHERE k % 4 = 2 AND b < 100""",
)
def sitemap_expand(spark, sf_dir):
    docs = robots_docs(spark, sf_dir)
    return SM.sitemap_expand(sitemap_texts(spark, sf_dir), RB.sitemap_seeds(docs.select("host", "origin"), docs))


_MEMBER = """
mb AS (SELECT s.*, coalesce(a.sitemap_url, '') AS ssm, coalesce(a.lastmod, '') AS slm, coalesce(c.sitemap_url, '') AS csm FROM s
       LEFT JOIN se a ON a.loc = s.u LEFT JOIN se c ON c.loc = CASE WHEN s.canon_href = '' THEN s.u ELSE s.canon_href END)"""


def _sitemap_pages(spark, sf_dir):
    return N.indexability(page_facts(seeded_pages(spark, sf_dir), "canonical", "robots", fetch_log=fetch_log(spark, sf_dir)))


@query(
    "sitemap_membership",
    f"WITH {SEED_SQL}, {SITEMAP_SQL}, {_MEMBER} SELECT p AS page_id, ssm AS source_sitemap, slm AS source_lastmod, csm AS canonical_sitemap FROM mb",
)
def sitemap_membership(spark, sf_dir):
    pages = U_pages(page_facts(seeded_pages(spark, sf_dir), "canonical"))
    return SM.sitemap_membership(pages, SM.sitemap_entries(sitemap_texts(spark, sf_dir))).drop("source_found", "canonical_found")


def U_pages(facts):
    return facts.withColumns(N.comparable_urls())


@query(
    "sitemap_issues",
    f"""WITH {SEED_SQL}, {SITEMAP_SQL}, {_MEMBER}, v AS (SELECT *, {VERDICT} AS verdict FROM mb)
        SELECT p AS page_id, array_to_string(list_filter([CASE WHEN canon_href NOT IN ('', u) THEN 'noncanonical-source-in-sitemap' END, CASE WHEN hops > 0 THEN 'redirect-source-in-sitemap' END,
          CASE WHEN verdict = 'Noindex' THEN 'nonindexable-source-in-sitemap' END, CASE WHEN status >= 400 THEN 'error-source-in-sitemap' END], lambda x: x IS NOT NULL), ',') AS codes FROM v WHERE ssm <> ''""",
)
def sitemap_issues(spark, sf_dir):
    pages = stored(_sitemap_pages(spark, sf_dir))
    found = SM.sitemap_membership(pages, SM.sitemap_entries(sitemap_texts(spark, sf_dir))).where("source_found")
    return SM.sitemap_issues(found.join(pages, "page_id")).select("page_id", F.array_join("sitemap_issues", ",").alias("codes"))


# --- hreflang ---

_TAGS = """
ht AS (SELECT p, u, idx, href, CASE WHEN lower(tag) = 'x-default' THEN 'x-default' ELSE tag END AS tag FROM hl)"""


@query(
    "hreflang_local",
    f"""WITH {HREFLANG_SQL}, {_TAGS} SELECT p AS page_id, 'invalid-tag' AS code, 'english_1' AS tag FROM s WHERE p % 9 = 0
        UNION ALL SELECT p, 'duplicate-tag', tag FROM ht GROUP BY p, tag HAVING count(*) > 1
        UNION ALL SELECT p, 'missing-self', '' FROM ht GROUP BY p, u HAVING count(*) FILTER (WHERE href = u AND tag <> 'x-default') = 0
        UNION ALL SELECT p, 'missing-x-default', '' FROM ht GROUP BY p HAVING count(*) FILTER (WHERE tag = 'x-default') = 0
        UNION ALL SELECT p, 'duplicate-x-default', '' FROM ht GROUP BY p HAVING count(*) FILTER (WHERE tag = 'x-default') > 1""",
)
def hreflang_local(spark, sf_dir):
    return H.hreflang_local(X.hreflang(seeded_pages(spark, sf_dir)))


HT_SQL = f"""{_TAGS},
tg AS (
  SELECT a.p, a.idx, a.tag, a.href, coalesce(t.status, 0) AS status, coalesce(t.hops > 0, false) AS redirected, CASE WHEN t.p % 29 = 7 THEN 'timeout' ELSE '' END AS error,
    coalesce(t.p % 7 IN (0, 2) OR t.xrobots = 'noindex', false) AS noindex, coalesce(t.canon_href NOT IN ('', t.u), false) AS mismatch,
    CASE WHEN EXISTS (SELECT 1 FROM ht o WHERE o.p = a.p AND o.href = a.u AND o.tag <> 'x-default')
      THEN EXISTS (SELECT 1 FROM ht b WHERE b.u = a.href AND b.href = a.u AND b.tag IN (SELECT o.tag FROM ht o WHERE o.p = a.p AND o.href = a.u AND o.tag <> 'x-default'))
      ELSE EXISTS (SELECT 1 FROM ht b WHERE b.u = a.href AND b.href = a.u) END AS reciprocal
  FROM ht a LEFT JOIN s t ON t.u = a.href),
tl AS (SELECT *, array_to_string(list_filter([CASE WHEN error <> '' THEN error WHEN status = 0 THEN 'network' END, CASE WHEN error = '' AND status >= 400 THEN 'HTTP ' || status END,
    CASE WHEN redirected THEN 'redirect' END, CASE WHEN noindex THEN 'noindex' END, CASE WHEN mismatch THEN 'canonical mismatch' END, CASE WHEN NOT reciprocal THEN 'missing reciprocal' END], lambda x: x IS NOT NULL), ',') AS problems,
    CASE WHEN error <> '' OR status = 0 OR status >= 400 OR noindex THEN 'critical' WHEN redirected OR mismatch OR NOT reciprocal THEN 'warning' ELSE 'ok' END AS level FROM tg)"""


def _targets(spark, sf_dir):
    pages = N.indexability(page_facts(seeded_pages(spark, sf_dir), "canonical", "robots", fetch_log=fetch_log(spark, sf_dir)))
    noindex = F.array_contains("meta_directives", "noindex") | F.array_contains("header_directives", "noindex")
    known = pages.select("page_id", "norm_url", "status", "redirected", "error", noindex.alias("noindex"), "norm_canonical")
    # Both sides are read several times below; pages are parsed once for each.
    return H.hreflang_targets(stored(X.hreflang(seeded_pages(spark, sf_dir))), stored(known))


@query(
    "hreflang_targets",
    f"WITH {HREFLANG_SQL}, {HT_SQL} SELECT p AS page_id, idx, tag, reciprocal, problems, level FROM tl",
)
def hreflang_targets(spark, sf_dir):
    return _targets(spark, sf_dir).select("page_id", "idx", "tag", "reciprocal", F.array_join("problems", ",").alias("problems"), "level")


@query(
    "hreflang_counts",
    f"WITH {HREFLANG_SQL}, {HT_SQL} SELECT p AS page_id, count(*) AS total, count(*) FILTER (WHERE level = 'critical') AS critical, count(*) FILTER (WHERE level = 'warning') AS warning, count(*) FILTER (WHERE level = 'ok') AS ok FROM tl GROUP BY p",
)
def hreflang_counts(spark, sf_dir):
    return H.hreflang_counts(_targets(spark, sf_dir))


# --- canonical chains ---


@query(
    "canonical_chain",
    f"""WITH {SEED_SQL}, w AS (SELECT s.*, t.p AS tp, t.status AS tstatus, t.hops AS thops, t.canon_count AS tcount, t.canon_href AS tcanon FROM s LEFT JOIN s t ON t.u = s.canon_href WHERE s.canon_href <> '')
        SELECT p AS page_id, CASE WHEN canon_href = u THEN 1 ELSE 2 END AS path_length, 1 AS levels, coalesce(thops, 0)::INT AS redirect_hops, coalesce(tstatus, 0)::INT AS final_status,
          (tp IS NOT NULL AND tp % 29 <> 7 AND tstatus BETWEEN 1 AND 399 AND tcanon = canon_href) AS stable,
          array_to_string(list_filter([CASE WHEN tp IS NULL OR tp % 29 = 7 THEN 'network-error' WHEN tstatus >= 500 THEN 'http-5xx' WHEN tstatus >= 400 THEN 'http-4xx' END,
            CASE WHEN tcount > 1 THEN 'multiple-canonical' END, CASE WHEN tp % 34 IN (2, 19) THEN 'redirect-loop' END, CASE WHEN thops > 0 THEN 'canonical-redirect' END], lambda x: x IS NOT NULL), ',') AS codes FROM w
        WHERE p % 5 <> 4 OR tp IS NULL OR tp = p""",
)
def canonical_chain(spark, sf_dir):
    facts = page_facts(seeded_pages(spark, sf_dir), "canonical", fetch_log=fetch_log(spark, sf_dir)).drop("norm_url")
    facts = facts.withColumns(N.comparable_urls())
    pages = facts.select(
        "page_id", "norm_url", "norm_canonical", F.col("canonical.count").alias("canonical_count"), "status", "redirected",
        F.col("final_url").alias("fetched"), "redirect_chain", "error",
    )
    hops = F.transform("redirect_chain", lambda h: F.struct(U.normalize_url(h["from"]).alias("from"), U.normalize_url(h["to"]).alias("to")))
    pages = pages.withColumns({"redirects": hops, "final_url": F.col("fetched")}).drop("redirect_chain", "fetched")
    c = canonicals.canonical_chain(canonicals.canonical_walk(pages, own=True))
    return c.select("page_id", F.size("path").alias("path_length"), "levels", "redirect_hops", "final_status", "stable", F.array_join("codes", ",").alias("codes"))


_NEXT = "CASE WHEN p % 9 = 0 THEN p WHEN p % 7 = 0 AND p >= 3 THEN p - 3 WHEN p % 11 = 5 THEN NULL ELSE p + 1 END"


@query(
    "canonical_walk",
    f"""WITH RECURSIVE {SEED_SQL}, n AS (SELECT p, u, {_NEXT} AS q, CASE WHEN p % 13 = 6 THEN 404 ELSE 200 END AS st FROM s),
        e AS (SELECT n.p, n.u, n.st, (SELECT min(o.p) FROM n o WHERE o.u = t.u) AS q FROM n LEFT JOIN n t ON t.p = n.q),
        w AS (SELECT p AS start, q AS at, [(SELECT min(o.p) FROM n o WHERE o.u = e.u)] AS visited, 0 AS lv, true AS going, false AS loop FROM e WHERE q IS NOT NULL
          UNION ALL
          SELECT start, CASE WHEN e.st >= 400 OR e.q IS NULL OR e.q = w.at OR list_contains(list_append(visited, w.at), e.q) THEN w.at ELSE e.q END, list_append(visited, w.at), lv + 1,
            NOT (e.st >= 400 OR e.q IS NULL OR e.q = w.at OR list_contains(list_append(visited, w.at), e.q)), e.st < 400 AND e.q IS NOT NULL AND e.q <> w.at AND list_contains(list_append(visited, w.at), e.q)
          FROM w JOIN e ON e.p = w.at WHERE going AND lv < 5)
        SELECT start AS page_id, max(lv)::INT AS levels, bool_or(loop) AS loop, arg_max(going, lv) AS capped FROM w GROUP BY start""",
)
def canonical_walk(spark, sf_dir):
    urls = keys(spark, sf_dir).select("page_id", F.regexp_replace("url", "#.*$", "").alias("u"))
    p = F.col("page_id")
    follow = (
        F.when(p % 9 == 0, p).when((p % 7 == 0) & (p >= 3), p - 3).when(p % 11 == 5, F.lit(None)).otherwise(p + 1)
    )
    target = urls.select(F.col("page_id").alias("q"), F.col("u").alias("norm_canonical"))
    pages = urls.withColumn("q", follow).join(target, "q", "left").select(
        "page_id", F.col("u").alias("norm_url"), F.coalesce("norm_canonical", F.lit("")).alias("norm_canonical"),
        F.lit(1).alias("canonical_count"), F.when(p % 13 == 6, 404).otherwise(200).alias("status"), F.lit(False).alias("redirected"),
        F.lit(0).alias("hops"), F.lit("").alias("error"),
    )
    return canonicals.canonical_walk(pages).select("page_id", F.size("levels").alias("levels"), "loop", "capped")


# --- hosts as browsers write them ---

# A host as it may stand in a link, and its serialised form (values of the URL standard).
_HOSTS = [
    ("MÜNCHEN.example", "xn--mnchen-3ya.example"), ("faß.example", "xn--fa-hia.example"), ("例え。テスト", "xn--r8jz45g.xn--zckzah"), ("m%C3%BCnchen.example", "xn--mnchen-3ya.example"),
    ("0x7f.1", "127.0.0.1"), ("2130706433", "127.0.0.1"), ("0300.0250.1", "192.168.0.1"), ("[0:0::1]", "[::1]"), ("[2001:DB8:0:0:8:0:0:C]", "[2001:db8::8:0:0:c]"), ("[::FFFF:1.2.3.4]", "[::ffff:102:304]"), ("Plain.example:443", "plain.example"),
]
_HOST_ROWS = ", ".join(f"({i}, '{w}', '{h}')" for i, (w, h) in enumerate(_HOSTS))


@query(
    "browser_hosts",
    f"""WITH h(i, written, host) AS (VALUES {_HOST_ROWS}), l AS (SELECT page_id, host, page_id % {len(_HOSTS)} AS i FROM pages JOIN h ON i = page_id % {len(_HOSTS)}),
        t AS (SELECT DISTINCT host FROM h)
        SELECT 'https://' || host || '/' AS url, host, count(*) AS links, min(page_id) AS first_page, count(DISTINCT i) AS spellings FROM t JOIN l USING (host) GROUP BY host""",
)
def browser_hosts(spark, sf_dir):
    """Links that write hosts in odd ways, joined with pages under their serialised URL."""
    forms = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(_HOSTS)], "i long, written string, host string")
    linking = keys(spark, sf_dir).withColumn("i", F.col("page_id") % len(_HOSTS)).join(forms, "i")
    html = F.concat(F.lit('<a href="https://'), "written", F.lit('/">x</a>'))
    found = X.links(linking.select("page_id", "url", html.alias("html"))).select("page_id", "norm", "raw_href")
    targets = forms.select(F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"), "host").distinct()
    rows = targets.join(found, F.col("url") == F.col("norm"))
    return rows.groupBy("url", "host").agg(F.count("*").alias("links"), F.min("page_id").alias("first_page"), F.countDistinct("raw_href").alias("spellings"))


# --- SQL functions ---


@query(
    "sql_functions",
    f"""WITH {LINKS_SQL}, c AS (SELECT s.p, s.host AS host, count(*) FILTER (kind = 'http') AS links, count(*) FILTER (kind = 'http' AND href LIKE '%/list?%') AS lists, count(*) FILTER (kind <> 'http') AS others FROM s JOIN lk ON lk.p = s.p GROUP BY s.p, s.host)
        SELECT host, count(*) AS pages, sum(links)::BIGINT AS links, sum(lists)::BIGINT AS filtered, sum(others)::BIGINT AS others FROM c GROUP BY host""",
)
def sql_functions(spark, sf_dir):
    """Plain SQL over the pages, with the library's functions.

    Taken apart as a bare column, the links would be filtered by their number first, with a second reading of each page.
    """
    register(spark)
    seeded_pages(spark, sf_dir).createOrReplaceTempView("seeded_pages_")
    return spark.sql("""
        SELECT url_host(url) AS host, count(DISTINCT page_id) AS pages, count_if(kind = 'http') AS links,
          count_if(kind = 'http' AND classify_param(regexp_extract(normalize_url(href), '[?]([^=]*)=', 1)) = 'filter') AS filtered, count_if(kind <> 'http') AS others
        FROM (SELECT page_id, url, inline(coalesce(links, array())) FROM (SELECT page_id, url, page_links(url, html) AS links FROM seeded_pages_))
        GROUP BY url_host(url)""")


# --- crawl ---


def _edges(spark, sf_dir):
    links = _links(spark, sf_dir).where("kind = 'http' AND norm <> ''")
    source = F.regexp_replace("page_url", "#.*$", "").alias("source")
    return links.groupBy(source, F.col("norm").alias("url")).agg(F.min("idx").alias("idx"))


@query(
    "discover_links",
    f"WITH {LINKS_SQL} SELECT p AS page_id, count(DISTINCT href) AS urls FROM lk WHERE {_HTTP} GROUP BY p",
)
def discover_links(spark, sf_dir):
    rows = crawling.discover_links(_links(spark, sf_dir), same_host=False)
    return rows.groupBy("page_id").agg(F.count("*").alias("urls"))


@query(
    "crawl",
    f"""WITH {SEED_SQL}, d AS (SELECT p, u, CASE WHEN p % 10 = 0 THEN 0 WHEN ((p - 1) // 2) % 10 = 0 THEN 1 WHEN p >= 3 AND ((((p - 1) // 2) - 1) // 2) % 10 = 0 THEN 2
          WHEN p >= 7 AND ((((((p - 1) // 2) - 1) // 2) - 1) // 2) % 10 = 0 THEN 3 END AS depth FROM s)
        SELECT d.u AS url, CASE WHEN d.depth = 0 THEN '' ELSE par.u END AS source, d.depth::INT AS depth, d.depth = 3 AND EXISTS (SELECT 1 FROM d c WHERE c.p IN (2 * d.p + 1, 2 * d.p + 2) AND c.depth IS NULL) AS capped
        FROM d LEFT JOIN d par ON par.p = (d.p - 1) // 2 WHERE d.depth IS NOT NULL""",
)
def crawl(spark, sf_dir):
    pages = keys(spark, sf_dir).select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"))
    return crawling.crawl(_edges(spark, sf_dir), pages.where("page_id % 10 = 0"), depth_limit=3, known=pages).drop("rank")


@query(
    "next_frontier",
    f"""WITH {LINKS_SQL} SELECT href AS url, arg_min(p, (p, idx)) AS source FROM lk WHERE {_HTTP} AND href NOT IN (SELECT u FROM s WHERE p % 3 = 0) AND href IN (SELECT u FROM s) GROUP BY href""",
)
def next_frontier(spark, sf_dir):
    pages = keys(spark, sf_dir).select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"))
    links = _links(spark, sf_dir).where("kind = 'http' AND norm <> ''")
    found = links.select(F.col("norm").alias("url"), F.col("page_id").alias("source"), F.col("page_id").alias("rank"), "idx")
    found = found.join(pages.select("url"), "url", "left_semi")
    return crawling.next_frontier(found, pages.where("page_id % 3 = 0"), None).select("url", "source")
