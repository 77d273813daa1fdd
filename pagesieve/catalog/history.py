"""Comparison, snapshot and regression queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compare as CP
from ..operators import issues as I
from ..operators import regression as R
from ..operators import security as SEC
from ..operators import snapshots as SN
from ..plans.audit import page_reports, stored
from ..session import checkpoint_dir
from ..operators.audit_table import annotate_duplicates, duplicate_groups
from ..operators.pagetype import LABELS
from ..sources.io import (
    AUDIT_COLUMNS, CRAWL_COLUMNS, issue_text, read_profiles, read_snapshots, usable_pages, write_audit_csv, write_audit_json, write_crawl_csv, write_reports, write_snapshots,
)
from .audits import _LONG, AUDIT_SQL, NODES_SQL, _rows
from .facts import LINKS_SQL
from .media import _H
from .pages import CHECKS, ISSUES_SQL, MESSAGE, MESSAGES_SQL, SCORES, TITLES, TYPE_SQL, VERDICT, _evaluated
from .registry import keys, query, table
from .seed import BASE_SQL, SEED_SQL, fetch_log, seeded_pages


def _reports(spark, sf_dir, *extra):
    return page_reports(seeded_pages(spark, sf_dir), fetch_log(spark, sf_dir), extra, typed=False)


# The twelve fields of every seeded page's snapshot, as text.
DIFF_SQL = (
    AUDIT_SQL
    + LINKS_SQL[len(SEED_SQL):]
    + f""",
{NODES_SQL.strip()},
hs AS (SELECT p, 0 AS o, 1 AS level, h1 AS text FROM ar UNION ALL SELECT p, 1, 2, 'Sub' FROM s WHERE p % 3 = 0 UNION ALL SELECT p, 2, 4, 'Deep' FROM s WHERE p % 3 = 1
  UNION ALL SELECT p, 3, 1, 'Second' FROM s WHERE p % 13 = 0 UNION ALL SELECT p, 4, 3, '' FROM s WHERE p % 17 = 0),
cell AS (
  SELECT p, 'title' AS field, title AS v FROM ar UNION ALL SELECT p, 'description', description FROM ar UNION ALL SELECT p, 'canonical', canonical FROM ar
  UNION ALL SELECT p, 'robots', robots FROM s UNION ALL SELECT p, 'h1', string_agg(text, '|' ORDER BY o) FILTER (level = 1) FROM hs GROUP BY p
  UNION ALL SELECT p, 'headingCount', count(*)::VARCHAR FROM hs GROUP BY p
  UNION ALL SELECT s.p, 'linkCount', count(lk.p)::VARCHAR FROM s LEFT JOIN lk ON lk.p = s.p GROUP BY s.p
  UNION ALL SELECT p, 'imageCount', (p % 3)::VARCHAR FROM s
  UNION ALL SELECT s.p, 'schemaTypes', coalesce(string_agg(type, ',' ORDER BY type), '') FROM s LEFT JOIN nd ON nd.p = s.p GROUP BY s.p
  UNION ALL SELECT s.p, 'hreflangCount', count(hl.p)::VARCHAR FROM s LEFT JOIN hl ON hl.p = s.p GROUP BY s.p
  UNION ALL SELECT p, 'score', score::INT::VARCHAR FROM ar
  UNION ALL SELECT s.p, 'issueIds', coalesce(string_agg(id, ',' ORDER BY id), '') FROM s LEFT JOIN iss ON iss.p = s.p GROUP BY s.p)"""
)


# --- page comparison: each even page with the next one ---


def _summaries(spark, sf_dir):
    return stored(CP.compare_summary(SEC.security_headers(_reports(spark, sf_dir, "page_url"))))


def _pairs(spark, sf_dir):
    pages = keys(spark, sf_dir).where("page_id % 2 = 0")
    return pages.select(F.col("page_id").alias("pair_id"), F.col("page_id").alias("left_id"), (F.col("page_id") + 1).alias("right_id"))


COMPARE_SQL = (
    DIFF_SQL
    + """,
""" + _H.strip() + """,
lc AS (SELECT s.p, count(lk.p) FILTER (kind = 'http') AS http, count(*) FILTER (internal) AS inside, count(*) FILTER (kind = 'http' AND nofollow) AS nofollow,
         count(*) FILTER (kind = 'http' AND sponsored) AS sponsored, count(*) FILTER (kind = 'http' AND ugc) AS ugc FROM s LEFT JOIN lk ON lk.p = s.p GROUP BY s.p),
cv AS (SELECT p, field, coalesce(nullif(v, ''), '—') AS v FROM (
  SELECT p, 'HTTP status' AS field, status::VARCHAR AS v FROM ar UNION ALL SELECT p, 'Indexability', verdict FROM ar UNION ALL SELECT p, 'Total issues', n::VARCHAR FROM ar
  UNION ALL SELECT p, 'Critical issues', critical::VARCHAR FROM ar UNION ALL SELECT p, 'Warnings', warning::VARCHAR FROM ar UNION ALL SELECT p, 'X-Robots-Tag', xrobots FROM s
  UNION ALL SELECT p, 'Missing alt', (p % 2 = 1 AND p % 3 > 0)::INT::VARCHAR FROM s UNION ALL SELECT p, 'Invalid JSON-LD', (p % 16 = 3)::INT::VARCHAR FROM s
  UNION ALL SELECT p, 'Internal HTTP links', inside::VARCHAR FROM lc UNION ALL SELECT p, 'External HTTP links', (http - inside)::VARCHAR FROM lc
  UNION ALL SELECT p, 'nofollow links', nofollow::VARCHAR FROM lc UNION ALL SELECT p, 'sponsored links', sponsored::VARCHAR FROM lc UNION ALL SELECT p, 'UGC links', ugc::VARCHAR FROM lc
  UNION ALL SELECT p, CASE field WHEN 'title' THEN 'Title' WHEN 'description' THEN 'Description' WHEN 'canonical' THEN 'Canonical' WHEN 'robots' THEN 'Robots' WHEN 'headingCount' THEN 'Heading count' WHEN 'linkCount' THEN 'Total links' WHEN 'imageCount' THEN 'Total images' WHEN 'hreflangCount' THEN 'Hreflang count' WHEN 'score' THEN 'SEO score' WHEN 'schemaTypes' THEN 'Schema types' WHEN 'issueIds' THEN 'Issue IDs' END,
    CASE WHEN field IN ('schemaTypes', 'issueIds') THEN replace(v, ',', chr(10)) ELSE v END FROM cell WHERE field <> 'h1'
  UNION ALL SELECT p, 'H1', string_agg(text, chr(10) ORDER BY o) FILTER (level = 1) FROM hs GROUP BY p
  UNION ALL SELECT p, 'URL', url FROM s UNION ALL SELECT p, 'Missing dimensions', (CASE WHEN p % 5 = 0 THEN 0 ELSE p % 3 END)::VARCHAR FROM s
  UNION ALL SELECT p, 'Image sources', array_to_string(list_transform(range(0, p % 3), lambda i: origin || '/img/' || p || '-' || i || '.png'), chr(10)) FROM s
  UNION ALL SELECT s.p, 'HTTP targets', array_to_string(list_sort(list(DISTINCT array_to_string(list_transform(string_split(href, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x00-\\x7f]') THEN url_encode(c) ELSE c END), '')) FILTER (kind = 'http')), chr(10)) FROM s LEFT JOIN lk ON lk.p = s.p GROUP BY s.p
  UNION ALL SELECT p, 'Outline', string_agg(trim('H' || level || ' ' || text), chr(10) ORDER BY o) FROM hs GROUP BY p
  UNION ALL SELECT s.p, 'Declarations', string_agg(lower(tag) || ' → ' || href, chr(10) ORDER BY lower(tag) || ' → ' || href) FROM s LEFT JOIN hl ON hl.p = s.p GROUP BY s.p
  UNION ALL SELECT p, 'Content-Type', 'text/html; charset=utf-8' FROM s UNION ALL SELECT p, 'Cache-Control', '' FROM s
  UNION ALL SELECT p, 'Content-Language', CASE p % 4 WHEN 0 THEN 'de, en' WHEN 1 THEN 'en-US;q=1' ELSE '' END FROM s
  UNION ALL SELECT p, CASE key WHEN 'csp' THEN 'Content-Security-Policy' WHEN 'hsts' THEN 'Strict-Transport-Security' WHEN 'xfo' THEN 'X-Frame-Options' WHEN 'referrer' THEN 'Referrer-Policy' WHEN 'permissions' THEN 'Permissions-Policy' ELSE 'X-Content-Type-Options' END,
    state || coalesce(' · ' || CASE key WHEN 'csp' THEN CASE p % 6 WHEN 0 THEN 'default-src ''self''; script-src * ''unsafe-eval''' WHEN 1 THEN 'default-src ''self''; frame-ancestors ''none''' END
      WHEN 'hsts' THEN CASE p % 5 WHEN 0 THEN 'max-age=31536000; includeSubDomains' WHEN 1 THEN 'max-age=0' END WHEN 'xfo' THEN CASE p % 7 WHEN 0 THEN 'DENY' WHEN 1 THEN 'ALLOWALL' END
      WHEN 'referrer' THEN CASE p % 3 WHEN 0 THEN 'strict-origin' WHEN 1 THEN 'no-referrer, unsafe-url' END WHEN 'permissions' THEN CASE p % 2 WHEN 0 THEN 'geolocation=()' END
      ELSE CASE p % 4 WHEN 0 THEN 'nosniff' WHEN 1 THEN 'none' END END, '') FROM hr))"""
)


@query(
    "compare_pages",
    f"""WITH {COMPARE_SQL} SELECT l.p AS pair_id, l.field, l.v AS "left", r.v AS "right", l.v = r.v AS equal FROM cv l JOIN cv r ON r.p = l.p + 1 AND r.field = l.field WHERE l.p % 2 = 0""",
)
def compare_pages(spark, sf_dir):
    rows = CP.compare_pages(_summaries(spark, sf_dir), _pairs(spark, sf_dir))
    return rows.select("pair_id", "field", "left", "right", "equal")


@query("compare_rows", "SELECT page_id AS pair_id, 40::BIGINT AS rows FROM pages WHERE page_id % 2 = 0")
def compare_rows(spark, sf_dir):
    rows = CP.compare_pages(_summaries(spark, sf_dir), _pairs(spark, sf_dir))
    return CP.compare_counts(rows).select("pair_id", "rows")


# --- snapshots of the seeded pages ---


@query(
    "make_snapshots",
    f"""WITH {AUDIT_SQL}, {NODES_SQL} SELECT s.p AS page_id, s.u AS url, ar.title, s.canon_href AS canonical, s.robots, ar.score::INT AS score, ar.verdict, s.status::INT AS status, (s.p % 3)::INT AS images_total,
        (s.p % 2 = 1 AND s.p % 3 > 0)::INT AS images_missing_alt, (s.p % 16 = 3)::INT AS schema_invalid, coalesce((SELECT string_agg(type, ',' ORDER BY type) FROM nd WHERE nd.p = s.p), '') AS schema_types,
        coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM iss WHERE iss.p = s.p), '') AS issue_ids FROM s JOIN ar ON ar.p = s.p""",
)
def make_snapshots(spark, sf_dir):
    s = SN.make_snapshots(_reports(spark, sf_dir, "dom"))
    f = lambda n: F.col(f"snapshot.{n}")
    return s.select(
        "page_id", "url", f("title"), f("canonical"), F.array_join(f("robots"), ",").alias("robots"), f("score"), f("verdict"), f("status"),
        f("images_total"), f("images_missing_alt"), f("schema_invalid"), F.array_join(f("schema_types"), ",").alias("schema_types"),
        F.array_join(f("issue_ids"), ",").alias("issue_ids"),
    )


@query(
    "snapshot_diff",
    f"""WITH {DIFF_SQL} SELECT 'page ' || b.p AS url, b.field, b.v AS before, a.v AS after FROM cell b JOIN cell a ON a.p = b.p + 1 AND a.field = b.field WHERE a.v <> b.v""",
)
def snapshot_diff(spark, sf_dir):
    """Each page against the next one, as two versions of one page."""
    s = stored(SN.make_snapshots(_reports(spark, sf_dir, "dom")).select("page_id", "snapshot"))
    named = lambda k: s.select(F.concat(F.lit("page "), (F.col("page_id") - k).cast("string")).alias("url"), "snapshot")
    return SN.snapshot_diff(named(0), named(1))


# --- history from the orders table: one page per 40 customers, one snapshot per order ---


def history(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    url = F.concat(F.lit("https://shop.example.com/c/"), (F.col("o_custkey") % 40).cast("string"))
    return o.select(
        url.alias("url"), F.col("o_orderkey").cast("string").alias("id"), F.lit("Snapshot").alias("name"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.struct(F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("title")).alias("snapshot"),
    )


_HIST = """
h AS (SELECT 'https://shop.example.com/c/' || (o_custkey % 40) AS url, o_orderkey AS k, o_orderkey::VARCHAR AS id, o_orderdate AS created_at, o_totalprice AS price FROM orders)"""
_RANK = "row_number() OVER (PARTITION BY url ORDER BY created_at DESC, id)"


@query(
    "append_snapshots",
    f"WITH {_HIST} SELECT url, id FROM (SELECT url, id, {_RANK} AS rn FROM h) WHERE rn <= 50",
)
def append_snapshots(spark, sf_dir):
    h = history(spark, sf_dir)
    k = F.col("id").try_cast("bigint")
    return SN.append_snapshots(h.where(k % 3 != 0), h.where(k % 2 == 1).unionByName(h.where((k % 2 == 0) & (k % 3 == 0)))).select("url", "id")


@query(
    "merge_snapshots",
    f"WITH {_HIST} SELECT url, id, k % 3 = 0 AS imported FROM (SELECT *, {_RANK} AS rn FROM h) WHERE rn <= 50",
)
def merge_snapshots(spark, sf_dir):
    h = history(spark, sf_dir)
    k = F.col("id").try_cast("bigint")
    incoming = h.withColumn("name", F.lit("Imported"))
    rows = SN.merge_snapshots(h.where(k % 3 != 0), incoming)
    return rows.select("url", "id", (F.col("name") == "Imported").alias("imported"))


@query("delete_snapshots", f"WITH {_HIST} SELECT url, id FROM h WHERE k % 5 <> 0")
def delete_snapshots(spark, sf_dir):
    h = history(spark, sf_dir)
    return SN.delete_snapshots(h, h.where(F.col("id").try_cast("bigint") % 5 == 0)).select("url", "id")


@query(
    "import_legacy",
    f"""WITH {_HIST}, l AS (SELECT url, 'legacy-' || id AS id, created_at FROM h WHERE k % 7 = 0), x AS (SELECT url, id, created_at FROM h WHERE k % 2 = 0 UNION ALL SELECT url, id, created_at FROM l WHERE id NOT IN (SELECT 'legacy-' || id FROM h WHERE k % 2 = 0))
        SELECT url, id FROM (SELECT url, id, {_RANK} AS rn FROM x) WHERE rn <= 50""",
)
def import_legacy(spark, sf_dir):
    h = history(spark, sf_dir)
    k = F.col("id").try_cast("bigint")
    legacy = h.where(k % 7 == 0).withColumn("id", F.concat(F.lit("legacy-"), F.col("id")))
    return SN.import_legacy(h.where(k % 2 == 0), legacy).select("url", "id")


@query(
    "set_baselines",
    f"""WITH {_HIST}, c AS (SELECT DISTINCT url, split_part(url, '/c/', 2)::INT AS c FROM h), f AS (SELECT url, min(k)::VARCHAR AS first, max(k)::VARCHAR AS last FROM h GROUP BY url)
        SELECT url, CASE c % 3 WHEN 0 THEN last ELSE first END AS baseline_id FROM c JOIN f USING (url) WHERE c % 3 <> 2""",
)
def set_baselines(spark, sf_dir):
    h = history(spark, sf_dir)
    k, n = F.col("id").try_cast("bigint"), F.regexp_extract("url", r"/c/(\d+)", 1).cast("int")
    ends = h.groupBy("url").agg(F.min(k).cast("string").alias("first"), F.max(k).cast("string").alias("last"))
    old = ends.select("url", F.col("first").alias("baseline_id"))
    wish = F.when(n % 3 == 0, F.col("last")).when(n % 3 == 1, F.lit("no such id")).otherwise(F.lit(""))
    return SN.set_baselines(h, old, ends.select("url", wish.alias("baseline_id")))


@query(
    "baseline_for",
    f"WITH {_HIST} SELECT url, arg_min(id, k) AS id, arg_min(price, k) AS price FROM h GROUP BY url",
)
def baseline_for(spark, sf_dir):
    h = history(spark, sf_dir)
    first = h.groupBy("url").agg(F.min(F.col("id").try_cast("bigint")).cast("string").alias("baseline_id"))
    return SN.baseline_for(h, first).select("url", "id", F.col("snapshot.score").alias("price"))


@query(
    "sanitize_snapshots",
    """WITH r AS (SELECT o_orderkey AS k, 'https://shop.example.com/c/' || (o_custkey % 40) AS url, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 5 ELSE o_orderkey END AS i, o_orderdate FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0),
       f AS (SELECT url, 's' || i AS id, min(k) AS k FROM r GROUP BY ALL) SELECT url, id, CASE WHEN k % 2 = 0 THEN 'Snapshot' ELSE 'My ' || k END AS name FROM f""",
)
def sanitize_snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    url = F.concat(F.lit("https://shop.example.com/c/"), (F.col("o_custkey") % 40).cast("string"), F.lit("#top"))
    raw = o.select(
        F.when(k % 11 == 0, "ftp://x/y").otherwise(url).alias("url"), k.alias("position"),
        F.concat(F.lit(" s"), F.when(k % 4 == 0, F.col("o_custkey") % 5).otherwise(k).cast("string")).alias("id"),
        F.when(k % 2 == 0, "   ").otherwise(F.concat(F.lit(" My   "), k.cast("string"))).alias("name"),
        F.when(k % 13 == 0, "not a date").otherwise(F.col("o_orderdate").cast("string")).alias("created_at"),
        F.lit(None).cast("string").alias("saved_at"), F.when(k % 17 != 0, F.struct(F.col("o_totalprice").alias("score"))).alias("snapshot"),
    )
    return SN.sanitize_snapshots(raw).select("url", "id", "name")


# --- regressions: odd and even lines of an order are two versions of a page ---


HEADERS = ["csp", "hsts", "xfo", "referrer", "permissions", "xcto"]


def versions(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    c, lit = F.col, F.lit
    n = F.count("*")
    agg = l.groupBy(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") % 2).alias("v")).agg(
        n.alias("n"), F.min("l_suppkey").alias("supp"), F.sum("l_quantity").alias("q"), F.max("l_discount").alias("disc"), F.min("l_tax").alias("tax"),
        F.min("l_returnflag").alias("flag"), F.sum("l_linenumber").alias("ln"), F.min("l_linestatus").alias("ls"),
        F.count_if(F.col("l_discount") > 0.07).alias("hi"), F.count_if(F.col("l_tax") > 0.05).alias("taxed"),
    )
    none = F.array().cast("array<string>")
    mod = lambda k: (c("supp") % k).cast("string")
    one = lambda tag, k: F.array(F.concat(lit(tag), mod(k)))
    state = lambda i: F.element_at(F.array(lit("present"), lit("review"), lit("missing")), ((c("supp") + i) % 3 + 1).cast("int"))
    old_images = c("supp") % 9 == 0
    known = lambda v: F.when(~old_images, v)
    fields = {
        "title": F.when(c("n") == 1, "").otherwise(F.concat(lit("T"), mod(3))),
        "description": F.when(c("q") > 50, "").otherwise("d"),
        "canonical": F.when(c("disc") > 0.05, "c").otherwise(""),
        "robots": F.when(c("tax") == 0, F.array(lit("noindex"))).otherwise(F.array(lit("index"))),
        "h1": F.when(c("supp") % 4 == 0, none).otherwise(one("H", 2)), "outline": F.when(c("disc") <= 0.08, one("1:H", 3)), "heading_count": c("n"),
        "links_total": c("n"), "links_checked": c("n"), "links_broken": c("hi"), "links_redirect": c("taxed"),
        "images_total": c("n"), "images_missing_alt": known(c("taxed")), "images_missing_dimensions": known(c("hi")), "images_oversized": known(c("ln")),
        "images_checked": known(c("n")), "images_broken": known(c("hi")),
        "schema_types": one("S", 2), "schema_invalid": c("hi"), "hreflang": F.when(c("supp") % 7 != 0, one("x|", 3)), "hreflang_count": c("n"),
        "status": F.when(c("flag") == "A", 200).when(c("flag") == "N", 404).otherwise(301),
        "x_robots": F.when(c("taxed") > 1, F.array(lit("noindex"))).otherwise(none), "content_type": one("t", 2), "content_language": one("l", 3), "cache_control": one("a", 5),
        "request_count": c("n") * 12, "total_bytes": (c("q") * 10000).cast("bigint"), "known_sizes": c("n"), "third_party_requests": c("n") * 5,
        "third_party_bytes": (c("q") * 9000).cast("bigint"), "dom_nodes": c("ln") * 60, "dom_depth": c("n") * 3, "ttfb": c("q") * 30, "load": c("q") * 200,
        "https": c("ls") == "O", "mixed_active": c("hi"), "mixed_passive": c("taxed"),
        "headers": F.map_from_arrays(F.array(*map(lit, HEADERS)), F.array(*[F.struct(state(i).alias("state"), lit("").alias("value")) for i in range(len(HEADERS))])),
        "score": (100 - c("n") * 7), "verdict": F.when(c("tax") == 0, "Noindex").otherwise("Indexable"), "indexable": c("tax") != 0,
        "reasons": F.array(F.concat(lit("r"), c("flag"))),
    }
    rows = agg.select(
        F.concat(F.lit("https://shop.example.com/o/"), c("o").cast("string")).alias("url"), "v", F.struct(*[x.alias(k) for k, x in fields.items()]).alias("snapshot")
    )
    return rows.where("v = 1").drop("v"), rows.where("v = 0").drop("v")


def _change_sql() -> str:
    """SELECTs of (o, id, direction, severity) over the pairs ``z`` of versions b and a."""
    out = []

    def add(id_, cond, direction="'changed'", severity="'info'"):
        out.append(f"SELECT o, {id_ if id_.startswith(chr(39)) else repr(id_)} AS id, {direction} AS direction, {severity} AS severity FROM z WHERE {cond}")

    def graded(id_, cond, worse, better="true", bad="warning", good="info"):
        add(id_, cond, f"CASE WHEN {worse} THEN 'regression' WHEN {better} THEN 'improvement' ELSE 'changed' END", f"CASE WHEN {worse} THEN '{bad}' ELSE '{good}' END")

    def counted(id_, f, bad, extra="true"):
        graded(id_, f"a.{f} <> b.{f} AND {extra}", f"a.{f} > b.{f}", bad=bad)

    images = "a.supp % 9 <> 0 AND b.supp % 9 <> 0"
    graded("metadata.title", "a.title <> b.title", "a.title = ''", "b.title = ''")
    graded("metadata.description", "a.description <> b.description", "a.description = ''")
    graded("canonical.url", "a.canonical <> b.canonical", "a.canonical = ''", "false")
    graded("indexability.robots", "a.ni <> b.ni", "a.ni", bad="critical")
    graded("indexability.verdict", "a.ni <> b.ni", "a.ni", bad="critical", good="warning")
    add("indexability.reasons", "a.flag <> b.flag")
    graded("headings.h1", "a.h1 <> b.h1", "a.h1 = ''", "false")
    add("headings.structure", "a.outline <> b.outline")
    add("headings.count", "(a.outline IS NULL OR b.outline IS NULL) AND a.n <> b.n")
    add("links.count", "a.n <> b.n")
    counted("links.broken", "hi", "critical")
    counted("links.redirect", "taxed", "warning")
    counted("images.missingAlt", "taxed", "warning", images)
    add("images.count", f"NOT ({images}) AND a.n <> b.n")
    counted("images.missingDimensions", "hi", "warning", images)
    counted("images.oversized", "ln", "warning", images)
    counted("images.broken", "hi", "critical", images)
    add("schema.types", "a.supp % 2 <> b.supp % 2")
    counted("schema.invalid", "hi", "critical")
    add("hreflang.entries", "a.hl <> b.hl", severity="'warning'")
    add("hreflang.count", "(a.hl IS NULL OR b.hl IS NULL) AND a.n <> b.n")
    graded("http.status", "a.status <> b.status", "b.status < 400 AND a.status >= 400", "b.status >= 400 AND a.status < 400", bad="critical")
    graded("http.x-robots-tag", "(a.taxed > 1) <> (b.taxed > 1)", "a.taxed > 1", "false", bad="critical")
    add("http.content-type", "a.supp % 2 <> b.supp % 2")
    add("http.content-language", "a.supp % 3 <> b.supp % 3")
    add("http.cache-control", "a.supp % 5 <> b.supp % 5")
    metrics = [("request_count", "n * 12", 10), ("total_bytes", "q * 10000", 102400), ("third_party_requests", "n * 5", 5), ("third_party_bytes", "q * 9000", 102400),
               ("dom_nodes", "ln * 60", 100), ("dom_depth", "n * 3", 5), ("ttfb", "q * 30", 100), ("load", "q * 200", 500)]
    for id_, f, least in metrics:
        x, y = (f"({v}.{f})::DOUBLE" for v in "ab")
        graded(f"performance.{id_}", f"abs({x} - {y}) >= {least} AND abs({x} - {y}) / {y} >= 0.2", f"{x} > {y}")
    graded("security.https", "a.https <> b.https", "b.https", bad="critical")
    counted("security.mixed-active", "hi", "critical")
    counted("security.mixed-passive", "taxed", "warning")
    for i, key in enumerate(HEADERS):
        x, y = (f"(2 - ({v}.supp + {i}) % 3)" for v in "ab")
        graded(f"security.header.{key}", f"{x} <> {y}", f"{x} < {y}")
    graded("audit.score", "a.n <> b.n", "a.n > b.n")
    return "\n  UNION ALL ".join(out)


REGRESSION_SQL = f"""
g AS (SELECT l_orderkey AS o, l_linenumber % 2 AS v, count(*) AS n, min(l_suppkey) AS supp, sum(l_quantity) AS q, max(l_discount) AS disc, min(l_tax) AS tax, min(l_returnflag) AS flag, sum(l_linenumber) AS ln, min(l_linestatus) AS ls,
   count(*) FILTER (WHERE l_discount > 0.07) AS hi, count(*) FILTER (WHERE l_tax > 0.05) AS taxed FROM lineitem GROUP BY ALL),
v AS (SELECT *, CASE WHEN n = 1 THEN '' ELSE 'T' || (supp % 3) END AS title, CASE WHEN q > 50 THEN '' ELSE 'd' END AS description, CASE WHEN disc > 0.05 THEN 'c' ELSE '' END AS canonical, tax = 0 AS ni,
   CASE WHEN supp % 4 = 0 THEN '' ELSE 'H' || (supp % 2) END AS h1, CASE WHEN disc <= 0.08 THEN supp % 3 END AS outline, CASE WHEN supp % 7 <> 0 THEN supp % 3 END AS hl,
   CASE flag WHEN 'A' THEN 200 WHEN 'N' THEN 404 ELSE 301 END AS status, ls = 'O' AS https FROM g),
z AS (SELECT b.o, b, a FROM v b JOIN v a ON a.o = b.o AND a.v = 0 WHERE b.v = 1),
ch AS ({_change_sql()})"""


@query("regressions", f"WITH {REGRESSION_SQL} SELECT 'https://shop.example.com/o/' || o AS url, id, direction, severity FROM ch")
def regressions(spark, sf_dir):
    return R.regressions(*versions(spark, sf_dir)).select("url", "id", "direction", "severity")


@query(
    "regression_summary",
    f"""WITH {REGRESSION_SQL} SELECT 'https://shop.example.com/o/' || o AS url, count(*) FILTER (WHERE direction = 'regression') AS regressions, count(*) FILTER (WHERE direction = 'improvement') AS improvements,
        count(*) FILTER (WHERE direction = 'changed') AS changed FROM ch GROUP BY o""",
)
def regression_summary(spark, sf_dir):
    return R.regression_summary(R.regressions(*versions(spark, sf_dir)))


# --- sinks and sources as tables ---


@query("usable_pages", "SELECT page_id, octet_length(encode(html))::INT AS bytes FROM pages WHERE page_id % 4 < 2 AND octet_length(encode(html)) <= 6000")
def usable(spark, sf_dir):
    kinds = F.array(F.lit("text/html; charset=utf-8"), F.lit(""), F.lit("application/pdf"), F.lit("image/png"))
    pages = table(spark, sf_dir, "pages").withColumn("content_type", F.element_at(kinds, (F.col("page_id") % 4 + 1).cast("int")))
    return usable_pages(pages, 6000).select("page_id", F.octet_length("html").alias("bytes"))


@query(
    "issue_text",
    f"""WITH {MESSAGES_SQL}, t AS (SELECT i.p, i.id, severity, {MESSAGE} AS message FROM iss i JOIN s ON s.p = i.p LEFT JOIN rs_ r ON r.p = i.p AND r.id = i.id)
        SELECT p AS page_id, '[' || upper(severity) || '] ' || CASE id {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items())} ELSE 'HTTP ' || (SELECT status FROM s WHERE s.p = t.p) END || ': ' || message AS line FROM t""",
)
def issue_lines(spark, sf_dir):
    rows = I.issue_rows(_evaluated(spark, sf_dir))
    return rows.select("page_id", issue_text(rows).alias("line"))


def _csv_sql(columns, own):
    """All columns of a CSV file as text: those the audit rows have, '' for the rest."""
    return ", ".join(f"coalesce({own[f]}, '') AS \"{h}\"" if f in own else f"'' AS \"{h}\"" for f, h in columns)


_OWN = {"requested_url": "url", "url": "url", "status": "status::VARCHAR", "redirected": "redirected::VARCHAR", "title": "title", "indexability": "verdict",
        "score": "score::VARCHAR", "critical": "critical::VARCHAR", "issue_count": "n::VARCHAR", "available": "'true'", "description": "description", "h1": "h1",
        "canonical": "canonical", "robots": "robots", "warnings": "warning::VARCHAR"}
_LABEL = "CASE primary_ " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
_OWN |= {"page_type": _LABEL, "page_type_confidence": "CASE WHEN points >= 7 THEN 'high' WHEN points >= 4 THEN 'medium' ELSE 'low' END", "page_traits": "CASE WHEN paginated THEN 'Pagination' ELSE '' END",
         "h1_count": "(1 + (p % 13 = 0)::INT)::VARCHAR", "link_count": "coalesce(http_links, 0)::VARCHAR",
         **{f"duplicate_{f}": f"(p IN (SELECT p FROM dl JOIN dg USING (field, key) WHERE field = '{f}'))::VARCHAR" for f in ("title", "description", "h1")}}
_FILE_SQL = f"""{AUDIT_SQL}{TYPE_SQL[len(SEED_SQL):]}{LINKS_SQL[len(SEED_SQL):]}, {_LONG.strip()},
file AS (SELECT ar.*, primary_, points, paginated, http_links FROM ar JOIN (SELECT p, primary_, points, paginated FROM ptp) USING (p) LEFT JOIN (SELECT p, count(*) FILTER (kind = 'http') AS http_links FROM lk GROUP BY p) USING (p))"""


def _written(spark, write, rows, columns, label):
    """The file as read back from disk."""
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    write(rows, path)
    back = spark.read.csv(path, header=True, quote='"', escape='"', lineSep="\r\n", multiLine=True, nullValue=None, emptyValue="")
    if back.columns != [h for _, h in columns]:
        raise ValueError(f"columns of the file: {back.columns}")
    return back.select(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for _, h in columns])


@query("crawl_csv", f"WITH {_FILE_SQL} SELECT {_csv_sql(CRAWL_COLUMNS, _OWN | {'depth': chr(39) + '0' + chr(39)})} FROM file")
def crawl_csv(spark, sf_dir):
    return _written(spark, write_crawl_csv, annotate_duplicates(stored(_rows(spark, sf_dir)), "page_id"), CRAWL_COLUMNS, "crawl-csv")


@query("audit_csv", f"WITH {_FILE_SQL} SELECT {_csv_sql(AUDIT_COLUMNS, _OWN)} FROM file")
def audit_csv(spark, sf_dir):
    return _written(spark, write_audit_csv, annotate_duplicates(stored(_rows(spark, sf_dir)), "page_id"), AUDIT_COLUMNS, "audit-csv")


def _folder(spark, label):
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query(
    "snapshot_files",
    f"WITH {_HIST} SELECT url, id, created_at, price AS score FROM (SELECT *, {_RANK} AS rn FROM h) WHERE rn <= 50",
)
def snapshot_files(spark, sf_dir):
    """The history as exported and imported again."""
    path = _folder(spark, "snapshots")
    write_snapshots(SN.newest(history(spark, sf_dir)), path)
    back = read_snapshots(spark, path, lines=True)
    return back.select("url", "id", F.to_timestamp("created_at").alias("created_at"), F.get_json_object("snapshot", "$.score").cast("double").alias("score"))


@query("report_files", f"WITH {AUDIT_SQL} SELECT p AS page_id, score::INT AS score, verdict, n::INT AS issues FROM ar")
def report_files(spark, sf_dir):
    path = _folder(spark, "reports")
    write_reports(_reports(spark, sf_dir), path)
    return spark.read.parquet(path).select("page_id", "score", "verdict", F.size("issues").alias("issues"))


@query(
    "audit_json",
    f"""WITH {AUDIT_SQL}, {_LONG} SELECT 'row' AS part, url AS key, n::BIGINT AS number FROM ar UNION ALL SELECT field, key, pages FROM dg""",
)
def audit_json(spark, sf_dir):
    """Rows and duplicate groups as read back from their JSON lines."""
    path, rows = _folder(spark, "audit-json"), stored(_rows(spark, sf_dir))
    write_audit_json(rows, duplicate_groups(rows), path)
    lines = spark.read.schema("url string, issue_count bigint").json(f"{path}/rows").select(F.lit("row").alias("part"), F.col("url").alias("key"), F.col("issue_count").alias("number"))
    return lines.unionByName(spark.read.schema("field string, key string, pages bigint").json(f"{path}/duplicates").select(F.col("field").alias("part"), "key", F.col("pages").alias("number")))


@query(
    "profile_files",
    f"""WITH {BASE_SQL} SELECT host AS hostname, 'Host of ' || count(*) || ' pages' AS label, min(p) % 2 = 0 AS enabled, CASE WHEN min(p) % 3 = 0 THEN 'Product' ELSE 'Article,Person' END AS types FROM b GROUP BY host""",
)
def profile_files(spark, sf_dir):
    """A profile for every host of the pages, written as JSON lines and read back."""
    path, first = _folder(spark, "profiles"), F.min("page_id")
    hosts = keys(spark, sf_dir).groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("hostname")).agg(
        F.concat(F.lit("Host of "), F.count("*"), F.lit(" pages")).alias("label"), (first % 2 == 0).alias("enabled"),
        F.when(first % 3 == 0, F.array(F.lit("Product"))).otherwise(F.array(F.lit("Article"), F.lit("Person"))).alias("schema_types"))
    hosts.write.json(path)
    return read_profiles(spark, path).select("hostname", "label", "enabled", F.array_join("schema_types", ",").alias("types"))
