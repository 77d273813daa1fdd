"""Audit-table queries, commerce audits and corpus censuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit_table as A
from ..operators import census as CN
from ..operators import commerce as CM
from ..operators import extract as X
from ..operators import pagetype as T
from ..operators import robots as RB
from ..operators import schema as S
from ..operators import sketches as SK
from ..plans.audit import page_facts, page_reports, stored
from ..sources.fetch import response_meta
from .facts import HREFLANG_SQL, LINKS_SQL
from .graph import link_results, robots_docs, ROBOTS_SQL
from .media import TIMING_SQL, _resources
from .pages import BASE_SQL, ISSUES_SQL, SCORES, TYPE_RAW_SQL, VERDICT
from .registry import keys, query, table
from .seed import SEED_SQL, fetch_log, seeded_pages

_T = "trim(title)"
_H1 = "trim(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&quot;', '\"'), '&amp;', '&'))"
AUDIT_SQL = (
    ISSUES_SQL
    + ","
    + SCORES
    + f""",
ar AS (SELECT s.p, s.u AS url, s.host, s.hops > 0 AS redirected, s.status, {_T} AS title, s.description, {_H1} AS h1, s.canon_href AS canonical, s.robots, {VERDICT.replace('p %', 's.p %')} AS verdict,
         sc_.score, sc_.critical, sc_.warning, sc_.n FROM s JOIN sc_ ON sc_.p = s.p)"""
)


def _rows(spark, sf_dir):
    return A.audit_rows(page_reports(seeded_pages(spark, sf_dir), fetch_log(spark, sf_dir)))


@query(
    "audit_rows",
    f"""WITH {AUDIT_SQL} SELECT p AS page_id, url, redirected, status::INT AS status, title, description, h1, canonical, robots, verdict AS indexability, score::INT AS score, critical::INT AS critical,
        warning::INT AS warnings, n::INT AS issue_count FROM ar""",
)
def audit_rows(spark, sf_dir):
    return _rows(spark, sf_dir).select(
        "page_id", "url", "redirected", "status", "title", "description", "h1", "canonical", "robots", "indexability", "score",
        "critical", "warnings", "issue_count",
    )


@query(
    "audit_link_counts",
    f"WITH {LINKS_SQL} SELECT p AS page_id, count(*) FILTER (WHERE kind = 'http')::INT AS link_count, (1 + (p % 13 = 0)::INT)::INT AS h1_count FROM lk GROUP BY p",
)
def audit_link_counts(spark, sf_dir):
    return _rows(spark, sf_dir).select("page_id", "link_count", "h1_count")


def _with_errors(spark, sf_dir):
    """Rows of readable pages and error rows of those whose fetch failed."""
    rows = stored(_rows(spark, sf_dir))
    failed = fetch_log(spark, sf_dir).where("error <> '' OR status >= 500")
    kept = rows.join(failed.select("page_id"), "page_id", "left_anti")
    return kept.unionByName(A.error_rows(failed.select("page_id", "url", "final_url", "status", "redirected", "error"), rows))


@query(
    "error_rows",
    f"""WITH {AUDIT_SQL} SELECT p AS page_id, url, NOT bad AS available, CASE WHEN p % 29 = 7 THEN 'timeout' WHEN bad THEN 'network' ELSE '' END AS error, CASE WHEN bad THEN '' ELSE title END AS title,
        CASE WHEN bad THEN 'Unknown' ELSE verdict END AS indexability, CASE WHEN bad THEN NULL ELSE score END::INT AS score, status::INT AS status FROM (SELECT *, p % 29 = 7 OR status >= 500 AS bad FROM ar)""",
)
def error_rows(spark, sf_dir):
    return _with_errors(spark, sf_dir).select("page_id", "url", "available", "error", "title", "indexability", "score", "status")


_LONG = """
dl AS (SELECT p, url, field, value, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS key FROM (SELECT p, url, title, description, h1 FROM ar) UNPIVOT (value FOR field IN (title, description, h1))),
dg AS (SELECT field, key, count(*) AS pages FROM dl WHERE key <> '' GROUP BY ALL HAVING count(*) > 1)"""


@query(
    "duplicate_titles",
    f"WITH {BASE_SQL} SELECT 'title' AS field, lower({_T}) AS key, count(*) AS pages FROM b WHERE {_T} <> '' GROUP BY 2 HAVING count(*) > 1",
)
def duplicate_titles(spark, sf_dir):
    facts = X.extract_facts(table(spark, sf_dir, "pages"), "title").withColumn("available", F.lit(True))
    return A.duplicate_groups(facts, ["title"]).select("field", "key", "pages")


def _texts(spark, sf_dir):
    """Audit rows with no more than duplicates are judged by."""
    return A.text_fields(X.extract_facts(seeded_pages(spark, sf_dir), "title", "description", "headings"))


@query("duplicate_groups", f"WITH {AUDIT_SQL}, {_LONG} SELECT field, key, pages FROM dg")
def duplicate_groups(spark, sf_dir):
    return A.duplicate_groups(_texts(spark, sf_dir)).select("field", "key", "pages")


@query("duplicate_members", f"WITH {AUDIT_SQL}, {_LONG} SELECT p AS page_id, field, pages FROM dl JOIN dg USING (field, key)")
def duplicate_members(spark, sf_dir):
    return A.duplicate_members(stored(_texts(spark, sf_dir))).select("page_id", "field", "pages")


@query(
    "document_duplicates",
    # Whole texts, as the operator groups them; a group is named by its smallest doc_id.
    "SELECT min(doc_id) AS first_doc, count(*) AS pages FROM (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM documents) WHERE key <> '' GROUP BY key HAVING count(*) > 1",
)
def document_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("description"), F.lit(True).alias("available"))
    return A.duplicate_groups(docs, ["description"]).select(F.col("first_page").alias("first_doc"), "pages")


@query(
    "annotate_duplicates",
    f"""WITH {AUDIT_SQL}, {_LONG}, m AS (SELECT p, field FROM dl JOIN dg USING (field, key)) SELECT p AS page_id, p IN (SELECT p FROM m WHERE field = 'title') AS duplicate_title,
        p IN (SELECT p FROM m WHERE field = 'description') AS duplicate_description, p IN (SELECT p FROM m WHERE field = 'h1') AS duplicate_h1 FROM ar""",
)
def annotate_duplicates(spark, sf_dir):
    rows = _texts(spark, sf_dir)
    return A.annotate_duplicates(stored(rows), "page_id").select("page_id", "duplicate_title", "duplicate_description", "duplicate_h1")


@query(
    "filter_audit",
    f"""WITH {AUDIT_SQL} SELECT p AS page_id FROM ar WHERE status >= 400 AND n > 0 AND (lower(url) LIKE '%/en/%' OR lower(title) LIKE '%/en/%' OR lower(canonical) LIKE '%/en/%')""",
)
def filter_audit(spark, sf_dir):
    return A.filter_audit(_rows(spark, sf_dir), query=" /EN/ ", errors_only=True, issues_only=True).select("page_id")


@query("filter_redirects", f"WITH {AUDIT_SQL} SELECT p AS page_id, verdict AS indexability FROM ar WHERE redirected AND verdict = 'Noindex'")
def filter_redirects(spark, sf_dir):
    return A.filter_audit(_rows(spark, sf_dir), redirects_only=True, indexability="Noindex").select("page_id", "indexability")


@query(
    "sort_audit",
    f"WITH {AUDIT_SQL} SELECT p AS page_id, score::INT AS score, url FROM ar ORDER BY score DESC, url",
)
def sort_audit(spark, sf_dir):
    return A.sort_audit(_rows(spark, sf_dir), "score", "desc").select("page_id", "score", "url")


@query("select_pages", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 100")
def select_pages(spark, sf_dir):
    return A.select_pages(keys(spark, sf_dir), 100)


@query(
    "audit_summary",
    f"""WITH {AUDIT_SQL} SELECT host, verdict AS indexability, count(*) AS processed, count(*) FILTER (WHERE status >= 400) AS failures, count(*) FILTER (WHERE redirected) AS redirects, sum(critical)::BIGINT AS critical,
        sum(warning)::BIGINT AS warnings FROM ar GROUP BY ROLLUP (host, verdict)""",
)
def audit_summary(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("host", F.regexp_extract("url", r"^https?://([^/]+)", 1))
    return A.audit_summary(rows, ["host", "indexability"]).drop("available")


# --- pagination families ---


def _series(spark, sf_dir):
    """Each page URL and two more pages of the same series, with titles that repeat within it."""
    pages = keys(spark, sf_dir).select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"))
    p = F.col("page_id")
    trimmed = F.regexp_replace("u", "/$", "")
    variants = F.array(
        F.struct(F.col("u").alias("url"), F.lit("Title").alias("title"), p.cast("string").alias("description")),
        F.struct(F.concat("u", F.lit("?page=2&b=1")).alias("url"), F.when(p % 2 == 0, " title ").otherwise("Other").alias("title"), F.lit("d").alias("description")),
        F.struct(F.concat(trimmed, F.lit("/page/3?b=1")).alias("url"), F.lit("Third").alias("title"), F.lit("D").alias("description")),
    )
    return pages.select((p * 3).alias("k"), F.posexplode(variants).alias("i", "v")).select(
        (F.col("k") + F.col("i")).alias("page_id"), "v.*", F.lit(True).alias("available")
    )


_SERIES = """
sb AS (SELECT page_id AS p, regexp_replace(url, '[?#].*$', '') AS u FROM pages),
fam AS (SELECT p, u AS url, rtrim(u, '/') AS family, 'title' AS title, p::VARCHAR AS description FROM sb
  UNION ALL SELECT p, u || '?page=2&b=1', rtrim(u, '/') || '?b=1', CASE WHEN p % 2 = 0 THEN 'title' ELSE 'other' END, 'd' FROM sb
  UNION ALL SELECT p, rtrim(u, '/') || '/page/3?b=1', rtrim(u, '/') || '?b=1', 'third', 'd' FROM sb)"""


@query(
    "pagination_families",
    f"WITH {_SERIES} SELECT family, count(*)::BIGINT AS pages, count(DISTINCT url) AS urls FROM fam GROUP BY family HAVING count(DISTINCT url) > 1 AND bool_or(url LIKE '%page%')",
)
def pagination_families(spark, sf_dir):
    return A.pagination_families(_series(spark, sf_dir))


@query(
    "pagination_duplicates",
    f"WITH {_SERIES}, f AS (SELECT family FROM fam GROUP BY family HAVING count(DISTINCT url) > 1 AND bool_or(url LIKE '%page%')) SELECT family, 'description' AS field, description AS key, count(DISTINCT url) AS urls FROM fam JOIN f USING (family) GROUP BY family, description HAVING count(DISTINCT url) > 1 UNION ALL SELECT family, 'title', title, count(DISTINCT url) FROM fam JOIN f USING (family) GROUP BY family, title HAVING count(DISTINCT url) > 1",
)
def pagination_duplicates(spark, sf_dir):
    return A.pagination_duplicates(_series(spark, sf_dir)).select("family", "field", "key", "urls")


@query(
    "annotate_pagination",
    f"""WITH {_SERIES}, d AS (SELECT family, title FROM fam WHERE url LIKE '%b=1' GROUP BY ALL HAVING count(DISTINCT url) > 1)
        SELECT url, family AS pagination_family, url LIKE '%b=1' AND (family, title) IN (SELECT (family, title) FROM d) AS duplicate_pagination_title, url LIKE '%b=1' AS duplicate_pagination_description FROM fam""",
)
def annotate_pagination(spark, sf_dir):
    return A.annotate_pagination(_series(spark, sf_dir)).select(
        "url", "pagination_family", "duplicate_pagination_title", "duplicate_pagination_description"
    )


@query(
    "pagination_link_status",
    f"""WITH {SEED_SQL} SELECT p AS page_id, n AS links, n AS unchecked FROM (SELECT p, (CASE WHEN p % 4 = 2 THEN 12 ELSE 0 END + (p % 11 = 5 AND p > 0)::INT)::BIGINT AS n FROM s) WHERE n > 0""",
)
def pagination_link_status(spark, sf_dir):
    rows = A.pagination_link_status(CM.pager_links(X.links(seeded_pages(spark, sf_dir))), link_results(spark, sf_dir))
    return rows.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.col("state") == "unchecked").alias("unchecked"))


@query(
    "pagination_link_counts",
    f"""WITH {SEED_SQL}, c AS (SELECT s.p, t.p AS tp, CASE WHEN t.p % 29 = 7 OR t.status = 0 THEN 'unknown' WHEN t.status >= 400 THEN 'broken' WHEN t.hops > 0 THEN 'redirect' ELSE 'ok' END AS state
          FROM s JOIN s t ON t.p IN (2 * s.p + 1, 2 * s.p + 2))
        SELECT p AS page_id, count(*) AS checked, count(*) FILTER (WHERE state = 'ok') AS ok, count(*) FILTER (WHERE state = 'broken') AS broken, count(*) FILTER (WHERE state = 'redirect') AS redirect, count(*) FILTER (WHERE state = 'unknown') AS unknown FROM c GROUP BY p""",
)
def pagination_link_counts(spark, sf_dir):
    pages = keys(spark, sf_dir).select("page_id", F.regexp_replace("url", "#.*$", "").alias("href"))
    child = pages.withColumn("parent", F.floor((F.col("page_id") - 1) / 2)).where("page_id > 0")
    links = child.select(F.col("parent").alias("page_id"), "href", F.lit("next").alias("label"))
    return A.pagination_link_counts(A.pagination_link_status(links, link_results(spark, sf_dir)))


# --- JSON-LD and commerce ---


@query(
    "jsonld",
    f"WITH {SEED_SQL} SELECT p AS page_id, p % 16 <> 3 AS valid FROM s WHERE p % 4 IN (1, 2) OR p % 16 IN (3, 7, 11, 15)",
)
def jsonld(spark, sf_dir):
    return page_facts(seeded_pages(spark, sf_dir), "jsonld").select("page_id", F.explode("schemas").alias("s")).select("page_id", "s.valid")


NODES_SQL = """
nd AS (SELECT p, unnest(list_filter([CASE WHEN p % 4 = 1 THEN 'Product' END, CASE WHEN p % 4 = 1 AND p % 10 <> 9 THEN 'Brand' END, CASE WHEN p % 12 = 5 AND p % 4 = 1 THEN 'Offer' END, CASE WHEN p % 12 = 9 AND p % 4 = 1 THEN 'AggregateOffer' END,
   CASE WHEN p % 24 = 5 AND p % 4 = 1 THEN 'AggregateRating' END, CASE WHEN p % 8 = 1 THEN 'BreadcrumbList' END, CASE WHEN p % 4 = 2 THEN 'ItemList' END, CASE WHEN p % 4 = 2 THEN 'ListItem' END,
   CASE WHEN p % 16 = 7 THEN 'CollectionPage' END, CASE WHEN p % 16 = 7 THEN 'WebPage' END, CASE WHEN p % 16 = 11 THEN 'Article' END, CASE WHEN p % 16 = 11 THEN 'Person' END, CASE WHEN p % 16 = 15 THEN 'SearchResultsPage' END], lambda x: x IS NOT NULL)) AS type FROM s)"""


@query("schema_type_counts", f"WITH {SEED_SQL}, {NODES_SQL} SELECT p AS page_id, lower(type) AS type, 1::BIGINT AS blocks FROM nd")
def schema_type_counts(spark, sf_dir):
    return S.schema_type_counts(page_facts(seeded_pages(spark, sf_dir), "jsonld"))


@query(
    "schema_types",
    f"WITH {SEED_SQL}, {NODES_SQL} SELECT p AS page_id, string_agg(type, ',' ORDER BY type) AS types FROM nd GROUP BY p",
)
def schema_types(spark, sf_dir):
    facts = page_facts(seeded_pages(spark, sf_dir), "jsonld")
    return facts.select("page_id", F.array_join(S.schema_types(F.col("schemas")), ",").alias("types")).where("types <> ''")


@query(
    "schema_nodes",
    f"""WITH {SEED_SQL} SELECT p AS page_id, (CASE WHEN p % 4 = 1 THEN 1 + (p % 10 <> 9)::INT + (p % 12 IN (5, 9))::INT + (p % 24 = 5)::INT + CASE WHEN p % 8 = 1 THEN 2 ELSE 0 END
          WHEN p % 8 = 2 THEN 7 WHEN p % 4 = 2 THEN 4 WHEN p % 16 IN (7, 15) THEN 1 ELSE 2 END)::BIGINT AS nodes FROM s WHERE p % 4 IN (1, 2) OR p % 16 IN (7, 11, 15)""",
)
def schema_nodes(spark, sf_dir):
    rows = S.schema_nodes(page_facts(seeded_pages(spark, sf_dir), "jsonld"))
    return rows.groupBy("page_id").agg(F.count("*").alias("nodes"))


@query(
    "product_summary",
    f"""WITH {SEED_SQL} SELECT p AS page_id, CASE WHEN p % 10 = 1 THEN '' ELSE 'Item ' || p END AS name, p % 12 IN (5, 9) AS has_offers, CASE WHEN p % 10 = 5 THEN '' ELSE 'S' || p END AS sku,
        CASE WHEN p % 10 = 9 THEN '' ELSE 'Brand ' || (p % 6) END AS brand FROM s WHERE p % 4 = 1""",
)
def product_summary(spark, sf_dir):
    facts = page_facts(seeded_pages(spark, sf_dir), "jsonld")
    return facts.select("page_id", S.product_summary(F.col("schemas")).alias("s")).where("s IS NOT NULL").select("page_id", "s.*")


PRODUCT_SQL = (
    TYPE_RAW_SQL
    + """,
pd AS (SELECT *, p % 4 = 1 AS is_product, CASE WHEN p % 4 <> 1 OR p % 10 = 1 THEN '' ELSE 'Item ' || p END AS pname, CASE WHEN p % 4 <> 1 OR p % 10 = 3 THEN '' ELSE '/img/' || p || '.png' END AS pimage,
   CASE WHEN p % 4 <> 1 OR p % 10 = 5 THEN '' ELSE 'S' || p END AS psku, CASE WHEN p % 4 <> 1 OR p % 10 = 7 THEN '' ELSE lpad(p::VARCHAR, 13, '0') END AS pgtin, CASE WHEN p % 4 <> 1 OR p % 10 = 9 THEN '' ELSE 'Brand ' || (p % 6) END AS pbrand,
   CASE WHEN p % 4 <> 1 THEN '' WHEN p % 12 = 5 THEN p || '.50' WHEN p % 12 = 9 THEN p::VARCHAR ELSE '' END AS price, CASE WHEN p % 4 = 1 AND p % 12 = 5 THEN 'EUR' ELSE '' END AS currency,
   CASE WHEN p % 4 <> 1 THEN '' WHEN p % 12 = 5 THEN 'https://schema.org/InStock' WHEN p % 12 = 9 THEN 'http://schema.org/OutOfStock' ELSE '' END AS availability,
   CASE WHEN p % 4 = 1 AND p % 24 = 5 THEN '4.5' ELSE '' END AS rating, CASE WHEN p % 4 = 1 AND p % 24 = 5 THEN p::VARCHAR ELSE '' END AS reviews, p % 4 = 1 OR primary_ = 'product' AS applies FROM ptp)"""
)


def _products(spark, sf_dir, *extra):
    facts = page_facts(seeded_pages(spark, sf_dir), *dict.fromkeys(("jsonld", *extra)))
    return S.product_fields(S.product_offers(S.with_product_nodes(facts)))


@query(
    "product_offers",
    f"""WITH {PRODUCT_SQL} SELECT p AS page_id, (p % 12 IN (5, 9))::INT AS offer_count, price, currency, availability, CASE WHEN p % 12 = 9 THEN p::VARCHAR ELSE '' END AS low_price, CASE WHEN p % 12 = 9 THEN (p + 5)::VARCHAR ELSE '' END AS high_price,
        CASE WHEN p % 12 = 5 THEN 'instock' WHEN p % 12 = 9 THEN 'outofstock' ELSE '' END AS states FROM pd""",
)
def product_offers(spark, sf_dir):
    facts = page_facts(seeded_pages(spark, sf_dir), "jsonld")
    rows = S.product_offers(S.with_product_nodes(facts))
    return rows.select("page_id", "offer_count", "price", "currency", "availability", "low_price", "high_price", F.array_join("states", ",").alias("states"))


@query(
    "product_fields",
    f"""WITH {PRODUCT_SQL} SELECT p AS page_id, pname AS name, pimage AS image, psku AS sku, pgtin AS gtin, pbrand AS brand, price, currency, availability, rating, reviews,
        floor(((pname <> '')::INT + (pimage <> '')::INT + (psku <> '')::INT + (pgtin <> '')::INT + (pbrand <> '')::INT + (price <> '')::INT + (currency <> '')::INT + (availability <> '')::INT + (rating <> '')::INT + (reviews <> '')::INT) * 10)::INT AS completeness
        FROM pd""",
)
def product_fields(spark, sf_dir):
    return _products(spark, sf_dir).select(
        "page_id", "name", "image", "sku", "gtin", "brand", "price", "currency", "availability", "rating", "reviews", "completeness"
    )


_SELF = "(canon_href <> '' AND canon_href = u)"
_CROSS = "(canon_href <> '' AND regexp_extract(canon_href, '^(https?://[^/]+)', 1) <> origin)"


@query(
    "product_audit",
    f"""WITH {PRODUCT_SQL}, i AS (SELECT p, unnest(list_filter([
        CASE WHEN NOT is_product THEN 'product.schema.missing' END, CASE WHEN is_product AND pname = '' THEN 'product.name.missing' END, CASE WHEN is_product AND pimage = '' THEN 'product.image.missing' END,
        CASE WHEN is_product AND p % 12 NOT IN (5, 9) THEN 'product.offers.missing' END, CASE WHEN is_product AND p % 12 = 9 THEN 'product.currency.missing' END, CASE WHEN NOT (p % 8 = 1) THEN 'product.breadcrumb.missing' END,
        CASE WHEN canon_href = '' THEN 'product.canonical.missing' WHEN canon_count > 1 THEN 'product.canonical.multiple' WHEN {_CROSS} THEN 'product.canonical.cross_origin' WHEN NOT {_SELF} THEN 'product.canonical.different' END,
        CASE WHEN is_product AND p % 12 = 9 AND p % 7 IN (0, 2) THEN 'product.stock.noindex' END], lambda x: x IS NOT NULL)) AS id FROM pd WHERE applies)
        SELECT p AS page_id, id FROM i""",
)
def product_audit(spark, sf_dir):
    df = T.page_type(_products(spark, sf_dir, *T.FACTS_NEEDED, "canonical", "robots"))
    rows = CM.product_audit(df)
    return rows.select("page_id", F.explode("product_issues").alias("i")).select("page_id", "i.id")


@query(
    "product_hints",
    f"""WITH {PRODUCT_SQL} SELECT p AS page_id, CASE WHEN NOT applies THEN '' ELSE array_to_string(list_filter([CASE WHEN pgtin = '' THEN 'gtin' END, CASE WHEN psku = '' THEN 'sku' END, CASE WHEN pbrand = '' THEN 'brand' END, CASE WHEN rating = '' THEN 'reviews' END,
        CASE WHEN p % 12 = 9 THEN 'out-of-stock' END], lambda x: x IS NOT NULL), ',') END AS hints, p % 12 = 9 AS out_of_stock FROM pd""",
)
def product_hints(spark, sf_dir):
    df = T.page_type(_products(spark, sf_dir, *T.FACTS_NEEDED, "canonical", "robots"))
    rows = CM.product_audit(df)
    return rows.select("page_id", F.array_join("product_hints", ",").alias("hints"), "out_of_stock")


LISTING_SQL = (
    TYPE_RAW_SQL
    + """,
li AS (SELECT p, origin || '/item/' || p || '-' || i AS url FROM s, (SELECT unnest([1, 2, 3]) AS i) WHERE p % 4 = 2
  UNION ALL SELECT p, origin || '/p/' || p FROM s WHERE p % 11 = 5 UNION ALL SELECT p, origin || '/i/1' FROM s WHERE p % 11 = 6 UNION ALL SELECT p, origin || '/i/2' FROM s WHERE p % 11 = 6)"""
)


@query("listing_items", f"WITH {LISTING_SQL} SELECT p AS page_id, url FROM li")
def listing_items(spark, sf_dir):
    facts = page_facts(seeded_pages(spark, sf_dir), "jsonld", "signals")
    return S.listing_items(S.with_product_nodes(facts)).select("page_id", F.explode("listing").alias("url"))


@query(
    "robots_state",
    f"WITH {SEED_SQL} SELECT p AS page_id, p % 7 IN (0, 2) OR p % 19 = 0 AS noindex, p % 7 IN (1, 2) AS index_ FROM s",
)
def robots_state(spark, sf_dir):
    df = page_facts(seeded_pages(spark, sf_dir), "robots", fetch_log=fetch_log(spark, sf_dir))
    r = df.select("page_id", CM.robots_state(F.transform("robots", lambda x: x["content"]), F.col("x_robots")).alias("r"))
    return r.select("page_id", "r.noindex", F.col("r.index").alias("index_"))


@query("param_links", f"WITH {LINKS_SQL} SELECT p AS page_id, idx, 'color' AS params FROM lk WHERE raw LIKE '/list?%'")
def param_links(spark, sf_dir):
    rows = CM.param_links(X.links(seeded_pages(spark, sf_dir)))
    return rows.select("page_id", "idx", F.array_join(F.transform("params", lambda x: x["name"]), ",").alias("params"))


@query(
    "pager_links",
    f"WITH {LINKS_SQL} SELECT p AS page_id, href, idx, coalesce(nullif(regexp_extract(href, 'page=(\\d+)', 1), ''), p::VARCHAR)::BIGINT AS page FROM lk WHERE raw LIKE '/list?%' OR (raw LIKE '/p/%' AND p > 0)",
)
def pager_links(spark, sf_dir):
    return CM.pager_links(X.links(seeded_pages(spark, sf_dir))).where("page IS NOT NULL").select("page_id", "href", "idx", "page")


@query(
    "category_audit",
    f"""WITH {LISTING_SQL}, k AS (SELECT s.*, query LIKE '%page=2%' AS deep, query LIKE '%utm_source%' AS tracked, (p % 11 = 4 AND prv IS NOT NULL) AS has_prev, (SELECT count(*) FROM li WHERE li.p = s.p) AS items FROM ptp s WHERE p % 4 = 2 OR p % 11 = 6 OR primary_ = 'category'),
        i AS (SELECT p, unnest(list_filter([
          CASE WHEN canon_href = '' THEN 'category.canonical.missing' WHEN canon_count > 1 THEN 'category.canonical.multiple' WHEN {_CROSS} THEN 'category.canonical.cross_origin' WHEN NOT {_SELF} AND NOT deep THEN 'category.canonical.different' END,
          CASE WHEN tracked AND {_SELF} AND p % 7 NOT IN (0, 2) THEN 'category.params.noncontent_canonical' END, CASE WHEN tracked AND p % 7 = 2 THEN 'category.params.robots_conflict' END,
          CASE WHEN p % 4 = 2 THEN 'category.facets.internal_links' END, CASE WHEN deep AND canon_href = '' THEN 'category.pagination.canonical_missing' END, CASE WHEN deep AND NOT has_prev THEN 'category.pagination.prev_missing' END,
          CASE WHEN items = 0 THEN 'category.items.empty' WHEN items <= 2 AND words < 120 THEN 'category.items.thin' END, CASE WHEN p % 5 = 4 AND query = '?page=2' THEN 'category.pagination.canonical_first_page' END], lambda x: x IS NOT NULL)) AS id FROM k)
        SELECT p AS page_id, id FROM i""",
)
def category_audit(spark, sf_dir):
    facts = page_facts(seeded_pages(spark, sf_dir), *dict.fromkeys(("jsonld", *T.FACTS_NEEDED, "canonical", "robots", "links")))
    df = T.page_type(S.listing_items(S.with_product_nodes(facts)))
    return CM.category_audit(df).select("page_id", F.explode("category_issues").alias("i")).select("page_id", "i.id")


# --- censuses ---


@query(
    "url_inventory",
    f"WITH {BASE_SQL} SELECT p AS page_id, u AS norm, scheme, host, origin, replace(host || rtrim(replace(path, '/', ' › '), '› '), '  ', ' ') AS breadcrumb FROM b",
)
def url_inventory(spark, sf_dir):
    return CN.url_inventory(table(spark, sf_dir, "pages"))


@query(
    "collapsing_urls",
    "SELECT norm, count(*) AS pages FROM (SELECT regexp_replace(url, '#.*$', '') AS norm FROM pages UNION ALL SELECT regexp_replace(url, '#.*$', '') FROM pages WHERE page_id % 3 = 0) GROUP BY norm HAVING count(*) > 1",
)
def collapsing_urls(spark, sf_dir):
    pages = keys(spark, sf_dir)
    again = pages.where("page_id % 3 = 0").withColumn("url", F.concat("url", F.lit("#again")))
    return CN.collapsing_urls(pages.unionByName(again))


@query(
    "param_usage",
    f"""WITH {LINKS_SQL}, u AS (SELECT href AS url FROM lk WHERE kind = 'http' UNION ALL SELECT u FROM s),
        pr AS (SELECT split_part(kv, '=', 1) AS name, split_part(kv, '=', 2) AS value FROM (SELECT unnest(string_split(regexp_extract(url, '\\?(.*)$', 1), '&')) AS kv FROM u WHERE url LIKE '%?%=%') WHERE split_part(kv, '=', 2) <> '')
        SELECT CASE WHEN name LIKE 'utm%' THEN 'tracking' WHEN name IN ('page', 'p') THEN 'pagination' WHEN name = 'color' THEN 'filter' ELSE 'other' END AS kind, name, count(*)::BIGINT AS uses, count(DISTINCT value) AS distinct_values FROM pr GROUP BY name""",
)
def param_usage(spark, sf_dir):
    links = X.links(seeded_pages(spark, sf_dir)).where("kind = 'http'").select(F.col("href").alias("url"))
    return CN.param_usage(links.unionByName(keys(spark, sf_dir).select("url")))


@query(
    "merging_urls",
    f"""WITH {SEED_SQL}, v AS (SELECT u AS url FROM s UNION ALL SELECT u || CASE WHEN u LIKE '%?%' THEN '&' ELSE '?' END || 'utm_medium=x' FROM s),
        c AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(url, '([?&])(page=2|utm_source=feed|utm_medium=x)', '\\1', 'g'), '[&]+', '&', 'g'), '\\?&', '?') AS content FROM v)
        SELECT rtrim(content, '?&') AS content, count(DISTINCT url) AS variants, count(*)::BIGINT AS links FROM c GROUP BY 1 HAVING count(DISTINCT url) > 1""",
)
def merging_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "#.*$", "").alias("url"))
    mark = F.when(F.contains("url", F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return CN.merging_urls(pages.unionByName(pages.select(F.concat("url", mark, F.lit("utm_medium=x")).alias("url"))))


@query(
    "directive_census",
    f"""WITH {HREFLANG_SQL} SELECT kind, value, valid, count(*) AS pages FROM (
        SELECT 'directive' AS kind, unnest(string_split(CASE p % 7 WHEN 0 THEN 'noindex' WHEN 1 THEN 'index,nofollow' WHEN 2 THEN 'index,noindex' ELSE 'noarchive' END, ',')) AS value, true AS valid FROM s WHERE p % 7 < 4
        UNION ALL SELECT 'hreflang', tag, tag <> 'english_1' FROM (SELECT DISTINCT p, lower(tag) AS tag FROM hl) UNION ALL SELECT 'lang', lower(lang), true FROM s) GROUP BY ALL""",
)
def directive_census(spark, sf_dir):
    return CN.directive_census(X.extract_facts(seeded_pages(spark, sf_dir), "robots", "hreflang", "lang"))


@query(
    "text_profile",
    f"""WITH {LINKS_SQL}, l AS (SELECT lk.*, host, trim(regexp_replace(replace(replace(label, '&amp;', '&'), '&quot;', '"'), '\\s+', ' ', 'g')) AS t FROM lk JOIN s USING (p) WHERE kind = 'http')
        SELECT host AS source_host, count(*) AS links, sum(len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+(?:[''’\\-][\\p{{L}}\\p{{N}}]+)*')))::BIGINT AS words, count(*) FILTER (WHERE lower(t) = 'read more') AS read_more FROM l GROUP BY host""",
)
def text_profile(spark, sf_dir):
    links = X.links(seeded_pages(spark, sf_dir))
    rows = CN.text_profile(links).drop("pixels", "generic")
    more = links.where("lower(label) = 'read more'").groupBy(F.regexp_extract("page_url", r"^https?://([^/:?#]+)", 1).alias("source_host"))
    return rows.join(more.agg(F.count("*").alias("read_more")), "source_host", "left").withColumn("read_more", F.coalesce("read_more", F.lit(0)))


@query(
    "resource_census",
    f"""WITH {SEED_SQL}, {TIMING_SQL} SELECT kind, CASE WHEN kind = 'image' THEN 'PNG' ELSE 'Unknown' END AS format, CASE WHEN size = 0 THEN 'unknown' WHEN size < 10240 THEN 'small' WHEN size < 102400 THEN 'medium' ELSE 'large' END AS size_class,
        CASE WHEN url LIKE '%google-analytics.com%' OR url LIKE '%segment.io%' THEN 'analytics' WHEN url LIKE '%.cdn.%' THEN 'cdn' ELSE 'other' END AS host_class, count(*) AS requests, sum(size)::BIGINT AS bytes FROM rs GROUP BY ALL""",
)
def resource_census(spark, sf_dir):
    return CN.resource_census(_resources(spark, sf_dir))


@query(
    "resource_sketches",
    f"""WITH {SEED_SQL}, {TIMING_SQL} SELECT kind, count(*) AS requests, count(DISTINCT url || '#' || e % 997) AS urls, true AS urls_within, true AS median_within, true AS q95_within FROM rs GROUP BY kind""",
)
def resource_sketches(spark, sf_dir):
    """Sketches of two rounds, stored and united, beside exact counts: whether they keep within their stated errors."""
    rows = _resources(spark, sf_dir).select("kind", F.concat("url", F.lit("#"), (F.col("resource_id") % 997).cast("string")).alias("url"), "size_bytes", (F.col("resource_id") % 2).alias("round"))
    rounds = stored(SK.sketch(rows, ["round", "kind"], F.col("url"), F.col("size_bytes")))
    told = SK.estimates(SK.merge(rounds, ["kind"]))
    exact = rows.groupBy("kind").agg(F.count("*").alias("requests"), F.countDistinct("url").alias("urls"))
    share = lambda c: F.avg(c.cast("double"))
    # A quantile is right where its share of smaller and of not larger sizes enclose it, give or take the error.
    ranks = rows.join(told, "kind").groupBy("kind").agg(*[f(F.col("size_bytes"), F.col(q)) for q in ("q50", "q95") for f in (lambda a, b, q=q: share(a < b).alias(f"{q}_low"), lambda a, b, q=q: share(a <= b).alias(f"{q}_high"))])
    both = told.drop("rows").join(exact, "kind").join(ranks, "kind")
    within = lambda q, at: (F.col(f"{q}_low") <= at + 0.03) & (F.col(f"{q}_high") >= at - 0.03)
    return both.select("kind", "requests", "urls", (F.abs(F.col("distinct") - F.col("urls")) <= F.greatest(F.col("urls") * SK.distinct_error(), F.lit(1.0))).alias("urls_within"),
                       within("q50", 0.5).alias("median_within"), within("q95", 0.95).alias("q95_within"))


@query(
    "policy_census",
    f"""WITH {SEED_SQL} SELECT policy, item, count(*) AS responses FROM (
        SELECT 'csp' AS policy, unnest(CASE p % 6 WHEN 0 THEN ['default-src', 'script-src'] WHEN 1 THEN ['default-src', 'frame-ancestors'] ELSE [] END) AS item FROM s
        UNION ALL SELECT 'csp-risk', unnest(['''unsafe-eval''', '*']) FROM s WHERE p % 6 = 0
        UNION ALL SELECT 'hsts', CASE p % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' ELSE 'missing' END FROM s) GROUP BY ALL""",
)
def policy_census(spark, sf_dir):
    return CN.policy_census(response_meta(fetch_log(spark, sf_dir)))


@query(
    "robots_weight_census",
    f"WITH {SEED_SQL}, {ROBOTS_SQL} SELECT type, length(rtrim(replace(path, '*', ''), '$'))::INT AS weight, count(*) AS rules FROM rr GROUP BY ALL",
)
def robots_weight_census(spark, sf_dir):
    return CN.robots_weight_census(RB.robots_rules(robots_docs(spark, sf_dir)))
