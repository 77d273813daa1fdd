"""Page types, commerce audits, comparison and messages: brute force on a small fixture, and whole results against SQL."""

import re

import duckdb
import pytest

from check import TABLES, rows
from pagesieve.catalog import load
from pagesieve.catalog.seed import seeded_pages

FOLDER = "/root/testdata/sf0.01"
IDS = [*range(1, 41), 88, 104, 132]
PATHS = {8: "/", 10: "/search/x", 12: "/a?page=2", 14: "/l?page=2", 16: "/a?color=red", 18: "/c?color=red", 24: "/find"}
GROUP, SHORT = 20, 17


def source(p):
    words = " ".join(["word"] * (10 if p == SHORT else 270 + p % 40))
    group = '<script type="application/ld+json">{"@type":"ProductGroup","name":"Group","sku":"G"}</script>' if p == GROUP else ""
    return f'<html lang="en"><head><title>Page {p}</title>{group}</head><body><article><h1>H {p}</h1><p>{words}</p></article><footer>end</footer></body></html>'


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    data = [(p, f"https://h{p % 3}.example.com{PATHS.get(p, f'/doc-{p}')}", source(p)) for p in IDS]
    spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def pages(spark, small):
    return {r["page_id"]: r for r in seeded_pages(spark, small).collect()}


def result(spark, name, folder):
    return [r.asDict() for r in load()[0][name](spark, folder).collect()]


def judged(p, url, html, fetched=True):
    """(primary, points, faceted, paginated, evidence) of a seeded page, rule by rule."""
    words = len(re.sub(r"<[^>]*>", "", html.split("<body>")[1]).split())
    status = 0 if p % 29 == 7 or not fetched else 404 if p % 13 == 5 else 503 if p % 26 == 7 else 200
    path = re.sub(r"^https://[^/]+", "", url)
    paged = "page=2" in path or (p % 11 == 3 and p + 1 in IDS) or (p % 11 == 4 and p - 1 in IDS)
    by_path, faceted = bool(re.search(r"/(search|find)(/|$)", path)), "color=" in path
    held = [
        (status >= 400, "error", "http-status", 10), (p % 16 == 15, "search", "schema", 8), (by_path, "search", "url-path", 5), (p % 12 == 0, "search", "dom", 1),
        (path == "/", "homepage", "url", 9), (p % 4 == 1, "product", "schema", 7), (p % 11 == 0, "product", "open-graph", 5), (p % 11 == 5, "product", "microdata", 4),
        (p % 16 == 11, "article", "schema", 7), (p % 11 == 1, "article", "open-graph", 5), (words >= 300, "article", "semantic-html", 4),
        (p % 16 == 7, "category", "schema", 7), (p % 4 == 2, "category", "schema", 6), (p % 11 == 6, "category", "microdata", 4),
        (faceted, "faceted", "url-parameter", 4), (paged, "pagination", "pagination", 4),
    ]
    held = [e[1:] for e in held if e[0]]
    total = {t: sum(w for k, _, w in held if k == t) for t in ("search", "product", "article", "category")}
    best = max(total[t] for t in ("product", "article", "category"))
    if status >= 400:
        primary, points = "error", 10
    elif path == "/":
        primary, points = "homepage", 9
    elif (p % 16 == 15 or by_path) and total["search"] >= 4:
        primary, points = "search", total["search"]
    elif best < 4:
        primary, points, held = "generic", 1, [*held, ("generic", "fallback", 1)]
    else:
        primary, points = next(t for t in ("product", "article", "category") if total[t] == best), best
    return primary, points, faceted, paged, [e for e in held if e[0] in (primary, "faceted", "pagination")], words


def test_page_type_of_every_page(spark, small, pages):
    want = {p: judged(p, r["url"], r["html"]) for p, r in pages.items()}
    got = {r["page_id"]: (r["primary_type"], r["points"], r["faceted"], r["paginated"]) for r in result(spark, "page_type", small)}
    assert got == {p: w[:4] for p, w in want.items()}
    assert {w[5] >= 300 for w in want.values()} == {True, False}
    assert {w[0] for w in want.values()} == {"error", "homepage", "search", "product", "article", "category", "generic"}


def test_evidence_of_every_type(spark, small, pages):
    want = sorted((p, *e) for p, r in pages.items() for e in judged(p, r["url"], r["html"])[4])
    assert sorted((r["page_id"], r["type"], r["signal"], r["weight"]) for r in result(spark, "page_type_evidence", small)) == want


def canonical(p):
    """(missing, multiple, cross origin, own URL) of a seeded page's canonical."""
    none = p % 5 == 0 or (p % 5 == 2 and p + 1 not in IDS)
    return none, p % 5 == 3, p % 5 == 2 and not none, p % 5 in (1, 3) or (p % 5 == 4 and "?" not in PATHS.get(p, ""))


def canonical_issues(kind, p, different=True):
    none, many, cross, own = canonical(p)
    if none or many or cross:
        return [f"{kind}.canonical.{'missing' if none else 'multiple' if many else 'cross_origin'}"]
    return [] if own or not different else [f"{kind}.canonical.different"]


def product_issues(p, primary):
    node = p % 4 == 1
    described = node or p == GROUP
    if not described and primary != "product":
        return []
    held = [
        (not described, "schema.missing"), (node and p % 10 == 1, "name.missing"), (p == GROUP or (node and p % 10 == 3), "image.missing"),
        (described and not (node and p % 12 in (5, 9)), "offers.missing"), (p % 12 == 9, "currency.missing"), (p % 8 != 1, "breadcrumb.missing"),
        (p % 12 == 9 and p % 7 in (0, 2), "stock.noindex"),
    ]
    return [f"product.{i}" for c, i in held if c] + canonical_issues("product", p)


def category_issues(p, primary, words):
    if primary != "category" and p % 4 != 2 and p % 11 != 6:
        return []
    items = 3 * (p % 4 == 2) + 2 * (p % 11 == 6) + (p % 11 == 5)
    path, noindex = PATHS.get(p, ""), p % 7 in (0, 2)
    facets, deep, (none, _, _, own) = "color=" in path, "page=2" in path, canonical(p)
    held = [
        (items == 0, "items.empty"), (0 < items <= 2 and words < 120, "items.thin"), (facets and own and not noindex, "facets.index_bloat"),
        (facets and p % 7 == 2, "params.robots_conflict"), (p % 4 == 2, "facets.internal_links"), (deep and none, "pagination.canonical_missing"),
        (deep and p % 5 == 4, "pagination.canonical_first_page"), (deep and p % 11 != 4, "pagination.prev_missing"),
    ]
    return [f"category.{i}" for c, i in held if c] + canonical_issues("category", p, not facets and not deep)


def test_product_rows_of_every_page(spark, small):
    fields = {r["page_id"]: r for r in result(spark, "product_fields", small)}
    offers = {r["page_id"]: r for r in result(spark, "product_offers", small)}
    assert set(fields) == set(offers) == set(IDS)
    assert (fields[GROUP]["name"], fields[GROUP]["sku"], fields[GROUP]["completeness"]) == ("Group", "G", 20)
    for p in IDS:
        if p % 4 != 1:
            assert not any(offers[p][c] for c in offers[p] if c != "page_id")
            assert p == GROUP or not any(fields[p][c] for c in fields[p] if c != "page_id")


def test_product_audit_of_every_page(spark, small, pages):
    primary = {p: judged(p, r["url"], r["html"], False)[0] for p, r in pages.items()}
    want = sorted((p, i) for p in IDS for i in product_issues(p, primary[p]))
    assert sorted((r["page_id"], r["id"]) for r in result(spark, "product_audit", small)) == want
    assert (132, "product.schema.missing") in want
    hints = {r["page_id"]: r["hints"] for r in result(spark, "product_hints", small)}
    assert set(hints) == set(IDS)
    assert hints[GROUP] == "gtin,brand,reviews" and hints[132] == "gtin,sku,brand,reviews" and hints[4] == ""


def test_category_audit_of_every_page(spark, small, pages):
    seen = {p: judged(p, r["url"], r["html"], False) for p, r in pages.items()}
    want = sorted((p, i) for p in IDS for i in category_issues(p, seen[p][0], seen[p][5]))
    assert sorted((r["page_id"], r["id"]) for r in result(spark, "category_audit", small)) == want
    assert {(SHORT, "category.items.thin"), (14, "category.pagination.canonical_first_page"), (23, "category.items.empty")} <= set(want)


def test_every_pager_link(spark, small):
    want = {p: n for p in IDS if (n := 12 * (p % 4 == 2) + (p % 11 == 5))}
    rows = result(spark, "pagination_link_status", small)
    assert {r["page_id"]: r["links"] for r in rows} == {r["page_id"]: r["unchecked"] for r in rows} == want


def headers(p):
    """Security headers of a page's response by compared field; '' if it has none (a report-only policy counts as none)."""
    pick = lambda n, *values: dict(enumerate(values)).get(p % n, "")
    return {
        "Content-Security-Policy": pick(6, "default-src 'self'; script-src * 'unsafe-eval'", "default-src 'self'; frame-ancestors 'none'"),
        "Strict-Transport-Security": pick(5, "max-age=31536000; includeSubDomains", "max-age=0"), "X-Frame-Options": pick(7, "DENY", "ALLOWALL"),
        "Referrer-Policy": pick(3, "strict-origin", "no-referrer, unsafe-url"), "Permissions-Policy": pick(2, "geolocation=()"), "X-Content-Type-Options": pick(4, "nosniff", "none"),
    }


def test_all_forty_fields_are_compared(spark, small):
    cells, pairs = {}, [p for p in IDS if p % 2 == 0 and p + 1 in IDS]
    rows = result(spark, "compare_pages", small)
    for r in rows:
        cells[r["pair_id"], r["field"]] = r["left"]
        cells[r["pair_id"] + 1, r["field"]] = r["right"]
    fields = {f for _, f in cells}
    assert len(fields) == 40 and len(rows) == 40 * len(pairs)
    url = lambda p: f"https://h{p % 3}.example.com{PATHS.get(p, f'/doc-{p}')}"
    for p in (q for k in pairs for q in (k, k + 1)):
        at = lambda f: cells[p, f]  # noqa: B023, E731
        images = [f"https://h{p % 3}.example.com/img/{p}-{i}.png" for i in range(p % 3)]
        assert at("URL") == url(p) and at("Image sources") == ("\n".join(images) or "—")
        assert at("Missing dimensions") == str(p % 3 if p % 5 else 0)
        assert at("Content-Type") == "text/html; charset=utf-8" and at("Cache-Control") == "—"
        assert at("Content-Language") == {0: "de, en", 1: "en-US;q=1"}.get(p % 4, "—")
        for f, v in headers(p).items():
            assert at(f).endswith(f" · {v}") if v else " · " not in at(f), (p, f, at(f))
    lists = [f"https://h2.example.com/list?color=c{i}&page={i}" for i in range(1, 13)]
    assert cells[2, "HTTP targets"] == "\n".join(sorted([url(5), url(6), "https://h2.example.com/empty-2", *lists]))
    assert cells[3, "HTTP targets"] == "\n".join(sorted([url(7), url(8), "https://h0.example.com/about"]))
    assert cells[2, "Outline"] == "H1 H 2" and cells[3, "Outline"] == "H1 H 3\nH2 Sub"
    assert cells[2, "Declarations"] == f"en → {url(3)}\nfr → {url(2)}" and cells[3, "Declarations"] == f"en → {url(3)}"


def test_messages_of_all_issue_ids(spark, small):
    rows = result(spark, "issue_messages", small)
    assert sorted((r["page_id"], r["id"]) for r in rows) == sorted((r["page_id"], r["id"]) for r in result(spark, "issues", small))
    assert len({r["id"] for r in rows}) > 20 and all(r["message"] for r in rows)
    said = {(r["page_id"], r["id"]): r["message"] for r in rows}
    assert all(said[p, "title.short"] == f"{len(f'Page {p}')} characters; configured minimum is 15." for p in IDS)
    assert said[3, "viewport.missing"] == "No viewport meta tag was found." and said[5, "canonical.missing"] == "No canonical link element was found."


@pytest.mark.parametrize(
    "name",
    ["page_type_evidence", "product_offers", "product_audit", "product_hints", "category_audit", "compare_pages", "issue_messages"],
)
def test_has_the_rows_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    queries, oracles = load()
    df = queries[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(oracles[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())
