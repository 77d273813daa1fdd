"""Responses of pages: by page where the log names it, else by URL."""

from pagesieve.catalog import load
from pagesieve.plans.audit import with_response


def test_pages_that_share_a_url_keep_their_own_response(spark):
    """A log that names its pages is joined by page, any other by URL, where the latest counts."""
    pages = spark.createDataFrame([(1, "https://e.com/a#x"), (2, "https://e.com/a"), (3, "https://e.com/b")], "page_id long, url string")
    log = spark.createDataFrame(
        [(1, "https://e.com/a", 404, 1), (2, "https://e.com/a", 200, 2), (2, "https://e.com/a", 503, 1)], "page_id long, url string, status int, at int"
    ).selectExpr("page_id", "url", "status", "false AS redirected", "url AS final_url", "'' AS error", "map('X-Robots-Tag', array(string(status))) AS headers",
                 "array() AS redirect_chain", "timestamp_seconds(at) AS captured_at")
    seen = lambda df: {r["page_id"]: (r["status"], r["x_robots"], r["norm_url"]) for r in df.collect()}
    a, b = "https://e.com/a", "https://e.com/b"
    assert seen(with_response(pages, log)) == {1: (404, ["404"], a), 2: (200, ["200"], a), 3: (None, None, b)}
    assert seen(with_response(pages, log.drop("page_id"))) == {1: (200, ["200"], a), 2: (200, ["200"], a), 3: (None, None, b)}


def test_pages_that_share_a_url_have_their_own_duplicate_flags(spark, tmp_path):
    """Pages 40 and 50 are one URL; 50 has the description of page 10, and 40 has none."""
    html = '<html lang="en"><head><title>Page {0}</title></head><body><article><h1>H {0}</h1></article><footer>end</footer></body></html>'
    data = [(p, f"https://h.example.com/doc-{1 if p == 10 else 2}", html.format(p)) for p in (10, 40, 50)]
    spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    queries = load()[0]
    got = {r["page_id"]: r["duplicate_description"] for r in queries["annotate_duplicates"](spark, str(tmp_path)).collect()}
    assert got == {10: True, 40: False, 50: True}
    for name in ("audit_csv", "crawl_csv"):
        rows = queries[name](spark, str(tmp_path)).collect()
        assert {r["Title"]: r["Duplicate description"] for r in rows} == {"Page 10": "true", "Page 40": "false", "Page 50": "true"}
