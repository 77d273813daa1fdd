"""Registered queries against their SQL."""

import os

import duckdb
import pytest

from check import TABLES, rows
from pagesieve.catalog import load

FOLDER = "/root/testdata/sf0.01"
# All of them with PAGESIEVE_ALL=1; otherwise one or two per subject.
SAMPLE = [
    "page_meta", "links", "images", "text_scan", "head_signals", "issues", "apply_rules", "resolve_rules", "indexability", "page_type",
    "serp", "duplicate_titles", "product_fields", "robots_eval", "sitemap_membership", "hreflang_targets", "canonical_walk", "crawl",
    "resource_summary", "security_headers", "image_audit", "regressions", "append_snapshots", "debounce_changes", "redirect_chains",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


NAMES = list(load()[0]) if os.environ.get("PAGESIEVE_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    queries, oracles = load()
    df = queries[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(oracles[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cur.fetchall())


def test_every_query_has_sql():
    queries, oracles = load()
    assert set(queries) == set(oracles)
