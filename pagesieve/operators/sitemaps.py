"""Sitemaps: entries, index expansion, membership of pages and conflicts."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import keep_true, let, settled
from ..functions.html import decode_entities
from ..session import stored

_NS = r"(?:[A-Za-z0-9_\-]+:)?"


def xml_decode(value: Column) -> Column:
    """CDATA unwrapped, references replaced, trimmed."""
    plain = F.regexp_replace(value, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    return F.trim(decode_entities(plain))


def _tag(block: Column, tag: str) -> Column:
    return let(F.regexp_extract(block, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), xml_decode)


def sitemap_docs(docs: DataFrame) -> DataFrame:
    """``sitemap_url, type, blocks`` from ``sitemap_url, text``."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^\\ufeff", "")
    kind = (
        F.when(text.rlike(rf"(?i)<{_NS}sitemapindex\b"), "sitemapindex")
        .when(text.rlike(rf"(?i)<{_NS}urlset\b"), "urlset")
        .otherwise("unknown")
    )
    find = lambda tag: F.regexp_extract_all(text, F.lit(rf"(?is)<{_NS}{tag}\b[^>]*>(.*?)</{_NS}{tag}>"), F.lit(1))
    out = docs.withColumn("type", kind)
    blocks = F.when(F.col("type") == "sitemapindex", find("sitemap")).when(F.col("type") == "urlset", find("url"))
    return out.withColumn("blocks", F.coalesce(blocks, F.array().cast("array<string>")))


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """``sitemap_url, type, pos, loc, lastmod``; entries without a location are left to the warnings."""
    rows = sitemap_docs(docs).select("sitemap_url", "type", F.posexplode("blocks").alias("pos", "block"))
    rows = rows.withColumn("raw", _tag(F.col("block"), "loc")).where("raw <> ''")
    loc = F.trim(F.regexp_replace(U.absolute_url(F.col("raw"), U.split_url(F.col("sitemap_url")), browser=True), "#.*$", ""))
    rows = settled(rows, {"loc": loc, "lastmod": _tag(F.col("block"), "lastmod")})
    return rows.select("sitemap_url", "type", "pos", "loc", "lastmod")


def sitemap_warnings(docs: DataFrame) -> DataFrame:
    parsed = sitemap_docs(docs)
    root = parsed.where("type = 'unknown'").select("sitemap_url", F.lit("Sitemap root is not urlset or sitemapindex.").alias("message"))
    rows = parsed.select("sitemap_url", "type", F.explode("blocks").alias("block")).where(_tag(F.col("block"), "loc") == "")
    noun = F.when(F.col("type") == "sitemapindex", "A sitemap entry is missing loc.").otherwise("A URL entry is missing loc.")
    return root.unionByName(rows.select("sitemap_url", noun.alias("message")))


def sitemap_expand(docs: DataFrame, seeds: DataFrame, max_levels: int | None = None) -> DataFrame:
    """All sitemap documents reachable from the seeds of each host: ``host, sitemap_url, level``.

    One join per level of nesting until nothing new is found (or ``max_levels``); documents
    seen before are not followed again, so cycles end. Each level is written to the shared
    folder: lineage stays short and a lost executor never replays earlier levels.
    """
    index = sitemap_entries(docs).where("type = 'sitemapindex'")
    edges = index.select(U.normalize_url(F.col("sitemap_url")).alias("parent"), U.normalize_url(F.col("loc")).alias("child")).distinct()
    edges = stored(edges, "sitemap-edges")
    known = docs.select(U.normalize_url(F.col("sitemap_url")).alias("sitemap_url")).distinct()
    level = seeds.select("host", U.normalize_url(F.col("sitemap")).alias("sitemap_url")).distinct()
    level = level.join(known, "sitemap_url", "left_semi").withColumn("level", F.lit(0)).select("host", "sitemap_url", "level")
    level = stored(level, "sitemaps")
    seen = level
    for depth in itertools.count(1) if max_levels is None else range(1, max_levels + 1):
        found = level.join(edges, F.col("sitemap_url") == F.col("parent")).select("host", F.col("child").alias("sitemap_url"))
        found = found.distinct().join(known, "sitemap_url", "left_semi").join(seen, ["host", "sitemap_url"], "left_anti")
        level = stored(found.withColumn("level", F.lit(depth)).select("host", "sitemap_url", "level"), "sitemaps")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def sitemap_membership(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Whether the page URL and its canonical URL are listed, with the first entry's lastmod.

    ``pages`` needs ``page_id, norm_url, norm_canonical`` ('' without a canonical).
    The two look-ups are one join: each page emits its targets, entries shrink to one
    row per URL before the join.
    """
    listed = settled(entries.where("type = 'urlset'"), {"target": U.normalize_url(F.col("loc"))})
    first = listed.groupBy("target").agg(
        F.min_by(F.struct("sitemap_url", "lastmod"), F.struct("sitemap_url", "pos")).alias("hit")
    )
    canonical = F.when(F.col("norm_canonical") == "", F.col("norm_url")).otherwise(F.col("norm_canonical"))
    wanted = F.array(
        F.struct(F.lit("source").alias("role"), F.col("norm_url").alias("target")),
        F.struct(F.lit("canonical").alias("role"), canonical.alias("target")),
    )
    rows = pages.select("page_id", F.explode(wanted).alias("w")).select("page_id", "w.*").join(first, "target", "left")
    pick = lambda role, f: F.max(F.when(F.col("role") == role, F.col("hit")[f]))
    return rows.groupBy("page_id").agg(
        F.coalesce(pick("source", "sitemap_url"), F.lit("")).alias("source_sitemap"),
        F.coalesce(pick("source", "lastmod"), F.lit("")).alias("source_lastmod"),
        F.coalesce(pick("canonical", "sitemap_url"), F.lit("")).alias("canonical_sitemap"),
    ).withColumns(
        {"source_found": F.col("source_sitemap") != "", "canonical_found": F.col("canonical_sitemap") != ""}
    )


def sitemap_issues(rows: DataFrame) -> DataFrame:
    """Add ``sitemap_issues``; needs source_found, norm_url, norm_canonical, verdict, status, redirect hops."""
    c = F.col
    found = c("source_found")
    status, hops = F.coalesce(c("status"), F.lit(0)), F.coalesce(c("redirects")["hops"], F.lit(0))
    own = (c("norm_canonical") == "") | (c("norm_canonical") == c("norm_url"))
    codes = keep_true(
        (found & ~own, F.lit("noncanonical-source-in-sitemap")),
        (found & ((c("verdict") == "Redirected") | (hops > 0) | status.between(300, 399)), F.lit("redirect-source-in-sitemap")),
        (found & c("verdict").isin("Noindex", "Blocked"), F.lit("nonindexable-source-in-sitemap")),
        (found & ((c("verdict") == "Error") | (status >= 400)), F.lit("error-source-in-sitemap")),
    )
    return rows.withColumn("sitemap_issues", codes)
