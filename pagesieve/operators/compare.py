"""Side-by-side comparison of two pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import clean, per_session, settled, str_array
from .extract import link_kind
from .schema import schema_types

MAX_ITEMS = 80
MAX_TEXT = 160


def _sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: clean(v)), lambda v: v != "")))


def cap_list(values: Column) -> Column:
    """First items of a list, each shortened, with a note on how many follow."""
    short = lambda v: F.when(F.length(v) > MAX_TEXT, F.concat(F.left(v, F.lit(MAX_TEXT - 1)), F.lit("…"))).otherwise(v)
    shown = F.transform(F.slice(values, 1, MAX_ITEMS), lambda v: short(clean(v)))
    more = F.concat(F.lit("… +"), (F.size(values) - MAX_ITEMS).cast("string"), F.lit(" more"))
    return F.when(F.size(values) > MAX_ITEMS, F.concat(shown, F.array(more))).otherwise(shown)


def _full(values: Column) -> Column:
    """What equality of a list is judged on: all of it."""
    return F.sha2(F.array_join(values, "\n"), 256)


def _shown(value: Column, array: bool = False) -> Column:
    text = F.array_join(value, "\n") if array else value.cast("string")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("—"))


@per_session
def _lists() -> list[dict[str, Column]]:
    """Resolved references, once per page."""
    base = F.col("base")
    http = F.filter(
        F.transform("links", lambda l: F.struct(l["rel"].alias("rel"), link_kind(l["raw_href"]).alias("kind"), l["raw_href"].alias("raw"))),
        lambda l: l["kind"] == "http",
    )
    kinds = F.concat(
        F.transform("http_", lambda l: F.struct(F.lit("link").alias("k"), l["raw"].alias("ref"))),
        F.transform("images", lambda i: F.struct(F.lit("image").alias("k"), i["src"].alias("ref"))),
        F.transform("hreflang", lambda h: F.struct(F.lower(h["lang"]).alias("k"), h["ref"].alias("ref"))),
    )
    resolved = F.transform(kinds, lambda r: F.struct(r["k"].alias("k"), U.absolute_url(r["ref"], base).alias("u")))
    return [{"http_": http}, {"resolved_": resolved}]


@per_session
def _cells(has_headers: bool, has_meta: bool) -> Column:
    c = F.col
    http, base = c("http_"), c("base")
    n_links, n_images = F.size(http), F.size("images")
    urls = lambda start, length: F.transform(F.slice("resolved_", start, length), lambda r: r["u"])
    targets = urls(F.lit(1), n_links)
    inside = lambda u: F.startswith(u, F.concat(U.origin_of(base), F.lit("/")))
    internal = F.size(F.filter(targets, inside))
    rel = lambda flag: F.size(F.filter(http, lambda l: F.array_contains(l["rel"], flag)))
    severity = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    outline = F.transform("headings", lambda h: F.concat(F.lit("H"), h["level"].cast("string"), F.lit(" "), h["text"]))
    declared = F.array_sort(
        F.transform(
            F.slice("resolved_", n_links + n_images + 1, F.size("hreflang")), lambda r: F.concat(r["k"], F.lit(" → "), r["u"])
        )
    )

    def header(key: str) -> Column:
        if not has_headers:
            return F.lit("")
        row = F.get(F.filter("headers", lambda h: h["key"] == key), F.lit(0))
        return F.when(row["value"] != "", F.concat(row["state"], F.lit(" · "), row["value"])).otherwise(row["state"])

    meta = lambda name: _sorted(c(name)) if has_meta else str_array([])
    rows = [
        ("Metadata", "URL", _shown(c("page_url"))),
        ("Metadata", "HTTP status", _shown(c("status") if has_meta else F.lit(""))),
        ("Metadata", "SEO score", _shown(c("score"))),
        ("Metadata", "Title", _shown(c("title"))),
        ("Metadata", "Description", _shown(c("description"))),
        ("Metadata", "Canonical", _shown(c("canonical.href"))),
        ("Metadata", "Robots", _shown(_sorted(F.transform("robots", lambda r: r["content"])), True)),
        ("Metadata", "Indexability", _shown(c("verdict"))),
        ("Headings", "Heading count", _shown(F.size("headings"))),
        ("Headings", "H1", _shown(cap_list(F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"])), True), _full(F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"]))),
        ("Headings", "Outline", _shown(cap_list(outline), True), _full(outline)),
        ("Links", "Total links", _shown(F.size("links"))),
        ("Links", "Internal HTTP links", _shown(internal)),
        ("Links", "External HTTP links", _shown(F.size(http) - internal)),
        ("Links", "nofollow links", _shown(rel("nofollow"))),
        ("Links", "sponsored links", _shown(rel("sponsored"))),
        ("Links", "UGC links", _shown(rel("ugc"))),
        ("Links", "HTTP targets", _shown(cap_list(_sorted(targets)), True), _full(_sorted(targets))),
        ("Images", "Total images", _shown(F.size("images"))),
        ("Images", "Missing alt", _shown(F.size(F.filter("images", lambda i: ~i["alt_present"])))),
        (
            "Images", "Missing dimensions",
            _shown(F.size(F.filter("images", lambda i: (i["width_attr"] == "") | (i["height_attr"] == "")))),
        ),
        ("Images", "Image sources", _shown(cap_list(_sorted(urls(n_links + 1, n_images))), True), _full(_sorted(urls(n_links + 1, n_images)))),
        ("Schema", "Schema types", _shown(schema_types(c("schemas")), True)),
        ("Schema", "Invalid JSON-LD", _shown(F.size(F.filter("schemas", lambda s: ~s["valid"])))),
        ("Hreflang", "Hreflang count", _shown(F.size("hreflang"))),
        ("Hreflang", "Declarations", _shown(cap_list(declared), True), _full(declared)),
        ("Headers", "X-Robots-Tag", _shown(meta("x_robots"), True)),
        ("Headers", "Content-Type", _shown(meta("content_type"), True)),
        ("Headers", "Content-Language", _shown(meta("content_language"), True)),
        ("Headers", "Cache-Control", _shown(meta("cache_control"), True)),
        ("Headers", "Content-Security-Policy", _shown(header("csp"))),
        ("Headers", "Strict-Transport-Security", _shown(header("hsts"))),
        ("Headers", "X-Frame-Options", _shown(header("xfo"))),
        ("Headers", "Referrer-Policy", _shown(header("referrer"))),
        ("Headers", "Permissions-Policy", _shown(header("permissions"))),
        ("Headers", "X-Content-Type-Options", _shown(header("xcto"))),
        ("Issues", "Critical issues", _shown(severity("critical"))),
        ("Issues", "Warnings", _shown(severity("warning"))),
        ("Issues", "Total issues", _shown(F.size("issues"))),
        ("Issues", "Issue IDs", _shown(_sorted(F.transform("issues", lambda i: i["id"])), True)),
    ]
    return F.array(*[
        F.struct(F.lit(g).alias("category"), F.lit(f).alias("field"), v.alias("value"), (full[0] if full else v).alias("full")) for g, f, v, *full in rows
    ])


def compare_summary(reports: DataFrame) -> DataFrame:
    """``page_id, cells``: the forty displayed values of each page report."""
    have = set(reports.columns)
    for stage in _lists():
        reports = settled(reports, stage)
    return settled(reports, {"cells": _cells("headers" in have, "x_robots" in have)}).select("page_id", "cells")


def compare_pages(summaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair_id, category, field, left, right, equal`` for every pair; two joins by page."""
    left = pairs.join(summaries.select(F.col("page_id").alias("left_id"), F.col("cells").alias("l")), "left_id")
    both = left.join(summaries.select(F.col("page_id").alias("right_id"), F.col("cells").alias("r")), "right_id")
    rows = both.select("pair_id", F.explode(F.arrays_zip("l", "r")).alias("z"))
    return rows.select(
        "pair_id", "z.l.category", "z.l.field", F.col("z.l.value").alias("left"), F.col("z.r.value").alias("right"),
        (F.col("z.l.full") == F.col("z.r.full")).alias("equal"),
    )


def compare_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pair_id").agg(
        F.count("*").alias("rows"), F.count_if(~F.col("equal")).alias("changed"), F.count_if("equal").alias("same")
    )
