"""Corpus-wide inventories: URLs, parameters, directives, anchors, resources, header policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import per_session, settled
from . import content as C
from . import links as L
from .hreflangs import valid_tag
from .indexability import robots_directives
from .robots import rule_weight
from .security import csp_risks, parse_csp, parse_hsts


@per_session
def _url_columns() -> dict:
    parts = U.split_url(F.col("url"), browser=True)
    return {"parts": parts, "norm": U.normalize_url(F.col("url"), browser=True), "breadcrumb": U.url_breadcrumb(F.col("url"))}


def url_inventory(pages: DataFrame) -> DataFrame:
    """``page_id, norm, scheme, host, origin, breadcrumb`` per page."""
    rows = settled(pages.select("page_id", "url"), _url_columns())
    return rows.select(
        "page_id", "norm", F.col("parts.scheme").alias("scheme"), U.hostname_of(F.col("parts")).alias("host"),
        U.origin_of(F.col("parts")).alias("origin"), "breadcrumb",
    )


def collapsing_urls(pages: DataFrame) -> DataFrame:
    """Comparable URLs shared by several pages."""
    return url_inventory(pages).groupBy("norm").agg(F.count("*").alias("pages")).where("pages > 1")


def param_usage(urls: DataFrame) -> DataFrame:
    """``kind, name, uses, distinct_values`` over a ``url`` column."""
    rows = urls.select(F.explode(U.query_params(F.col("url"))).alias("p")).select("p.*")
    pairs = rows.groupBy("kind", F.lower("name").alias("name"), "value").agg(F.count("*").alias("n"))
    return pairs.groupBy("kind", "name").agg(F.sum("n").alias("uses"), F.count("*").alias("distinct_values"))


def merging_urls(urls: DataFrame) -> DataFrame:
    """Content URLs that several distinct URLs reduce to once non-content parameters are gone."""
    rows = settled(urls.select("url"), {"norm": U.http_url(F.col("url")), "content": U.strip_non_content(F.col("url"))})
    distinct = rows.where("norm <> ''").groupBy("content", "norm").agg(F.count("*").alias("n"))
    return distinct.groupBy("content").agg(F.count("*").alias("variants"), F.sum("n").alias("links")).where("variants > 1")


def directive_census(facts: DataFrame) -> DataFrame:
    """``kind, value, valid, pages``: robots directives, hreflang tags and page languages."""
    entry = lambda kind, value, valid: F.struct(F.lit(kind).alias("kind"), value.alias("value"), valid.alias("valid"))
    directives = F.transform(
        robots_directives(F.transform("robots", lambda r: r["content"])), lambda d: entry("directive", d, F.lit(True))
    )
    tags = F.transform(
        F.array_distinct(F.transform("hreflang", lambda h: F.lower(F.trim(h["lang"])))), lambda t: entry("hreflang", t, valid_tag(t))
    )
    lang = F.array(entry("lang", C.normalize_language(F.col("lang")), C.valid_language(F.col("lang"))))
    rows = facts.select(F.explode(F.concat(directives, tags, lang)).alias("e")).select("e.*")
    return rows.groupBy("kind", "value", "valid").agg(F.count("*").alias("pages"))


def text_profile(links: DataFrame) -> DataFrame:
    """Anchors per source host: links, words, mean pixel width, generic share."""
    host = F.regexp_extract("page_url", r"^https?://([^/:?#]+)", 1)
    rows = settled(
        links.where("kind = 'http'").withColumn("source_host", host),
        {"px": C.text_width_px(F.col("label"), 14), "words": C.word_count(F.col("label"))},
    )
    return rows.groupBy("source_host").agg(
        F.count("*").alias("links"),
        F.sum("words").alias("words"),
        F.sum("px").alias("pixels"),
        F.count_if(L.is_generic_anchor(F.col("label"))).alias("generic"),
    )


def resource_census(resources: DataFrame) -> DataFrame:
    """``kind, format, size_class, host_class`` with request counts and bytes."""
    from .images import image_format
    from .timing import classify_host

    size = (
        F.when(F.col("size_bytes") == 0, "unknown")
        .when(F.col("size_bytes") < 10 * 1024, "small")
        .when(F.col("size_bytes") < 100 * 1024, "medium")
        .otherwise("large")
    )
    rows = settled(
        resources,
        {"format": image_format(F.lit(""), F.col("url")), "host_class": classify_host(U.url_host(F.col("url")))["category"]},
    )
    return rows.groupBy("kind", "format", size.alias("size_class"), "host_class").agg(
        F.count("*").alias("requests"), F.sum("size_bytes").alias("bytes")
    )


def policy_census(meta: DataFrame) -> DataFrame:
    """``policy, item, responses``: CSP directives and risks, HSTS strength."""
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    csp, hsts = first("content_security_policy"), first("strict_transport_security")
    item = lambda policy, value: F.struct(F.lit(policy).alias("policy"), value.alias("item"))
    h = parse_hsts(hsts)
    strength = (
        F.when(hsts == "", F.lit("missing")).when(F.coalesce(h["max_age"], F.lit(0)) == 0, F.lit("weak")).otherwise(F.lit("strong"))
    )
    rows = meta.select(
        F.explode(
            F.concat(
                F.transform(F.map_keys(parse_csp(csp)), lambda d: item("csp", d)),
                F.transform(csp_risks(csp), lambda r: item("csp-risk", r)),
                F.array(item("hsts", strength)),
            )
        ).alias("e")
    ).select("e.*")
    return rows.groupBy("policy", "item").agg(F.count("*").alias("responses"))


def robots_weight_census(rules: DataFrame) -> DataFrame:
    """Rules per type and path weight."""
    return rules.groupBy("type", rule_weight(F.col("path")).alias("weight")).agg(F.count("*").alias("rules"))
