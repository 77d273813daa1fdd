"""Product and category page audits on facts, JSON-LD nodes and page types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import clean, keep_true, per_session, settled, str_array
from .extract import link_kind
from .schema import field

OUT_OF_STOCK = ["outofstock", "discontinued"]
_WORD = r"(?i)(?:^|[,\s]){}(?:$|[,\s])"


def _robots_word(values: Column, word: str) -> Column:
    return F.exists(values, lambda v: v.rlike(_WORD.format(word)))


def _same(a: Column, b: Column) -> Column:
    return (a != "") & (a == b)


def _codes(*pairs: tuple[Column, str, str]) -> Column:
    return keep_true(
        *[(cond, F.struct(F.lit(code).alias("id"), F.lit(sev).alias("severity"))) for cond, code, sev in pairs]
    )


@per_session
def _canonical_columns() -> list[dict[str, Column]]:
    """Comparable page and canonical URLs and whether they agree."""
    c = F.col
    return [
        {"cur": U.http_url(c("url")), "can_raw": clean(c("canonical.href")), "can": U.http_url(c("canonical.href"))},
        {"cur_origin": U.url_origin(c("cur")), "can_origin": U.url_origin(c("can"))},
    ]


def _with_canonical(df: DataFrame) -> DataFrame:
    for stage in _canonical_columns():
        df = settled(df, stage)
    known = (F.col("cur_origin") != "") & (F.col("can_origin") != "")
    return df.withColumns(
        {
            "self_canonical": _same(F.col("cur"), F.col("can")),
            "cross_origin": known & (F.col("cur_origin") != F.col("can_origin")),
        }
    )


def product_audit(df: DataFrame) -> DataFrame:
    """Product issues, hints and stock state.

    Needs the columns of ``schema.product_fields``, ``page_type``, ``robots`` and
    ``canonical``. Pages that are no product pages come out with ``applicable`` false.
    """
    c = F.col
    out = settled(
        _with_canonical(df),
        {
            "variants": U.variant_params(c("url")),
            "base_url": U.strip_variant_params(c("url")),
            "applicable": (c("page_type")["primary"] == "product") | (F.size("products") > 0) | (F.size("groups") > 0),
        },
    )
    out = settled(
        out,
        {
            "base_variant": (F.size("variants") > 0) & (c("can_raw") != "") & _same(c("base_url"), c("can")),
            # Counted as written; brought to one form only to compare.
            "variant_urls": F.array_distinct(F.filter(F.transform("products", lambda n: field(n, "url")), lambda v: v != "")),
            "out_of_stock": (F.size("states") > 0) & F.forall("states", lambda s: s.isin(OUT_OF_STOCK)),
            "discontinued": F.array_contains("states", "discontinued"),
        },
    )
    described = (F.size("products") > 0) | (F.size("groups") > 0)
    no_can, many = c("can_raw") == "", c("canonical")["count"] > 1
    has_variant, offers = F.size("variants") > 0, c("offer_count") > 0
    noindex = _robots_word(F.transform("robots", lambda r: r["content"]), "noindex")
    elsewhere = ~c("self_canonical") & ~c("base_variant")
    issues = _codes(
        ((c("page_type")["primary"] == "product") & ~described, "product.schema.missing", "critical"),
        (described & (c("name") == ""), "product.name.missing", "critical"),
        (described & (F.size("images") == 0), "product.image.missing", "warning"),
        (described & ~offers, "product.offers.missing", "warning"),
        (offers & (c("price") == ""), "product.price.missing", "warning"),
        (offers & (c("currency") == ""), "product.currency.missing", "warning"),
        (offers & (F.size("states") == 0), "product.availability.missing", "warning"),
        (c("breadcrumbs") == 0, "product.breadcrumb.missing", "warning"),
        (no_can, "product.canonical.missing", "warning"),
        (~no_can & many, "product.canonical.multiple", "critical"),
        (~no_can & ~many & c("cross_origin"), "product.canonical.cross_origin", "warning"),
        (~no_can & ~many & ~c("cross_origin") & elsewhere, "product.canonical.different", "warning"),
        (has_variant & no_can, "product.variant.canonical_missing", "warning"),
        (has_variant & ~no_can & elsewhere, "product.variant.canonical_unexpected", "warning"),
        (
            (F.size("groups") > 0) & (F.size("variant_urls") > 1) & ~no_can
            & F.exists("variant_urls", lambda u: _same(U.http_url(u), c("can"))) & ~c("self_canonical"),
            "product.variant.group_to_variant", "warning",
        ),
        (c("out_of_stock") & noindex, "product.stock.noindex", "warning"),
    )
    no_review = (c("rating") == "") & (c("reviews") == "")
    hints = keep_true(
        (c("gtin") == "", F.lit("gtin")),
        (c("sku") == "", F.lit("sku")),
        (c("brand") == "", F.lit("brand")),
        (no_review, F.lit("reviews")),
        (c("base_variant"), F.lit("variant-base-canonical")),
        (has_variant & c("self_canonical"), F.lit("variant-self-canonical")),
        (c("out_of_stock"), F.when(c("discontinued"), F.lit("discontinued")).otherwise(F.lit("out-of-stock"))),
    )
    none = F.array().cast("array<struct<id:string,severity:string>>")
    # Whoever explodes the issues would have them computed twice, for a filter on their number and for themselves.
    return settled(
        out,
        {
            "product_issues": F.when(c("applicable"), issues).otherwise(none),
            "product_hints": F.when(c("applicable"), hints).otherwise(str_array([])),
        },
    )


def robots_state(meta: Column, header: Column) -> Column:
    """``struct(noindex, index)`` over meta and header values."""
    both = F.concat(meta, header)
    return F.struct(_robots_word(both, "noindex").alias("noindex"), _robots_word(both, "index").alias("index"))


def param_links(links: DataFrame) -> DataFrame:
    """Internal links whose URL carries filter, sort, tracking or session parameters."""
    risky = F.filter(U.query_params(F.col("href")), lambda p: p["kind"].isin("filter", "sort", "tracking", "session"))
    return (
        links.where("internal AND kind = 'http'").withColumn("params", risky).where(F.size("params") > 0)
    )


def pager_links(links: DataFrame) -> DataFrame:
    """Internal links that lead to another page of a series, once per page and target."""
    looks = F.lower(clean(F.col("label"))).rlike(r"^(?:next|prev|previous|older|newer|\d+|[‹›«»←→])$")
    rows = links.where("internal AND kind = 'http'").withColumn("pager", U.pagination_param(F.col("href")))
    rows = rows.where(F.col("pager").isNotNull() | looks).where("norm <> ''")
    first = rows.groupBy("page_id", "norm").agg(F.min_by(F.struct("idx", "label", "pager"), "idx").alias("f"))
    return first.select("page_id", F.col("norm").alias("href"), "f.idx", "f.label", F.col("f.pager.number").alias("page"))


def _resolved_links(df: DataFrame) -> DataFrame:
    """Counts of parameterised and pager links, from the page's own link array (no join)."""
    base = F.col("base")
    internal = F.filter(
        F.transform(
            F.filter("links", lambda l: link_kind(l["raw_href"]) == "http"),
            lambda l: F.struct(U.http_url(U.absolute_url(l["raw_href"], base)).alias("href"), l["label"].alias("label")),
        ),
        lambda l: F.startswith(F.concat(l["href"], F.lit("/")), F.concat(U.origin_of(base), F.lit("/"))),
    )
    risky = lambda u: F.exists(U.query_params(u), lambda p: p["kind"].isin("filter", "sort", "tracking", "session"))
    label = lambda l: F.lower(l["label"]).rlike(r"^(?:next|prev|previous|older|newer|\d+|[‹›«»←→])$")
    return settled(
        settled(df, {"internal_links": internal}),
        {
            "param_link_count": F.size(F.filter("internal_links", lambda l: risky(l["href"]))),
            "pager_link_count": F.size(
                F.array_distinct(
                    F.transform(
                        F.filter("internal_links", lambda l: U.pagination_param(l["href"]).isNotNull() | label(l)),
                        lambda l: l["href"],
                    )
                )
            ),
        },
    ).drop("internal_links")


def category_audit(df: DataFrame) -> DataFrame:
    """Listing issues with canonical, facet and pagination summary.

    Needs ``schema.listing_items`` columns, ``page_type``, ``signals``, ``robots``,
    ``links``, ``text_word_count``; uses ``x_robots`` when present.
    """
    c = F.col
    header = F.coalesce(c("x_robots"), str_array([])) if "x_robots" in df.columns else str_array([])
    out = settled(
        _resolved_links(_with_canonical(df)),
        {
            "params": F.coalesce(U.query_params(c("url")), F.array().cast("array<struct<name:string,value:string,kind:string>>")),
            "page_number": F.coalesce(U.pagination_param(c("url"))["number"], F.lit(1).cast("bigint")),
            "robots_flags": robots_state(F.transform("robots", lambda r: r["content"]), header),
            "item_count": F.greatest(F.size("listing"), c("signals")["product_microdata"]),
            "next_": U.http_url(c("signals")["rel_next"]),
            "prev_": U.http_url(c("signals")["rel_prev"]),
            "applicable": (c("page_type")["primary"] == "category")
            | (c("item_lists") > 0)
            | (c("signals")["itemlist_microdata"] > 0),
            "unpaged_url": U.strip_pagination(c("url")),
            "clean_base": U.strip_non_content(c("url")),
        },
    )
    kind = lambda *k: F.exists("params", lambda p: p["kind"].isin(*k))
    out = out.withColumns(
        {
            "facets": c("page_type")["faceted"] | kind("filter", "sort"),
            "noncontent": kind("tracking", "session"),
            "paged": c("page_type")["pagination"] | (c("page_number") > 1) | (c("pager_link_count") > 0),
        }
    )
    flags = c("robots_flags")
    parameterized = kind("filter", "sort", "tracking", "session")
    no_can, many, me = c("can_raw") == "", c("canonical")["count"] > 1, c("self_canonical")
    deep = c("page_number") > 1
    no_prev = c("signals")["rel_prev"] == ""
    issues = _codes(
        (no_can, "category.canonical.missing", "warning"),
        (~no_can & many, "category.canonical.multiple", "critical"),
        (~no_can & ~many & c("cross_origin"), "category.canonical.cross_origin", "warning"),
        (~no_can & ~many & ~c("cross_origin") & ~me & ~c("facets") & ~deep, "category.canonical.different", "warning"),
        (c("item_count") == 0, "category.items.empty", "warning"),
        ((c("item_count") > 0) & (c("item_count") <= 2) & (c("text_word_count") < 120), "category.items.thin", "warning"),
        (c("facets") & me & ~flags["noindex"], "category.facets.index_bloat", "warning"),
        (c("noncontent") & me & ~flags["noindex"], "category.params.noncontent_canonical", "warning"),
        (parameterized & flags["noindex"] & flags["index"], "category.params.robots_conflict", "warning"),
        (c("param_link_count") >= 10, "category.facets.internal_links", "warning"),
        (deep & no_can, "category.pagination.canonical_missing", "warning"),
        (deep & ~no_can & _same(c("unpaged_url"), c("can")), "category.pagination.canonical_first_page", "warning"),
        (deep & no_prev, "category.pagination.prev_missing", "warning"),
        (_same(c("next_"), c("cur")), "category.pagination.next_self", "warning"),
        (_same(c("prev_"), c("cur")), "category.pagination.prev_self", "warning"),
        (_same(c("next_"), c("prev_")), "category.pagination.neighbors_same", "warning"),
    )
    none = F.array().cast("array<struct<id:string,severity:string>>")
    return out.withColumn("category_issues", F.when(c("applicable"), issues).otherwise(none))
