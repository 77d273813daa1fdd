"""Page type from URL, structured data and markup signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import clean, let, per_session, settled, str_array

# Types, labels and signal words (fixed values).
LABELS = {
    "homepage": "Homepage", "product": "Product", "category": "Category / listing", "article": "Article / blog",
    "search": "Search results", "generic": "CMS / generic content", "error": "404 / error page",
    "faceted": "Faceted / filtered", "pagination": "Pagination",
}
ARTICLE_SCHEMA = ["article", "blogposting", "newsarticle", "techarticle", "scholarlyarticle", "report"]
SEARCH_PARAMS = ["q", "query", "search", "keyword", "keywords", "term"]
PAGINATION_PARAMS = ["page", "paged", "pageno", "page_no", "page-number", "pagenumber", "offset"]
FILTER_PARAMS = [
    "filter", "filters", "facet", "facets", "brand", "color", "colour", "size", "price", "min_price", "max_price", "sort", "order",
]
FACTS_NEEDED = ("open_graph", "signals", "text_word_count", "jsonld")


def url_signals(u: Column) -> Column:
    """What a URL alone says about the page, as a struct."""

    def build(s: Column) -> Column:
        raw = F.when(s["path"] == "", F.lit("/")).otherwise(s["path"])
        plus = F.replace(raw, F.lit("+"), F.lit("%2B"))
        path = F.lower(F.coalesce(F.try_url_decode(plus), raw))
        params = F.transform(
            U.search_params(s), lambda p: F.struct(F.lower(p["name"]).alias("name"), p["value"].alias("value"))
        )
        names = lambda cond: F.array_distinct(F.transform(F.filter(params, cond), lambda p: p["name"]))
        number = lambda p: F.trim(p["value"]).try_cast("double")
        return F.struct(
            s.isNotNull().alias("valid"),
            F.coalesce(path == "/", F.lit(False)).alias("homepage_path"),
            F.coalesce(path.rlike(r"(?:^|/)(?:search|search-results|results|find)(?:/|$)"), F.lit(False)).alias("search_path"),
            names(lambda p: p["name"].isin(SEARCH_PARAMS) & (clean(p["value"]) != "")).alias("search_params"),
            names(
                lambda p: p["name"].isin(FILTER_PARAMS) | p["name"].rlike(r"^(?:filter|facet)[_\[]")
            ).alias("filter_params"),
            names(
                lambda p: p["name"].isin(PAGINATION_PARAMS)
                & F.coalesce(number(p) > F.when(p["name"] == "offset", 0).otherwise(1), F.lit(False))
            ).alias("pagination_params"),
            F.coalesce(path.rlike(r"(?:^|/)(?:page|paged)/\d+(?:/|$)"), F.lit(False)).alias("pagination_path"),
        )

    return let(U.split_url(u), build)


def _evidence(cond: Column, type_: str, signal: str, weight: int, detail) -> Column:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return F.when(
        cond,
        F.struct(
            F.lit(type_).alias("type"), F.lit(signal).alias("signal"), F.lit(weight).alias("weight"), text.alias("detail")
        ),
    )


def _page_evidence(status: Column) -> Column:
    """Every signal that holds, with type and weight, before a type is chosen."""
    u, sig = F.col("url_signals"), F.col("signals")
    n = lambda t: F.size(F.filter("block_types", lambda b: F.array_contains(b, t)))
    og = F.lower(clean(F.try_element_at("open_graph", F.lit("og:type"))))
    articles = F.filter(str_array(ARTICLE_SCHEMA), lambda t: F.exists("block_types", lambda b: F.array_contains(b, t)))
    joined = lambda name: F.array_join(u[name], ", ")
    rows = [
        _evidence(status >= 400, "error", "http-status", 10, F.concat(F.lit("HTTP "), status.cast("string"))),
        _evidence(n("searchresultspage") > 0, "search", "schema", 8, "SearchResultsPage structured data"),
        _evidence(u["search_path"], "search", "url-path", 5, "Search-like URL path"),
        _evidence(
            F.size(u["search_params"]) > 0, "search", "url-parameter", 4, F.concat(F.lit("Search parameter: "), joined("search_params"))
        ),
        _evidence(
            sig["search_controls"] > 0, "search", "dom", 1, F.concat(sig["search_controls"].cast("string"), F.lit(" search control(s)"))
        ),
        _evidence(F.col("home"), "homepage", "url", 9, "Root URL path"),
        _evidence(n("product") > 0, "product", "schema", 7, "Product structured data"),
        _evidence(og == "product", "product", "open-graph", 5, "og:type=product"),
        _evidence(sig["product_microdata"] > 0, "product", "microdata", 4, "Product microdata"),
        _evidence(
            F.size(articles) > 0, "article", "schema", 7, F.concat(F.lit("Article structured data: "), F.array_join(articles, ", "))
        ),
        _evidence(og == "article", "article", "open-graph", 5, "og:type=article"),
        _evidence(
            (sig["articles"] == 1) & (F.col("text_word_count") >= 300), "article", "semantic-html", 4,
            "Single article element with substantial text",
        ),
        _evidence(n("collectionpage") > 0, "category", "schema", 7, "CollectionPage structured data"),
        _evidence(n("itemlist") > 0, "category", "schema", 6, "ItemList structured data"),
        _evidence(sig["itemlist_microdata"] > 0, "category", "microdata", 4, "ItemList microdata"),
        _evidence(
            n("product") >= 3, "category", "schema-density", 3, F.concat(n("product").cast("string"), F.lit(" Product schema blocks"))
        ),
        _evidence(F.col("faceted"), "faceted", "url-parameter", 4, F.concat(F.lit("Filter/sort parameter: "), joined("filter_params"))),
        _evidence(
            F.col("paginated"), "pagination", "pagination", 4,
            F.when(F.size(u["pagination_params"]) > 0, F.concat(F.lit("Pagination parameter: "), joined("pagination_params")))
            .when(u["pagination_path"], F.lit("Pagination URL path"))
            .otherwise(F.lit("rel=next/prev pagination signal")),
        ),
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def page_type(df: DataFrame) -> DataFrame:
    """Add ``page_type`` (a struct). Needs ``FACTS_NEEDED`` and ``schemas``; uses ``status`` when present."""
    out = df
    for stage in _stages("status" in df.columns):
        out = settled(out, stage)
    return out.drop(*_SCRATCH)


_SCRATCH = [
    "block_types", "searched", "home", "faceted", "paginated", "all_evidence", "primary", "points",
    "s_search", "s_product", "s_article", "s_category",
]


@per_session
def _stages(has_status: bool) -> list[dict[str, Column]]:
    """Columns to add, one dictionary per step."""
    status = F.coalesce(F.col("status"), F.lit(0)) if has_status else F.lit(0)
    u = F.col("url_signals")
    blocks = F.filter("schemas", lambda s: s["valid"])
    stages = [
        {
            "url_signals": url_signals(F.col("url")),
            "block_types": F.transform(blocks, lambda s: F.transform(s["types"], lambda t: F.lower(clean(t)))),
        }
    ]
    searched = u["search_path"] | (F.size(u["search_params"]) > 0)
    paged = (F.size(u["pagination_params"]) > 0) | u["pagination_path"]
    stages.append(
        {
            "searched": searched,
            "home": u["homepage_path"] & ~searched & (F.size(u["filter_params"]) == 0) & ~paged,
            "faceted": F.size(u["filter_params"]) > 0,
            "paginated": paged | (F.col("signals")["rel_next"] != "") | (F.col("signals")["rel_prev"] != ""),
        }
    )
    stages.append({"all_evidence": _page_evidence(status)})
    total = lambda t: F.aggregate(
        F.filter("all_evidence", lambda e: e["type"] == t), F.lit(0), lambda acc, e: acc + e["weight"]
    )
    schema_search = F.exists("block_types", lambda b: F.array_contains(b, "searchresultspage"))
    error, home = status >= 400, F.col("home")
    # An error page is judged before any other signal, a home page right after the search signals.
    final = lambda t: F.when(error | (home if t != "search" else F.lit(False)), F.lit(0)).otherwise(total(t))
    stages.append({f"s_{t}": final(t) for t in ("search", "product", "article", "category")})
    p, a, c, s = (F.col(f"s_{t}") for t in ("product", "article", "category", "search"))
    best = F.greatest(p, a, c)
    by_search = (schema_search | F.col("searched")) & (s >= 4)
    primary = (
        F.when(error, "error")
        .when(home, "homepage")
        .when(by_search, "search")
        .when(best < 4, "generic")
        .when(p == best, "product")
        .when(a == best, "article")
        .otherwise("category")
    )
    points = F.when(error, 10).when(home, 9).when(by_search, s).when(best < 4, 1).otherwise(best)
    stages.append({"primary": primary, "points": points})
    shown = F.filter(
        F.concat(
            "all_evidence",
            F.array(_evidence(F.col("primary") == "generic", "generic", "fallback", 1, "No stronger platform-neutral page-type signal")),
        ),
        lambda e: F.coalesce(e["type"].isin("faceted", "pagination") | (e["type"] == F.col("primary")), F.lit(False)),
    )
    ranked = F.array_sort(
        F.transform(
            shown,
            lambda e, i: F.struct((-e["weight"]).alias("w"), e["signal"].alias("signal"), i.alias("i"), e["type"].alias("type"), e["detail"].alias("detail")),
        )
    )
    label = F.coalesce(*[F.when(F.col("primary") == k, F.lit(v)) for k, v in LABELS.items()])
    result = F.struct(
        F.col("primary").alias("primary"),
        label.alias("label"),
        F.when(F.col("points") >= 7, "high").when(F.col("points") >= 4, "medium").otherwise("low").alias("confidence"),
        F.col("points").alias("score"),
        F.col("faceted").alias("faceted"),
        F.col("paginated").alias("pagination"),
        F.filter(
            F.array(F.col("primary"), F.when(F.col("faceted"), F.lit("faceted")), F.when(F.col("paginated"), F.lit("pagination"))),
            lambda x: x.isNotNull(),
        ).alias("detected"),
        F.transform(
            F.slice(ranked, 1, 8),
            lambda e: F.struct(e["type"].alias("type"), e["signal"].alias("signal"), (-e["w"]).alias("weight"), e["detail"].alias("detail")),
        ).alias("evidence"),
        s.alias("search"),
        p.alias("product"),
        a.alias("article"),
        c.alias("category"),
    )
    stages.append({"page_type": result})
    return stages


def page_traits(t: Column) -> Column:
    """Human-readable traits of a page-type struct."""
    return F.array_join(
        F.array_compact(F.array(F.when(t["faceted"], F.lit("Faceted")), F.when(t["pagination"], F.lit("Pagination")))), " · "
    )
