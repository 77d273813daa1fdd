"""JSON-LD: the product and listing data read from a page's typed nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import clean, let, per_session, settled, str_array
from ..functions.jsonld import parse_blocks


def with_schemas(facts: DataFrame) -> DataFrame:
    """Add ``schemas``: one parsed entry per JSON-LD block of the page, in order."""
    return settled(facts, {"schemas": parse_blocks(F.col("jsonld"))})


def schema_types(schemas: Column) -> Column:
    """Sorted distinct ``@type`` values over all blocks."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(schemas, lambda s: s["types"]))))


def field(node: Column, name: str) -> Column:
    """First scalar of a node property, '' when missing."""
    return F.coalesce(F.get(F.try_element_at(node["fields"], F.lit(name)), F.lit(0)), F.lit(""))


def _values(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["fields"], F.lit(name)), str_array([]))


def _kids(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["kids"], F.lit(name)), F.array().cast("array<int>"))


def has_type(node: Column, *names: str) -> Column:
    return F.exists(node["types"], lambda t: F.lower(t).isin(*names))


def product_summary(schemas: Column) -> Column:
    """``struct(name, has_offers, sku, brand)`` of the first valid block naming a Product, else NULL."""
    block = F.get(F.filter(schemas, lambda s: s["valid"] & F.array_contains(s["types"], "Product")), F.lit(0))
    node = F.get(F.filter(block["nodes"], lambda n: F.array_contains(n["types"], "Product")), F.lit(0))
    return let(
        node,
        lambda n: F.when(
            n.isNotNull(),
            F.struct(
                field(n, "name").alias("name"),
                n["offered"].alias("has_offers"),
                field(n, "sku").alias("sku"),
                field(n, "brand").alias("brand"),
            ),
        ),
    )


def schema_nodes(facts: DataFrame) -> DataFrame:
    """One row per JSON-LD object: page, block, document order, types and fields."""
    blocks = facts.select("page_id", F.posexplode("schemas").alias("block", "s")).where("s.valid")
    return blocks.select("page_id", "block", F.explode("s.nodes").alias("n")).select(
        "page_id", "block", F.col("n.ord").alias("ord"), F.col("n.types").alias("types"), F.col("n.fields").alias("fields")
    )


def schema_type_counts(facts: DataFrame) -> DataFrame:
    """Blocks per page and lower-cased type."""
    rows = facts.select("page_id", F.explode("schemas").alias("s")).where("s.valid")
    rows = rows.select("page_id", F.explode("s.types").alias("type"))
    return rows.groupBy("page_id", F.lower(clean(F.col("type"))).alias("type")).agg(F.count("*").alias("blocks"))


def normalize_availability(value: Column) -> Column:
    """Tail of a schema.org availability URL, letters and digits only."""
    tail = F.element_at(F.filter(F.split(value, "[/#]"), lambda x: x != ""), -1)
    return F.lower(F.regexp_replace(F.coalesce(F.when(value != "", tail), value), "[^A-Za-z0-9]", ""))


def _all_nodes(schemas: Column) -> Column:
    """Nodes of all valid blocks with their block number."""
    return F.flatten(
        F.transform(
            schemas,
            lambda s, b: F.transform(
                s["nodes"],
                lambda n: F.struct(
                    b.alias("block"), n["ord"].alias("ord"), n["types"].alias("types"), n["fields"].alias("fields"), n["kids"].alias("kids")
                ),
            ),
        )
    )


def with_product_nodes(facts: DataFrame) -> DataFrame:
    """Add ``nodes``, ``products``, ``groups``, ``breadcrumbs`` and ``chosen`` (products, else groups)."""
    nodes = F.col("nodes")
    typed = lambda *names: F.filter(nodes, lambda n: has_type(n, *names))
    out = settled(
        settled(facts, {"nodes": _all_nodes(F.col("schemas"))}),
        {"products": typed("product"), "groups": typed("productgroup"), "breadcrumbs": F.size(typed("breadcrumblist"))},
    )
    return out.withColumn("chosen", F.when(F.size("products") > 0, F.col("products")).otherwise(F.col("groups")))


def _first_field(nodes: Column, *names: str) -> Column:
    """First non-empty scalar, node by node and then name by name."""
    values = F.flatten(F.transform(nodes, lambda n: F.array(*[field(n, name) for name in names])))
    return F.coalesce(F.get(F.filter(values, lambda v: v != ""), F.lit(0)), F.lit(""))


def _linked(all_nodes: Column, owners: Column, name: str) -> Column:
    """Nodes that ``owners`` point to through a property, in order."""
    refs = F.flatten(
        F.transform(owners, lambda o: F.transform(_kids(o, name), lambda k: F.struct(o["block"].alias("b"), k.alias("k"))))
    )
    return F.array_distinct(refs)


def _by_key(keys: Column) -> Column:
    """Nodes named by (block, ord) keys, in key order."""
    return let(_blocks(F.col("nodes")), lambda blocks: F.transform(keys, lambda r: _at(F.col("nodes"), blocks, r["b"], r["k"])))


def _blocks(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n["block"])


def _at(nodes: Column, blocks: Column, block: Column, ord_: Column) -> Column:
    """Node by its place: nodes stand block by block in order of ``ord``, which counts from 0."""
    return F.get(nodes, (F.array_position(blocks, block) - 1 + ord_).cast("int"))


@per_session
def _offer_columns() -> tuple[dict[str, Column], dict[str, Column]]:
    nodes, chosen = F.col("nodes"), F.col("chosen")
    typed = F.transform(
        F.filter(nodes, lambda n: has_type(n, "offer", "aggregateoffer")),
        lambda n: F.struct(n["block"].alias("b"), n["ord"].alias("k")),
    )
    keys = F.array_distinct(F.concat(_linked(nodes, chosen, "offers"), typed))
    o = F.col("offer_nodes")
    raw = F.flatten(F.transform(o, lambda n: _values(n, "availability")))
    tagged = F.filter(
        F.transform(raw, lambda v, i: F.struct(v.alias("raw"), normalize_availability(v).alias("state"), i.alias("i"))),
        lambda e: e["state"] != "",
    )
    first = let(
        tagged,
        lambda all_: F.filter(all_, lambda e: ~F.exists(all_, lambda p: (p["state"] == e["state"]) & (p["i"] < e["i"]))),
    )
    return {"offer_nodes": _by_key(keys)}, {
        "offer_count": F.size(o),
        "price_": _first_field(o, "price"),
        "low_price": _first_field(o, "lowPrice"),
        "high_price": _first_field(o, "highPrice"),
        "currency": _first_field(o, "priceCurrency"),
        "offer_url": _first_field(o, "url"),
        "available_": first,
    }


def product_offers(facts: DataFrame) -> DataFrame:
    """Offer data per page from direct and typed offer nodes."""
    first, second = _offer_columns()
    out = settled(settled(facts, first), second)
    price = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("price_", "low_price", "high_price")], F.lit(""))
    return out.withColumns(
        {
            "price": price,
            "states": F.transform("available_", lambda e: e["state"]),
            "availability": F.array_join(F.transform("available_", lambda e: e["raw"]), ", "),
        }
    ).drop("price_", "offer_nodes", "available_")


@per_session
def _field_columns() -> tuple[dict[str, Column], dict[str, Column]]:
    chosen, rated = F.col("chosen"), F.col("rating_nodes")
    reviews = F.aggregate(chosen, F.lit(0), lambda acc, n: acc + F.size(_kids(n, "review")))
    filled = lambda name: F.nullif(_first_field(rated, name), F.lit(""))
    return {"rating_nodes": _by_key(_linked(F.col("nodes"), chosen, "aggregateRating"))}, {
        "name": _first_field(chosen, "name"),
        "images": F.array_distinct(F.flatten(F.transform(chosen, lambda n: _values(n, "image")))),
        "sku": _first_field(chosen, "sku"),
        "gtin": _first_field(chosen, "gtin14", "gtin13", "gtin12", "gtin8", "gtin"),
        "brand": _first_field(chosen, "brand"),
        "rating": _first_field(rated, "ratingValue"),
        "reviews": F.coalesce(
            filled("reviewCount"), filled("ratingCount"), F.when(reviews > 0, reviews.cast("string")), F.lit("")
        ),
    }


def product_fields(facts: DataFrame) -> DataFrame:
    """The ten product fields, images and completeness, on top of :func:`product_offers`."""
    first, second = _field_columns()
    out = settled(settled(facts, first), second)
    image = F.coalesce(F.get("images", F.lit(0)), F.lit(""))
    values = [F.col(c) for c in ("name", "sku", "gtin", "brand", "price", "currency", "availability", "rating", "reviews")]
    present = sum([F.when(v != "", 1).otherwise(0) for v in [*values, image]], F.lit(0))
    return out.withColumn("image", image).withColumns(
        {"present_fields": present.cast("int"), "completeness": F.floor(present * 10 + 0.5).cast("int")}
    )


@per_session
def _listing_columns() -> dict[str, Column]:
    nodes, base = F.col("nodes"), F.col("base")

    def candidate(n: Column, blocks: Column) -> Column:
        own = F.coalesce(F.nullif(field(n, "url"), F.lit("")), field(n, "@id"))
        refs = _kids(n, "item")
        item = F.when(F.size(refs) > 0, _at(nodes, blocks, n["block"], F.array_min(refs)))
        linked = F.coalesce(F.nullif(field(item, "url"), F.lit("")), F.nullif(field(item, "@id"), F.lit("")))
        return F.array(
            F.when(has_type(n, "product"), own), F.when(has_type(n, "listitem"), F.coalesce(linked, own))
        )

    from_schema = F.filter(F.flatten(let(_blocks(nodes), lambda b: F.transform(nodes, lambda n: candidate(n, b)))), lambda u: F.coalesce(u, F.lit("")) != "")
    from_markup = F.transform(F.col("signals")["listing_refs"], lambda r: U.absolute_url(r, base))
    urls = F.filter(F.transform(F.concat(from_schema, from_markup), lambda u: U.http_url(u)), lambda u: u != "")
    return {
        "listing": F.array_distinct(urls),
        "item_lists": F.size(F.filter(nodes, lambda n: has_type(n, "itemlist"))),
    }


def listing_items(facts: DataFrame) -> DataFrame:
    """Distinct listing URLs per page: products, list items, then microdata links."""
    return settled(facts, _listing_columns())
