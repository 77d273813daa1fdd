"""HTML to typed facts: one narrow stage, no shuffle, no Python.

``extract_facts`` builds only the columns asked for. References stay as written in
the nested facts; the inventories (``links``, ``images`` ...) explode them and
resolve URLs row by row, where the expression is compiled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions.core import NOT_SPACE, clean, let, per_session, settled, str_array, text_of, words_array

HINT_RELS = ["preload", "modulepreload", "preconnect", "prefetch", "dns-prefetch"]
# Elements that load resources: tag, attribute, kind, active (fixed values).
RESOURCE_TAGS = [
    ("script", "src", "javascript", True),
    ("link", "href", "css", True),
    ("iframe", "src", "iframe", True),
    ("object", "data", "object", True),
    ("embed", "src", "embed", True),
    ("form", "action", "form", True),
    ("img", "src", "image", False),
    ("audio", "src", "media", False),
    ("video", "src", "media", False),
    ("source", "src", "media", False),
]


@per_session
def _link_columns() -> tuple[Column, Column]:
    target = F.when(F.col("kind") == "http", U.absolute_url(F.col("raw_href"), F.col("base"), browser=True)).otherwise(F.col("raw_href"))
    return target, U.split_url(F.col("href"))


def link_kind(href: Column) -> Column:
    v = F.lower(F.trim(href))
    return (
        F.when(v.startswith("javascript:"), F.lit("javascript"))
        .when(v.startswith("mailto:"), F.lit("mailto"))
        .when(v.startswith("tel:"), F.lit("tel"))
        .when(v.startswith("#"), F.lit("fragment"))
        .when(v.rlike(r"^(?:https?://|/|\./|\.\./|\?)"), F.lit("http"))
        .when(v == "", F.lit("empty"))
        .otherwise(F.lit("other"))
    )


def srcset_urls(value: Column) -> Column:
    firsts = F.transform(F.split(value, ","), lambda p: F.get(F.split(F.trim(p), r"\s+"), F.lit(0)))
    return F.filter(firsts, lambda x: x != "")


def _first(arr: Column) -> Column:
    return F.coalesce(F.get(arr, F.lit(0)), F.lit(""))


def _rel(token: Column) -> Column:
    return words_array(H.attr_raw(token, "rel"))


def _metas() -> Column:
    return F.transform(
        H.elements(F.col("tok"), "meta"),
        lambda x: F.struct(
            F.lower(H.attr_raw(x["t"], "name")).alias("name"),
            H.attr_raw(x["t"], "property").alias("property"),
            H.attr(x["t"], "content").alias("content"),
        ),
    )


def _link_tags() -> Column:
    return F.transform(
        H.elements(F.col("tok"), "link"),
        lambda x: F.struct(_rel(x["t"]).alias("rel"), H.attr(x["t"], "href").alias("href"), x["t"].alias("t")),
    )


def _with_rel(token: str) -> Column:
    return F.filter(F.col("link_tags"), lambda x: F.array_contains(x["rel"], token))


def _named(*names: str) -> Column:
    return F.filter(F.col("metas"), lambda m: m["name"].isin(*names))


def _meta_content(name: str) -> Column:
    return _first(F.transform(_named(name), lambda m: m["content"]))


def _anchors() -> Column:
    """Links with an href, in order; the label is text, aria-label, title or image alt."""
    tag_only = r"""(?is)^<a(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>"""

    def one(a: Column, i: Column) -> Column:
        raw = H.attr(a, "href")
        images = F.filter(
            F.regexp_extract_all(a, F.lit(r"(?is)<img[\s/][^>]*>"), F.lit(0)), lambda t: H.has_attr(t, "alt")
        )
        pick = lambda v: F.nullif(clean(v), F.lit(""))
        label = F.coalesce(
            F.nullif(H.text_content(a), F.lit("")),
            pick(H.attr(a, "aria-label")),
            pick(H.attr(a, "title")),
            pick(H.attr(F.get(images, F.lit(0)), "alt")),
            F.lit(""),
        )
        return F.struct(
            i.cast("int").alias("idx"),
            raw.alias("raw_href"),
            label.alias("label"),
            _rel(F.regexp_extract(a, tag_only, 0)).alias("rel"),
            H.attr_raw(a, "target").alias("target"),
        )

    return F.transform(F.filter(H.runs(F.col("markup"), "a"), lambda a: H.has_attr(a, "href")), one)


def _images() -> Column:
    def one(x: Column, i: Column) -> Column:
        t = x["t"]
        return F.struct(
            i.cast("int").alias("idx"),
            H.attr(t, "src").alias("src"),
            H.has_attr(t, "alt").alias("alt_present"),
            H.attr(t, "alt").alias("alt"),
            H.attr_raw(t, "loading").alias("loading"),
            H.attr(t, "srcset").alias("srcset"),
            H.attr_raw(t, "width").alias("width_attr"),
            H.attr_raw(t, "height").alias("height_attr"),
        )

    return F.transform(H.elements(F.col("tok"), "img"), one)


def _scripts() -> Column:
    # ``let`` keeps the position out of the lambda, where it would be found again per token.
    placed = let(
        F.array_position(F.transform(F.col("tok"), lambda x: x["n"]), "/head"),
        lambda end: F.transform(
            F.col("tok"),
            lambda x, i: F.struct(x["n"].alias("n"), x["t"].alias("t"), ((i + 1) < end).alias("head")),
        ),
    )

    def one(x: Column, i: Column) -> Column:
        t = x["t"]
        kind = F.lower(F.trim(H.attr_raw(t, "type")))
        src = H.attr(t, "src")
        return F.struct(
            i.cast("int").alias("idx"),
            src.alias("src"),
            H.has_attr(t, "async").alias("async"),
            H.has_attr(t, "defer").alias("defer"),
            H.has_attr(t, "nomodule").alias("nomodule"),
            F.when(kind == "", F.lit("classic")).otherwise(kind).alias("type"),
            F.when(src != "", F.lit(0)).otherwise(F.length(H.inner_raw(t))).alias("inline_bytes"),
            x["head"].alias("in_head"),
        )

    return F.transform(F.filter(placed, lambda x: x["n"] == "script"), one)


def _jsonld() -> Column:
    blocks = F.filter(
        H.elements(F.col("tok"), "script"),
        lambda x: F.lower(F.trim(H.attr_raw(x["t"], "type"))) == "application/ld+json",
    )
    return F.transform(blocks, lambda x: F.trim(H.inner_raw(x["t"])))


def _stylesheets() -> Column:
    return F.transform(
        F.filter(F.col("link_tags"), lambda x: F.array_contains(x["rel"], "stylesheet")),
        lambda x, i: F.struct(
            i.cast("int").alias("idx"),
            x["href"].alias("href"),
            F.coalesce(F.nullif(H.attr_raw(x["t"], "media"), F.lit("")), F.lit("all")).alias("media"),
            H.has_attr(x["t"], "disabled").alias("disabled"),
        ),
    )


def _inline_styles() -> Column:
    return F.transform(
        H.elements(F.col("tok"), "style"),
        lambda x, i: F.struct(
            i.cast("int").alias("idx"),
            F.length(H.inner_raw(x["t"])).alias("bytes"),
            F.coalesce(F.nullif(H.attr_raw(x["t"], "media"), F.lit("")), F.lit("all")).alias("media"),
        ),
    )


def _hints() -> Column:
    return F.transform(
        F.filter(F.col("link_tags"), lambda x: F.arrays_overlap(x["rel"], str_array(HINT_RELS))),
        lambda x, i: F.struct(
            i.cast("int").alias("idx"),
            x["rel"].alias("rel"),
            x["href"].alias("href"),
            F.lower(H.attr_raw(x["t"], "as")).alias("as"),
            H.attr_raw(x["t"], "type").alias("type"),
            H.has_attr(x["t"], "crossorigin").alias("crossorigin"),
        ),
    )


def _resources() -> Column:
    """References that load something, as written, with their element's class."""

    def one(x: Column) -> Column:
        n, t = x["n"], x["t"]
        name_of = lambda a: [tag for tag, name, _, _ in RESOURCE_TAGS if name == a]
        ref = (
            F.when(n == "link", F.when(F.array_contains(_rel(t), "stylesheet"), H.attr(t, "href")))
            .when(n.isin(*name_of("data")), H.attr(t, "data"))
            .when(n.isin(*name_of("action")), H.attr(t, "action"))
            .otherwise(H.attr(t, "src"))
        )
        sets = F.when(n.isin("img", "source"), srcset_urls(H.attr(t, "srcset")))
        return F.struct(n.alias("tag"), ref.alias("ref"), F.coalesce(sets, str_array([])).alias("srcset"))

    return F.transform(H.elements(F.col("tok"), *[tag for tag, *_ in RESOURCE_TAGS]), one)


def _social(field: str, prefix: str) -> Column:
    """Map of lower-cased property to content; the last one wins."""
    chosen = F.reverse(F.filter(F.col("metas"), lambda m: m[field].startswith(prefix)))

    def unique(entries: Column) -> Column:
        keys = F.transform(entries, lambda m: F.lower(m[field]))
        first = F.filter(
            F.transform(entries, lambda m, i: F.struct(F.lower(m[field]).alias("k"), m["content"].alias("v"), i.alias("i"))),
            lambda e: F.array_position(keys, e["k"]) == e["i"] + 1,
        )
        return F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"], e["v"])))

    return let(chosen, unique)


def _search_controls() -> Column:
    return F.size(
        F.filter(
            F.col("tok"),
            lambda x: ~x["n"].isin("", "!", "script", "style")
            & ~x["n"].startswith("/")
            & x["t"].rlike("(?i)search")
            & (
                ((x["n"] == "input") & (F.lower(H.attr_raw(x["t"], "type")) == "search"))
                | (F.lower(H.attr_raw(x["t"], "role")) == "search")
            ),
        )
    )


def _item_types() -> Column:
    """Lower-case ``itemtype`` of the elements that have one."""
    typed = F.filter(F.col("tok"), lambda x: x["t"].startswith("<") & x["t"].rlike("^<[^>]*(?i)itemtype"))
    return F.transform(typed, lambda x: F.lower(H.attr_raw(x["t"], "itemtype")))


def _microdata(types: Column, word: str) -> Column:
    return F.size(F.filter(types, lambda v: F.contains(v, F.lit(word))))


def _neighbour(token: str) -> Column:
    in_links = _first(F.transform(F.filter(F.col("links"), lambda a: F.array_contains(a["rel"], token)), lambda a: a["raw_href"]))
    return F.coalesce(F.nullif(_first(F.transform(_with_rel(token), lambda x: x["href"])), F.lit("")), in_links)


def _signals() -> Column:
    refs = F.transform(
        F.array(_neighbour("next"), _neighbour("prev")), lambda r: U.absolute_url(r, F.col("base"))
    )
    return let(
        F.struct(refs.alias("refs"), _item_types().alias("types")),
        lambda v: F.struct(
            F.size(H.elements(F.col("tok"), "article")).alias("articles"),
            _search_controls().alias("search_controls"),
            _microdata(v["types"], "schema.org/product").alias("product_microdata"),
            _microdata(v["types"], "schema.org/itemlist").alias("itemlist_microdata"),
            F.col("listed").alias("listing_refs"),
            v["refs"][0].alias("rel_next"),
            v["refs"][1].alias("rel_prev"),
        ),
    )


def _canonical() -> Column:
    return let(
        F.transform(_with_rel("canonical"), lambda x: x["href"]),
        lambda c: F.struct(
            F.size(c).alias("count"), U.absolute_url(_first(c), F.col("base"), browser=True).alias("href"), _first(c).alias("raw")
        ),
    )


def _hreflang() -> Column:
    tagged = F.filter(_with_rel("alternate"), lambda x: H.has_attr(x["t"], "hreflang"))
    return F.transform(
        tagged,
        lambda x, i: F.struct(
            i.cast("int").alias("idx"), H.attr_raw(x["t"], "hreflang").alias("lang"), x["href"].alias("ref")
        ),
    )


def _headings() -> Column:
    return F.transform(
        H.runs(F.col("markup"), "h[1-6]"),
        lambda h, i: F.struct(
            i.cast("int").alias("idx"), F.substring(h, 3, 1).cast("int").alias("level"), H.text_content(h).alias("text")
        ),
    )


# Intermediate columns: name -> (builder, needed intermediates), in build order.
_PARTS = {
    "markup": (lambda: H.markup_only(F.col("tok")), ()),
    "metas": (_metas, ()),
    "link_tags": (_link_tags, ()),
    "walk": (lambda: H.tree_walk(F.col("tok")), ()),
    "listed": (lambda: H.listing_links(F.col("tok")), ()),
    "links": (_anchors, ("markup",)),
}

# Facts: name -> (builder, needed intermediates).
_FIELDS = {
    "page_url": (lambda: U.href(F.col("url"), browser=True), ()),
    "title": (
        lambda: clean(_first(F.transform(H.elements(F.col("tok"), "title"), lambda x: H.decode_entities(H.inner_raw(x["t"]))))),
        (),
    ),
    "description": (lambda: _meta_content("description"), ("metas",)),
    "viewport": (lambda: _meta_content("viewport"), ("metas",)),
    "lang": (lambda: _first(F.transform(H.elements(F.col("tok"), "html"), lambda x: H.attr(x["t"], "lang"))), ()),
    "canonical": (_canonical, ("link_tags",)),
    "robots": (
        lambda: F.transform(
            _named("robots", "googlebot", "bingbot"),
            lambda m: F.struct(m["name"].alias("name"), m["content"].alias("content")),
        ),
        ("metas",),
    ),
    "headings": (_headings, ("markup",)),
    "links": (lambda: F.col("links"), ("links",)),
    "images": (_images, ()),
    "hreflang": (_hreflang, ("link_tags",)),
    "jsonld": (_jsonld, ()),
    "open_graph": (lambda: _social("property", "og:"), ("metas",)),
    "twitter": (lambda: _social("name", "twitter:"), ("metas",)),
    "text_word_count": (
        lambda: F.regexp_count(text_of(H.raw_text(H.body_tokens(F.col("tok")))), F.lit(f"{NOT_SPACE}++")),
        (),
    ),
    "signals": (_signals, ("link_tags", "links", "listed")),
    "scripts": (_scripts, ()),
    "stylesheets": (_stylesheets, ("link_tags",)),
    "inline_styles": (_inline_styles, ()),
    "hints": (_hints, ("link_tags",)),
    "resources": (_resources, ()),
    "dom": (
        lambda: F.struct(F.col("walk")["nodes"].alias("nodes"), F.col("walk")["depth"].alias("max_depth")),
        ("walk",),
    ),
    "text": (
        lambda: F.struct(
            F.col("walk")["visible"].alias("visible"),
            F.col("walk")["hidden"].alias("hidden"),
            (F.col("walk")["visible"] + F.col("walk")["hidden"]).alias("all"),
            F.col("walk")["roots"].alias("roots"),
        ),
        ("walk",),
    ),
}
FACT_COLUMNS = list(_FIELDS)


@per_session
def _built(name: str, part: bool) -> Column:
    return (_PARTS if part else _FIELDS)[name][0]()


@per_session
def _source() -> dict[str, Column]:
    return {"base": U.split_url(F.col("url"), browser=True), "tok": H.tokens(F.col("html"))}


def extract_facts(pages: DataFrame, *fields: str) -> DataFrame:
    """One row of nested facts per page; all of them when no field is named."""
    fields = fields or tuple(FACT_COLUMNS)
    needed: set[str] = set()
    for field in fields:
        for part in _FIELDS[field][1]:
            needed |= {part, *_PARTS[part][1]}
    out = pages.withColumns(_source())
    first = {p: _built(p, True) for p in _PARTS if p in needed and not _PARTS[p][1]}
    second = {p: _built(p, True) for p in _PARTS if p in needed and _PARTS[p][1]}
    if "walk" in first and "listed" in first:  # walked once for both
        del first["listed"]
        second["listed"] = F.col("walk")["links"]
    for stage in (first, second):
        if stage:
            out = out.withColumns(stage)
    made = {"base": F.col("base"), **{f: _built(f, False) for f in fields}}
    staged = settled(out, {f"{k}_": v for k, v in made.items()})
    kept = [F.col(c) for c in pages.columns if c != "html"]
    return staged.select(*kept, *[F.col(f"{k}_").alias(k) for k in made])


def stages(field: str) -> list[dict[str, Column]]:
    """The columns that lead from ``url`` and ``html`` to a field, step by step."""
    needed = {q for p in _FIELDS[field][1] for q in (p, *_PARTS[p][1])}
    parts = lambda later: {p: _built(p, True) for p in _PARTS if p in needed and bool(_PARTS[p][1]) == later}
    return [s for s in (_source(), parts(False), parts(True)) if s]


def head_signals(pages: DataFrame) -> DataFrame:
    """Canonical, hreflang and robots of the head alone; text after ``</head>`` is never read, a page without it is read whole."""
    head = F.regexp_extract(F.col("html"), r"(?is)^(.*?</head)\s*>", 1)
    source = F.when(head == "", F.col("html")).otherwise(head)
    base = F.col("base")
    tags = lambda name: F.regexp_extract_all(F.col("head"), F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))
    canon = F.filter(tags("link"), lambda t: F.array_contains(_rel(t), "canonical") & (H.attr_raw(t, "href") != ""))
    alternates = F.filter(
        tags("link"),
        lambda t: F.array_contains(_rel(t), "alternate")
        & (H.attr_raw(t, "hreflang") != "")
        & (H.attr_raw(t, "href") != ""),
    )
    robots = F.filter(
        tags("meta"),
        lambda t: F.lower(H.attr_raw(t, "name")).isin("robots", "googlebot") & H.has_attr(t, "content"),
    )
    return pages.withColumns({"base": U.split_url(F.col("url")), "head": source}).select(
        *[F.col(c) for c in pages.columns if c != "html"],
        F.transform(canon, lambda t: U.absolute_url(H.attr(t, "href"), base)).alias("canonical"),
        F.transform(
            alternates,
            lambda t: F.struct(
                H.attr_raw(t, "hreflang").alias("lang"), U.absolute_url(H.attr(t, "href"), base).alias("href")
            ),
        ).alias("hreflang"),
        F.transform(
            robots, lambda t: F.struct(F.lower(H.attr_raw(t, "name")).alias("name"), H.attr(t, "content").alias("content"))
        ).alias("robots"),
    )


def _need(pages: DataFrame, field: str) -> DataFrame:
    return pages if field in pages.columns else extract_facts(pages, field)


def explode_items(facts: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per element of an array column, with ``page_id`` and the columns in ``keep``."""
    return facts.select("page_id", *keep, F.explode(column).alias("item")).select("page_id", *keep, "item.*")


def _no_fragment(u: Column) -> Column:
    return F.regexp_replace(u, "#.*$", "")


def links(pages: DataFrame) -> DataFrame:
    """Edge table: one row per ``<a href>`` with resolved URL, label, kind and rel flags."""
    rows = explode_items(_need(pages, "links"), "links", "url", "base").withColumn("kind", link_kind(F.col("raw_href")))
    target, parts = _link_columns()
    rows = settled(rows, {"href": target})
    rows = settled(rows, {"parts": parts})
    return rows.select(
        "page_id",
        F.col("url").alias("page_url"),
        "idx",
        "href",
        "raw_href",
        "label",
        "kind",
        ((F.col("kind") == "http") & F.coalesce(U.origin_of(F.col("parts")) == U.origin_of(F.col("base")), F.lit(False))).alias(
            "internal"
        ),
        *[F.array_contains("rel", flag).alias(flag) for flag in ("nofollow", "sponsored", "ugc")],
        "target",
        F.coalesce(F.when(F.col("kind") == "http", U.href_of(F.col("parts"))), F.lit("")).alias("norm"),
        F.coalesce(U.hostname_of(F.col("parts")), F.lit("")).alias("host"),
    )


def images(pages: DataFrame) -> DataFrame:
    rows = explode_items(_need(pages, "images"), "images", "url", "base")
    return rows.withColumn("src", U.absolute_url(F.col("src"), F.col("base"), browser=True)).drop("base").withColumnRenamed("url", "page_url")


def hreflang(pages: DataFrame) -> DataFrame:
    rows = explode_items(_need(pages, "hreflang"), "hreflang", "url", "base")
    return rows.select(
        "page_id", F.col("url").alias("page_url"), "idx", "lang", U.absolute_url(F.col("ref"), F.col("base"), browser=True).alias("href")
    )


def _asset(rows: DataFrame, ref: str) -> DataFrame:
    """Add url, host and third_party for the reference column ``ref``."""
    url = _no_fragment(U.absolute_url(F.col(ref), F.col("base"), browser=True))
    rows = rows.withColumn("asset_url", url).withColumn("parts", U.split_url(F.col("asset_url")))
    return rows.withColumns(
        {
            "host": F.coalesce(U.hostname_of(F.col("parts")), F.lit("")),
            "third_party": F.coalesce(U.origin_of(F.col("parts")) != U.origin_of(F.col("base")), F.lit(False)),
        }
    ).drop("parts")


def scripts(pages: DataFrame) -> DataFrame:
    rows = _asset(explode_items(_need(pages, "scripts"), "scripts", "url", "base"), "src")
    return rows.select(
        "page_id",
        F.col("url").alias("page_url"),
        "idx",
        (F.col("src") != "").alias("external"),
        F.col("asset_url").alias("url"),
        "host",
        "third_party",
        "async",
        "defer",
        (F.col("type") == "module").alias("module"),
        "nomodule",
        "type",
        "inline_bytes",
        "in_head",
    )


def stylesheets(pages: DataFrame) -> DataFrame:
    rows = _asset(explode_items(_need(pages, "stylesheets"), "stylesheets", "url", "base"), "href")
    return rows.select(
        "page_id", F.col("url").alias("page_url"), "idx", F.col("asset_url").alias("url"), "host", "third_party", "media", "disabled"
    )


def resource_hints(pages: DataFrame) -> DataFrame:
    rows = explode_items(_need(pages, "hints"), "hints", "url", "base")
    return rows.select(
        "page_id",
        F.col("url").alias("page_url"),
        "idx",
        F.array_join("rel", " ").alias("rel"),
        _no_fragment(U.absolute_url(F.col("href"), F.col("base"))).alias("url"),
        F.col("as"),
        "type",
        "crossorigin",
    )


@per_session
def _resource_url() -> Column:
    return _no_fragment(U.absolute_url(F.col("ref"), F.col("base"), browser=True))


def dom_resources(pages: DataFrame, insecure: bool = False) -> DataFrame:
    """Resource URLs referenced by elements and srcset lists, active or passive.

    ``insecure`` keeps the http resources of https pages: as every other reference resolves
    to https there, the rest goes before anything is exploded or resolved.
    """
    facts = _need(pages.where("url ILIKE 'https:%'") if insecure else pages, "resources")
    if insecure:
        http = lambda r: F.translate(F.coalesce(r, F.lit("")), "\t\n\r", "").rlike(r"(?i)^[\x00-\x20]*http:")
        kept = F.transform("resources", lambda x: F.struct(x["tag"].alias("tag"), F.when(http(x["ref"]), x["ref"]).alias("ref"), F.filter(x["srcset"], http).alias("srcset")))
        facts = facts.withColumn("resources", F.filter(kept, lambda x: x["ref"].isNotNull() | (F.size(x["srcset"]) > 0)))
    rows = explode_items(facts, "resources", "url", "base")
    pick = lambda index: F.coalesce(
        *[F.when(F.col("tag") == t[0], F.lit(t[index])) for t in RESOURCE_TAGS]
    )
    direct = F.array(
        F.struct(F.col("ref").alias("ref"), pick(2).alias("kind"), F.lit("dom").alias("source"), pick(3).alias("active"))
    )
    listed = F.transform(
        F.col("srcset"),
        lambda r: F.struct(r.alias("ref"), F.lit("image").alias("kind"), F.lit("srcset").alias("source"), F.lit(False).alias("active")),
    )
    out = rows.select("page_id", "url", "base", F.explode(F.concat(direct, listed)).alias("r")).select("page_id", "url", "base", "r.*")
    resolved = settled(out.where(F.coalesce(F.col("ref"), F.lit("")) != ""), {"resource_url": _resource_url()})
    return resolved.where(F.col("resource_url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")).select(
        "page_id", F.col("url").alias("page_url"), F.col("resource_url").alias("url"), "kind", "source", "active"
    )
