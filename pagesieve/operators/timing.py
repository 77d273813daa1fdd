"""Resource and navigation timing, assets, third parties, render hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import keep_true, let, per_session, settled, str_array

RESOURCE_LIMIT = 1000
LARGE_JS = 250 * 1024
LARGE_CSS = 100 * 1024
KINDS = ["document", "javascript", "css", "image", "font", "fetch", "media", "other"]
# Initiator types and file endings by kind, first match wins (fixed values).
KIND_RULES = [
    ("javascript", ["script"], ["js", "mjs", "cjs"]),
    ("css", ["css"], ["css"]),
    ("image", ["img", "image"], ["jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico"]),
    ("font", ["font"], ["woff", "woff2", "ttf", "otf", "eot"]),
    ("document", ["iframe", "frame", "navigation"], []),
    ("fetch", ["fetch", "xmlhttprequest"], []),
    ("media", ["audio", "video", "track"], ["mp3", "mp4", "webm", "ogg", "wav"]),
]
# Known service domains by category, in rule order (fixed values).
SERVICES = [
    ("tag-manager", ["googletagmanager.com", "tealiumiq.com", "tagcommander.com"]),
    (
        "analytics",
        [
            "google-analytics.com", "analytics.google.com", "hotjar.com", "clarity.ms", "segment.com", "segment.io", "amplitude.com",
            "mixpanel.com", "matomo.cloud", "plausible.io",
        ],
    ),
    ("ad", ["doubleclick.net", "googlesyndication.com", "adnxs.com", "criteo.com", "criteo.net"]),
    ("widget", ["intercom.io", "intercomcdn.com", "crisp.chat", "zendesk.com", "zdassets.com", "tawk.to", "drift.com"]),
    ("cdn", ["jsdelivr.net", "cdnjs.cloudflare.com", "unpkg.com", "cloudfront.net", "fastly.net", "akamaized.net", "akamaihd.net"]),
]


def file_extension(url: Column) -> Column:
    path = F.coalesce(U.url_path(url), F.regexp_replace(url, "[?#].*$", ""))
    return F.regexp_extract(F.lower(path), r"\.([a-z0-9]{1,8})$", 1)


def resource_kind(initiator: Column, url: Column) -> Column:
    kind = F.lower(F.coalesce(initiator, F.lit("")))

    def pick(ext: Column) -> Column:
        cases = [
            F.when(kind.isin(*types) | (ext.isin(*exts) if exts else F.lit(False)), F.lit(name)) for name, types, exts in KIND_RULES
        ]
        return F.coalesce(*cases, F.lit("other"))

    return let(file_extension(url), pick)


def _ms(value: Column) -> Column:
    """Non-negative milliseconds, rounded half-up to one decimal."""
    return F.floor(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)) * 10 + 0.5) / 10


def serialize_resources(timing: DataFrame) -> DataFrame:
    """Typed resource rows: kind, third_party, rounded times, best known size and its source.

    ``timing``: ``page_id, page_url, url, initiator, start_ms, duration_ms,
    transfer_bytes, encoded_bytes``; all other columns are kept.
    """
    size = F.coalesce(
        F.when(F.col("transfer_bytes") > 0, F.col("transfer_bytes")), F.when(F.col("encoded_bytes") > 0, F.col("encoded_bytes")), F.lit(0)
    )
    source = (
        F.when(F.col("transfer_bytes") > 0, "transferSize").when(F.col("encoded_bytes") > 0, "encodedBodySize").otherwise("")
    )
    rows = settled(
        timing,
        {
            "kind": resource_kind(F.col("initiator"), F.col("url")),
            "third_party": U.is_third_party(F.col("url"), F.col("page_url")),
            "url": U.normalize_url(F.col("url"), "raw"),
        },
    )
    return rows.withColumns(
        {"start_ms": _ms(F.col("start_ms")), "duration_ms": _ms(F.col("duration_ms")), "size_bytes": size.cast("bigint"), "size_source": source}
    )


def first_resources(resources: DataFrame, limit: int = RESOURCE_LIMIT) -> DataFrame:
    """The first ``limit`` requests of each page by start, as a browser's timing buffer keeps them."""
    w = Window.partitionBy("page_id").orderBy("start_ms", "resource_id")
    return resources.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= limit).drop("rn_")


def resource_summary(resources: DataFrame) -> DataFrame:
    """Requests, bytes and known sizes per page, by kind and for third parties, in one aggregation."""
    c = F.col
    known = c("size_bytes") > 0
    per_kind = []
    for k in KINDS:
        mine = c("kind") == k
        per_kind += [
            F.count_if(mine).alias(f"{k}_count"),
            F.coalesce(F.sum(F.when(mine, c("size_bytes"))), F.lit(0)).alias(f"{k}_bytes"),
        ]
    return resources.groupBy("page_id").agg(
        F.count("*").alias("requests"),
        F.sum("size_bytes").alias("total_bytes"),
        F.count_if(known).alias("known_sizes"),
        F.count_if(~known).alias("unknown_sizes"),
        F.count_if("third_party").alias("third_party_count"),
        F.coalesce(F.sum(F.when(c("third_party"), c("size_bytes"))), F.lit(0)).alias("third_party_bytes"),
        *per_kind,
    )


def navigation(nav: DataFrame) -> DataFrame:
    """Derived navigation timings in milliseconds."""
    c = F.col
    n = lambda name: F.greatest(F.coalesce(c(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    gap = lambda end, start: F.when(n(end) >= n(start), _ms(n(end) - n(start))).otherwise(F.lit(0.0))
    first = F.coalesce(F.nullif(n("duration"), F.lit(0.0)), F.nullif(n("load_event_end"), F.lit(0.0)), n("response_end"))
    return nav.select(
        "page_id",
        gap("response_start", "request_start").alias("ttfb"),
        _ms(n("response_start")).alias("response_start"),
        gap("response_end", "response_start").alias("download"),
        gap("domain_lookup_end", "domain_lookup_start").alias("dns"),
        gap("connect_end", "connect_start").alias("connect"),
        F.when(n("secure_connection_start") > 0, gap("connect_end", "secure_connection_start")).otherwise(F.lit(0.0)).alias("tls"),
        _ms(n("dom_content_loaded_end")).alias("dom_content_loaded"),
        _ms(n("load_event_end")).alias("load"),
        _ms(first).alias("total"),
    )


def top_resources(resources: DataFrame, k: int = 20, by: str = "size_bytes") -> DataFrame:
    """The ``k`` largest or slowest resources of each page (a top-k report)."""
    other = "duration_ms" if by == "size_bytes" else "size_bytes"
    w = Window.partitionBy("page_id").orderBy(F.desc(by), F.desc(other), "resource_id")
    return resources.where(F.col(by) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- assets ---


def _asset_sizes(resources: DataFrame, kind: str) -> DataFrame:
    """Largest entry per page and URL of one kind."""
    rows = resources.where(F.col("kind") == kind)
    best = rows.groupBy("page_id", "url").agg(F.max_by(F.struct("size_bytes", "duration_ms"), "size_bytes").alias("b"))
    return best.select("page_id", "url", "b.*")


def asset_sizes(assets: DataFrame, resources: DataFrame, kind: str) -> DataFrame:
    """Scripts or stylesheets with the size and duration of their request."""
    out = assets.join(_asset_sizes(resources, kind), ["page_id", "url"], "left")
    return out.withColumns(
        {
            "timed": F.col("size_bytes").isNotNull(),
            "size_bytes": F.coalesce("size_bytes", F.lit(0).cast("bigint")),
            "duration_ms": F.coalesce("duration_ms", F.lit(0.0)),
            "size_known": F.coalesce(F.col("size_bytes") > 0, F.lit(False)),
        }
    )


def asset_duplicates(assets: DataFrame) -> DataFrame:
    """URLs a page includes more than once."""
    return assets.where("url <> ''").groupBy("page_id", "url").agg(F.count("*").alias("uses")).where("uses > 1")


def script_summary(scripts: DataFrame) -> DataFrame:
    flag = lambda cond, name: F.count_if(cond).alias(name)
    c = F.col
    return scripts.groupBy("page_id").agg(
        F.count("*").alias("total"),
        flag(c("external"), "external"),
        flag(~c("external"), "inline"),
        flag(c("async"), "async_scripts"),
        flag(c("defer"), "defer_scripts"),
        flag(c("module"), "module_scripts"),
        flag(c("nomodule"), "nomodule_scripts"),
        flag(c("external") & c("third_party"), "third_party"),
    )


def script_groups(sized: DataFrame) -> DataFrame:
    """Third-party script hosts per page with counts and known bytes."""
    rows = sized.where("external AND third_party AND host <> ''")
    return rows.groupBy("page_id", "host").agg(
        F.count("*").alias("scripts"),
        F.coalesce(F.sum(F.when(F.col("size_known"), F.col("size_bytes"))), F.lit(0)).alias("known_bytes"),
        F.count_if("size_known").alias("known_sizes"),
    )


def asset_issues(scripts: DataFrame, stylesheets: DataFrame) -> DataFrame:
    """``page_id, code, assets``: duplicate and large scripts and stylesheets."""
    tag = lambda df, code: df.groupBy("page_id").agg(F.count("*").alias("assets")).select("page_id", F.lit(code).alias("code"), "assets")
    return (
        tag(asset_duplicates(scripts.where("external")), "duplicate-js")
        .unionByName(tag(asset_duplicates(stylesheets), "duplicate-css"))
        .unionByName(tag(scripts.where(F.col("external") & (F.col("size_bytes") >= LARGE_JS)), "large-js"))
        .unionByName(tag(stylesheets.where(F.col("size_bytes") >= LARGE_CSS), "large-css"))
    )


# --- third parties ---


def classify_host(host: Column) -> Column:
    """``struct(category, confidence)`` of a host by known domain suffix, then by a CDN-like name."""
    known = F.coalesce(
        *[
            F.when(F.lower(host).rlike(r"(?:^|\.)(?:" + "|".join(d.replace(".", r"\.") for d in domains) + ")$"), F.lit(category))
            for category, domains in SERVICES
        ]
    )
    cdn_like = F.lower(host).startswith("cdn.") | F.contains(F.lower(host), F.lit(".cdn."))
    return F.struct(
        F.coalesce(known, F.when(cdn_like, F.lit("cdn")), F.lit("other")).alias("category"),
        F.when(known.isNotNull(), "known-domain").when(cdn_like, "hostname-heuristic").otherwise("unclassified").alias("confidence"),
    )


def third_party(resources: DataFrame, scope: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Third-party hosts with requests, bytes, durations and their category.

    The regular-expression test runs once per host after the aggregation, not per request.
    """
    rows = settled(resources.where("third_party"), {"host": U.url_host(F.col("url"))}).where("host <> ''")
    groups = rows.groupBy(*scope, "host").agg(
        F.count("*").alias("requests"),
        F.sum("size_bytes").alias("known_bytes"),
        F.count_if(F.col("size_bytes") > 0).alias("known_sizes"),
        F.sum("duration_ms").alias("duration_ms"),
    )
    return settled(groups, {"class": classify_host(F.col("host"))}).select("*", "class.category", "class.confidence").drop("class")


def third_party_types(resources: DataFrame) -> DataFrame:
    """Requests per third-party host and kind."""
    rows = settled(resources.where("third_party"), {"host": U.url_host(F.col("url"))}).where("host <> ''")
    return rows.groupBy("host", "kind").agg(F.count("*").alias("requests"))


def third_party_samples(resources: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` distinct URLs per third-party host (the report's sample)."""
    rows = settled(resources.where("third_party"), {"host": U.url_host(F.col("url"))}).where("host <> ''")
    first = rows.groupBy("host", "url").agg(F.min("resource_id").alias("first"))
    w = Window.partitionBy("host").orderBy("first", "url")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def category_summary(groups: DataFrame) -> DataFrame:
    return groups.groupBy("category").agg(
        F.countDistinct("host").alias("domains"), F.sum("requests").alias("requests"), F.sum("known_bytes").alias("known_bytes"),
        F.sum("known_sizes").alias("known_sizes"),
    )


def third_party_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.countDistinct("host").alias("domains"), F.sum("requests").alias("requests"), F.sum("known_bytes").alias("known_bytes"),
        F.sum("known_sizes").alias("known_sizes"),
    )


# --- render hints over a render log ---

BELOW_FOLD = 1.5
MIN_EAGER_AREA = 10000


@per_session
def _zone(height: int) -> Column:
    c = F.col
    bottom = c("top") + c("height")
    return (
        F.when((c("width") <= 0) | (c("height") <= 0), "hidden")
        .when(bottom <= 0, "above")
        .when(c("top") < height, "above-fold")
        .when(c("top") >= height * BELOW_FOLD, "below-fold")
        .otherwise("near-fold")
    )


def render_hints(boxes: DataFrame, viewport_width: int = 1280, viewport_height: int = 720) -> DataFrame:
    """Zone, lazy-above, eager-below, missing dimensions, layout-shift risk and visible area per box.

    ``boxes``: ``page_id, idx, tag, top, left, width, height, text, loading, reserved``.
    """
    c = F.col
    visible_w = F.greatest(F.lit(0.0), F.least(c("left") + c("width"), F.lit(viewport_width)) - F.greatest(c("left"), F.lit(0.0)))
    visible_h = F.greatest(F.lit(0.0), F.least(c("top") + c("height"), F.lit(viewport_height)) - F.greatest(c("top"), F.lit(0.0)))
    image = c("tag") == "img"
    out = boxes.withColumn("zone", _zone(viewport_height))
    rendered = (c("width") > 0) & (c("height") > 0)
    return out.withColumns(
        {
            "missing_dimensions": image & ~c("reserved"),
            "above_fold_lazy": image & (c("zone") == "above-fold") & (c("loading") == "lazy"),
            "below_fold_eager": image
            & (c("zone") == "below-fold")
            & (c("loading") != "lazy")
            & (c("width") * c("height") >= MIN_EAGER_AREA),
            "cls_risk": c("tag").isin("img", "video", "iframe") & rendered & ~c("reserved"),
            "visible_area": F.when(c("zone") == "above-fold", visible_w * visible_h).otherwise(F.lit(0.0)),
        }
    )


def lcp_candidates(hints: DataFrame) -> DataFrame:
    """The largest visible element of each page: media, or text of at least 20 characters."""
    tags = ["img", "video", "h1", "h2", "p"]
    order = F.coalesce(*[F.when(F.col("tag") == t, F.lit(i)) for i, t in enumerate(tags)])
    media = F.col("tag").isin("img", "video")
    rows = hints.where(F.col("tag").isin(tags) & (F.col("visible_area") > 0) & (media | (F.length("text") >= 20)))
    best = rows.groupBy("page_id").agg(
        F.min_by(F.struct("idx", "tag", "visible_area"), F.struct(-F.col("visible_area"), order, "idx")).alias("b")
    )
    return best.select("page_id", "b.*")


def render_blocking(scripts: DataFrame, stylesheets: DataFrame) -> DataFrame:
    """Head scripts without async, defer or module, and stylesheets for the screen."""
    js = scripts.where("in_head AND external AND NOT `async` AND NOT `defer` AND NOT module")
    css = stylesheets.where("url <> '' AND NOT disabled AND lower(trim(media)) <> 'print'")
    return js.select("page_id", F.lit("script").alias("type"), "url").unionByName(css.select("page_id", F.lit("stylesheet").alias("type"), "url"))


def font_hints(resources: DataFrame, hints: DataFrame) -> DataFrame:
    """Observed fonts with whether the page preloads them."""
    preloads = hints.where("rel LIKE '%preload%' AND `as` = 'font'").select("page_id", "url").distinct()
    fonts = resources.where("kind = 'font'")
    return fonts.join(preloads.withColumn("hit", F.lit(True)), ["page_id", "url"], "left").withColumn(
        "preloaded", F.coalesce("hit", F.lit(False))
    ).drop("hit")


def hint_issues(boxes: DataFrame, blocking: DataFrame, hints: DataFrame) -> DataFrame:
    """``page_id, code, elements`` over render hints, blocking resources and font preloads."""
    flags = {
        "image-dimensions": "missing_dimensions", "cls-risk": "cls_risk", "above-fold-lazy": "above_fold_lazy", "below-fold-eager": "below_fold_eager",
    }
    found = boxes.select("page_id", F.explode(keep_true(*[(F.col(c), F.lit(code)) for code, c in flags.items()])).alias("code"))
    found = found.unionByName(blocking.select("page_id", F.lit("render-blocking").alias("code")))
    bare = hints.where("rel LIKE '%preload%' AND `as` = 'font' AND NOT crossorigin")
    found = found.unionByName(bare.select("page_id", F.lit("font-preload-crossorigin").alias("code")))
    return found.groupBy("page_id", "code").agg(F.count("*").alias("elements"))
