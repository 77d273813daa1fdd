"""Regression analysis between two snapshots of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let, per_session, settled

# Performance metrics: key, smallest absolute change (fixed values); the smallest ratio is 20 %.
METRICS = [
    ("request_count", 10), ("total_bytes", 102400), ("third_party_requests", 5), ("third_party_bytes", 102400), ("dom_nodes", 100),
    ("dom_depth", 5), ("ttfb", 100), ("load", 500),
]
MIN_RATIO = 0.2


def performance_direction(before: Column, after: Column, absolute: float, ratio: float = MIN_RATIO) -> Column:
    """regression, improvement or NULL when the change is noise."""
    delta = after - before
    noisy = ~(before > 0) | ~(after >= 0) | (F.abs(delta) < absolute) | (F.abs(delta) / before < ratio) | (delta == 0)
    return F.when(F.coalesce(noisy, F.lit(True)), F.lit(None)).when(delta > 0, "regression").otherwise("improvement")


def count_direction(before: Column, after: Column, increase_is_bad: bool = True) -> Column:
    worse = after > before if increase_is_bad else after < before
    return F.when(F.coalesce(before == after, F.lit(True)), "changed").when(worse, "regression").otherwise("improvement")


def header_strength(state: Column) -> Column:
    s = F.lower(state)
    return F.when(s.isin("present", "covered"), 2).when(s == "review", 1).when(s == "missing", 0)


def status_healthy(status: Column) -> Column:
    return F.coalesce(status.between(200, 399), F.lit(False))


def _noindex(values: Column) -> Column:
    return F.exists(values, lambda v: F.array_contains(F.split(F.lower(v), r"[,\s]+"), "noindex"))


@per_session
def _changes(fields: tuple[str, ...]) -> dict[str, Column]:
    """All changes of a pair in three arrays, NULL where nothing changed; ``fields`` are those both snapshots have.

    They are not yet one array without NULLs: whatever a higher-order function takes as its
    argument is interpreted, row by row, and not compiled.
    """
    b, a = F.col("b"), F.col("a")
    text = lambda v: v.cast("string")
    joined = lambda v: F.array_join(v, ",")

    def entry(cond, id_, category, before, after, direction, severity) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.when(
            cond,
            F.struct(
                lit(id_).alias("id"), F.lit(category).alias("category"), before.alias("before"), after.alias("after"),
                lit(direction).alias("direction"), lit(severity).alias("severity"),
            ),
        )

    differs = lambda f: ~b[f].eqNullSafe(a[f])
    lost = lambda f: (F.trim(a[f]) == "") & (F.trim(b[f]) != "")
    won = lambda f: (F.trim(a[f]) != "") & (F.trim(b[f]) == "")
    bad = lambda cond, severity, otherwise="info": F.when(cond, F.lit(severity)).otherwise(F.lit(otherwise))

    def filled(f: str, id_: str, category: str) -> Column:
        direction = F.when(lost(f), "regression").when(won(f), "improvement").otherwise("changed")
        return entry(differs(f), id_, category, b[f], a[f], direction, bad(lost(f), "warning"))

    def plain(f: str, id_: str, category: str, severity: str = "info", array: bool = False) -> Column:
        show = joined if array else text
        return entry(differs(f), id_, category, show(b[f]), show(a[f]), "changed", severity)

    def counted(f: str, id_: str, category: str, severity: str, extra: Column | None = None) -> Column:
        cond = differs(f) if extra is None else differs(f) & extra
        return entry(cond, id_, category, text(b[f]), text(a[f]), count_direction(b[f], a[f]), bad(a[f] > b[f], severity))

    def either(f: str, row: Column, count: str, id_: str, category: str) -> Column:
        """``row`` where both snapshots have the details in ``f``, else the bare counts of older ones."""
        both = b[f].isNotNull() & a[f].isNotNull()
        return F.when(both, row).otherwise(plain(count, id_, category)) if count in fields else F.when(both, row)

    known = lambda f: b[f].isNotNull() & a[f].isNotNull()
    gained, dropped = ~_noindex(b["robots"]) & _noindex(a["robots"]), _noindex(b["robots"]) & ~_noindex(a["robots"])
    blocked, opened = b["indexable"] & ~a["indexable"], ~b["indexable"] & a["indexable"]
    no_h1 = (F.size(b["h1"]) > 0) & (F.size(a["h1"]) == 0)
    links_checked = (b["links_checked"] > 0) & (a["links_checked"] > 0)
    images_checked = (b["images_checked"] > 0) & (a["images_checked"] > 0)
    well, ill = status_healthy(b["status"]), ~status_healthy(a["status"])
    x_gained = ~_noindex(b["x_robots"]) & _noindex(a["x_robots"])
    rows = [
        filled("title", "metadata.title", "Metadata"),
        filled("description", "metadata.description", "Metadata"),
        entry(
            differs("canonical"), "canonical.url", "Canonical", b["canonical"], a["canonical"],
            F.when(lost("canonical"), "regression").otherwise("changed"), bad(lost("canonical"), "warning"),
        ),
        entry(
            differs("robots"), "indexability.robots", "Indexability", joined(b["robots"]), joined(a["robots"]),
            F.when(gained, "regression").when(dropped, "improvement").otherwise("changed"), bad(gained, "critical"),
        ),
        entry(
            differs("verdict"), "indexability.verdict", "Indexability", b["verdict"], a["verdict"],
            F.when(blocked, "regression").when(opened, "improvement").otherwise("changed"), bad(blocked, "critical", "warning"),
        ),
        plain("reasons", "indexability.reasons", "Indexability", array=True),
        entry(
            differs("h1"), "headings.h1", "Headings", joined(b["h1"]), joined(a["h1"]),
            F.when(no_h1, "regression").otherwise("changed"), bad(no_h1, "warning"),
        ),
        either("outline", plain("outline", "headings.structure", "Headings", array=True), "heading_count", "headings.count", "Headings"),
        plain("links_total", "links.count", "Links"),
        counted("links_broken", "links.broken", "Links", "critical", links_checked),
        counted("links_redirect", "links.redirect", "Links", "warning", links_checked),
        either("images_missing_alt", counted("images_missing_alt", "images.missingAlt", "Images", "warning"), "images_total", "images.count", "Images"),
        counted("images_missing_dimensions", "images.missingDimensions", "Images", "warning", known("images_missing_dimensions")),
        counted("images_oversized", "images.oversized", "Images", "warning", known("images_oversized")),
        counted("images_broken", "images.broken", "Images", "critical", images_checked),
        plain("schema_types", "schema.types", "Structured data", array=True),
        counted("schema_invalid", "schema.invalid", "Structured data", "critical"),
        either("hreflang", plain("hreflang", "hreflang.entries", "International", "warning", array=True), "hreflang_count", "hreflang.count", "International"),
        entry(
            differs("status"), "http.status", "HTTP", text(b["status"]), text(a["status"]),
            F.when(well & ill, "regression").when(~well & ~ill, "improvement").otherwise("changed"), bad(well & ill, "critical"),
        ),
        entry(
            differs("x_robots"), "http.x-robots-tag", "HTTP", joined(b["x_robots"]), joined(a["x_robots"]),
            F.when(x_gained, "regression").otherwise("changed"), bad(x_gained, "critical"),
        ),
        plain("content_type", "http.content-type", "HTTP", array=True),
        plain("content_language", "http.content-language", "HTTP", array=True),
        plain("cache_control", "http.cache-control", "HTTP", array=True),
    ]
    sized = (b["known_sizes"] > 0) & (a["known_sizes"] > 0)
    for key, absolute in METRICS:
        direction = performance_direction(b[key].cast("double"), a[key].cast("double"), absolute)
        cond = direction.isNotNull() & (sized if key.endswith("_bytes") else F.lit(True))
        rows.append(
            entry(cond, f"performance.{key}", "Performance", text(b[key]), text(a[key]), direction, bad(direction == "regression", "warning"))
        )
    rows += [
        entry(
            differs("https"), "security.https", "Security", text(b["https"]), text(a["https"]),
            F.when(b["https"], "regression").otherwise("improvement"), bad(b["https"], "critical"),
        ),
        counted("mixed_active", "security.mixed-active", "Security", "critical"),
        counted("mixed_passive", "security.mixed-passive", "Security", "warning"),
    ]
    scored = (
        F.when(a["score"] < b["score"], "regression").when(a["score"] > b["score"], "improvement").otherwise("changed")
    )
    last = entry(
        differs("score"), "audit.score", "Audit", text(b["score"]), text(a["score"]), scored, bad(a["score"] < b["score"], "warning")
    )
    # Security headers: keys present on both sides whose state or value changed.
    keys = F.array_sort(F.array_intersect(F.map_keys(b["headers"]), F.map_keys(a["headers"])))

    def header(k: Column) -> Column:
        def judged(p: Column) -> Column:
            old, new = p["old"], p["new"]
            strengths = F.struct(header_strength(old["state"]).alias("s0"), header_strength(new["state"]).alias("s1"))
            direction = let(
                strengths,
                lambda s: F.when(F.coalesce(s["s0"] == s["s1"], F.lit(True)), "changed").when(s["s1"] < s["s0"], "regression").otherwise("improvement"),
            )
            row = lambda d: entry(
                F.lit(True), F.concat(F.lit("security.header."), k), "Security", old["state"], new["state"], d, bad(d == "regression", "warning")
            )
            return F.when(~old.eqNullSafe(new), let(direction, row))

        return let(F.struct(b["headers"][k].alias("old"), a["headers"][k].alias("new")), judged)

    return {"fixed_": F.array(*rows), "headers_": F.transform(keys, header), "last_": F.array(last)}


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per change of a page: id, category, values, direction and severity.

    Both sides have one row per ``url`` with a ``snapshot`` struct; the join is the only shuffle.
    Snapshots without outline, image details or hreflang entries (NULL) are compared by
    ``heading_count``, ``images_total`` and ``hreflang_count``.
    """
    pair = before.select("url", F.col("snapshot").alias("b")).join(after.select("url", F.col("snapshot").alias("a")), "url")
    names = lambda df: df.schema["snapshot"].dataType.names
    both = tuple(f for f in names(before) if f in names(after))
    found = settled(pair, _changes(both)).select("url", F.array_compact(F.concat("fixed_", "headers_", "last_")).alias("changes"))
    return found.select("url", F.explode("changes").alias("c")).select("url", "c.*")


def regression_summary(changes: DataFrame) -> DataFrame:
    """Changes per URL and direction."""
    is_ = lambda d: F.count_if(F.col("direction") == d)
    return changes.groupBy("url").agg(
        is_("regression").alias("regressions"), is_("improvement").alias("improvements"), is_("changed").alias("changed")
    )
