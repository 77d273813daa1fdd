"""Rule-based issues per page, score, and the configurable policy on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import per_session, settled, str_array
from .indexability import comparable_urls
from .rules import DEFAULT_RULES, rules_literal
from .schema import product_summary, schema_types

ISSUE = "array<struct<id:string,severity:string,category:string,title:string,message:string,refs:array<int>>>"
FACTS_NEEDED = (
    "title", "description", "viewport", "canonical", "robots", "headings", "lang", "hreflang", "images", "links", "jsonld",
)


def issue(id_: str, severity: str, category: str, title, message, refs: Column | None = None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(id_).alias("id"),
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        lit(title).alias("title"),
        lit(message).alias("message"),
        (refs if refs is not None else F.array().cast("array<int>")).alias("refs"),
    )


def has_directive(values: Column, name: str) -> Column:
    """True if any robots value holds the directive, split at commas and white space."""
    return F.exists(values, lambda v: F.array_contains(F.split(F.lower(v), r"[,\s]+"), name))


def heading_jumps(headings: Column) -> Column:
    """Ordinals of headings that skip a level."""
    return F.transform(
        F.filter(
            headings, lambda h, i: (i > 0) & (h["level"] > F.get(headings, i - 1)["level"] + 1)
        ),
        lambda h: h["idx"],
    )


def _count(n: Column, noun: str, tail: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(tail))


@per_session
def _checks(has_status: bool, has_x_robots: bool, has_render: bool) -> list[Column]:
    c = F.col
    rules = c("rules")
    status = c("status") if has_status else F.lit(None).cast("int")
    x_robots = F.coalesce(c("x_robots"), str_array([])) if has_x_robots else str_array([])
    render = c("render") if has_render else None
    chars = lambda v, which, key: F.concat(
        F.length(v).cast("string"), F.lit(f" characters; configured {which} is "), rules["thresholds"][key].cast("string"), F.lit(".")
    )
    title, description = F.trim(c("title")), F.trim(c("description"))
    canonical, t = c("canonical"), rules["thresholds"]
    robots = F.transform("robots", lambda r: r["content"])
    h1 = F.filter("headings", lambda h: h["level"] == 1)
    jumps = heading_jumps(c("headings"))
    langs = F.transform("hreflang", lambda h: F.lower(h["lang"]))
    repeated = F.filter(
        F.transform("hreflang", lambda h, i: F.when((h["lang"] != "") & (F.array_position(langs, F.lower(h["lang"])) <= i), h["idx"])),
        lambda x: x.isNotNull(),
    )
    idx = lambda arr: F.transform(arr, lambda x: x["idx"])
    no_alt = idx(F.filter("images", lambda i: ~i["alt_present"]))
    no_size = idx(F.filter("images", lambda i: (i["width_attr"] == "") | (i["height_attr"] == "")))
    http = lambda l: F.lower(F.trim(l["raw_href"])).rlike(r"^(?:https?://|/|\./|\.\./|\?)")
    no_label = idx(F.filter("links", lambda l: (l["label"] == "") & http(l)))
    script_links = idx(F.filter("links", lambda l: F.lower(F.trim(l["raw_href"])).startswith("javascript:")))
    bad_blocks = F.filter(
        F.transform("schemas", lambda s, i: F.when(~s["valid"], i.cast("int"))), lambda x: x.isNotNull()
    )
    product = product_summary(c("schemas"))
    out = [
        F.when(title == "", issue("title.missing", "critical", "Metadata", "Missing title", "The page has no non-empty <title> element.")),
        F.when(
            (title != "") & (F.length(title) < t["title_min"]),
            issue("title.short", "warning", "Metadata", "Title is short", chars(title, "minimum", "title_min")),
        ),
        F.when(
            (title != "") & (F.length(title) > t["title_max"]),
            issue("title.long", "warning", "Metadata", "Title is long", chars(title, "maximum", "title_max")),
        ),
        F.when(
            description == "",
            issue("description.missing", "warning", "Metadata", "Missing meta description", "No non-empty meta description was found."),
        ),
        F.when(
            (description != "") & (F.length(description) < t["description_min"]),
            issue(
                "description.short", "warning", "Metadata", "Meta description is short", chars(description, "minimum", "description_min")
            ),
        ),
        F.when(
            (description != "") & (F.length(description) > t["description_max"]),
            issue("description.long", "warning", "Metadata", "Meta description is long", chars(description, "maximum", "description_max")),
        ),
        F.when(
            c("viewport") == "",
            issue("viewport.missing", "warning", "Metadata", "Missing viewport meta tag", "No viewport meta tag was found."),
        ),
        F.when(
            canonical["count"] == 0,
            issue("canonical.missing", "warning", "Canonical", "Missing canonical", "No canonical link element was found."),
        ),
        F.when(
            canonical["count"] > 1,
            issue(
                "canonical.multiple", "critical", "Canonical", "Multiple canonicals",
                F.concat(canonical["count"].cast("string"), F.lit(" canonical link elements were found.")),
            ),
        ),
        F.when(
            (canonical["href"] != "") & (c("norm_canonical") != c("norm_url")),
            issue("canonical.different", "warning", "Canonical", "Canonical points elsewhere", canonical["href"]),
        ),
        F.when(
            has_directive(robots, "noindex"),
            issue(
                "robots.meta.noindex", "critical", "Indexability", "Meta robots contains noindex",
                "The page asks compliant crawlers not to index it.",
            ),
        ),
        F.when(
            has_directive(x_robots, "noindex"),
            issue(
                "robots.header.noindex", "critical", "Indexability", "X-Robots-Tag contains noindex",
                "The HTTP response asks compliant crawlers not to index this page.",
            ),
        ),
        F.when(
            has_directive(robots, "nofollow") | has_directive(x_robots, "nofollow"),
            issue(
                "robots.nofollow", "warning", "Indexability", "Page-level nofollow found",
                "A robots directive asks compliant crawlers not to follow links from this page.",
            ),
        ),
        F.when(F.size(h1) == 0, issue("headings.h1.missing", "warning", "Headings", "Missing H1", "No H1 heading was found.")),
        F.when(
            F.size(h1) > 1,
            issue(
                "headings.h1.multiple", "warning", "Headings", "Multiple H1 headings",
                F.concat(F.size(h1).cast("string"), F.lit(" H1 headings were found.")), idx(h1),
            ),
        ),
        F.when(
            F.size(jumps) > 0,
            issue(
                "headings.jump", "warning", "Headings", "Heading levels are skipped",
                _count(F.size(jumps), "heading transition", " skip one or more levels."), jumps,
            ),
        ),
        F.when(
            F.trim("lang") == "",
            issue("html.lang.missing", "warning", "International", "Missing html lang attribute", "The root HTML element has no language value."),
        ),
        F.when(
            F.size(repeated) > 0,
            issue(
                "hreflang.duplicate", "warning", "International", "Duplicate hreflang values",
                _count(F.size(repeated), "duplicate hreflang declaration", " found."), repeated,
            ),
        ),
        F.when(
            F.size(no_alt) > 0,
            issue(
                "images.alt.missing", "warning", "Images", "Images missing alt attributes",
                _count(F.size(no_alt), "image", " have no alt attribute."), no_alt,
            ),
        ),
    ]
    if render is not None:
        wide = idx(
            F.filter(
                render,
                lambda r: (r["natural_width"] > 0)
                & (r["rendered_width"] > 0)
                & (r["natural_width"] > r["rendered_width"] * t["oversized_image_ratio"]),
            )
        )
        out.append(
            F.when(
                F.size(wide) > 0,
                issue(
                    "images.oversized", "warning", "Images", "Oversized images",
                    _count(F.size(wide), "image", " are rendered at less than half their intrinsic width."), wide,
                ),
            )
        )
    out += [
        F.when(
            F.size(no_size) > 0,
            issue(
                "images.dimensions.missing", "warning", "Images", "Images missing explicit dimensions",
                _count(F.size(no_size), "image", " lack a width or height attribute."), no_size,
            ),
        ),
        F.when(
            F.size(no_label) > 0,
            issue(
                "links.label.missing", "warning", "Links", "Links without descriptive text",
                _count(F.size(no_label), "HTTP link", " have no text, aria-label, title, or image alt label."), no_label,
            ),
        ),
        F.when(
            F.size(script_links) > 0,
            issue(
                "links.javascript", "warning", "Links", "javascript: links found",
                _count(F.size(script_links), "javascript: link", " found."), script_links,
            ),
        ),
        F.when(
            F.size(bad_blocks) > 0,
            issue(
                "schema.invalid", "critical", "Structured data", "Invalid JSON-LD",
                _count(F.size(bad_blocks), "JSON-LD block", " could not be parsed."), bad_blocks,
            ),
        ),
        F.when(
            product["name"] == "",
            issue(
                "schema.product.name", "warning", "Structured data", "Product schema missing name",
                "A Product JSON-LD object was found without a name.",
            ),
        ),
        F.when(
            ~product["has_offers"],
            issue(
                "schema.product.offers", "warning", "Structured data", "Product schema missing offers",
                "A Product JSON-LD object was found without offers.",
            ),
        ),
        F.when(
            status >= 400,
            issue(
                "http.error", "critical", "HTTP", F.concat(F.lit("HTTP "), status.cast("string")),
                "The main document returned an error status.",
            ),
        ),
    ]
    return out


def evaluate(facts: DataFrame, *, custom: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Add ``issues`` (an array in check order), ``norm_url`` and ``norm_canonical``.

    Needs the columns in ``FACTS_NEEDED`` plus ``schemas``; uses ``status``, ``x_robots``,
    ``rules`` and ``render`` when present. ``custom`` adds user checks as
    ``(id, severity, SQL predicate)``.
    """
    have = set(facts.columns)
    out = facts
    if "rules" not in have:
        out = out.withColumn("rules", rules_literal(DEFAULT_RULES))
    out = settled(out, comparable_urls())
    checks = list(_checks("status" in have, "x_robots" in have, "render" in have))
    for id_, severity, predicate in custom or []:
        checks.append(F.when(F.expr(predicate), issue(id_, severity, "Custom", id_, predicate)))
    return settled(out, {"issues": F.filter(F.array(*checks), lambda x: x.isNotNull())})


def score(issues: Column) -> Column:
    """100 minus 20 per critical and 5 per warning, within 0..100."""
    cost = F.aggregate(
        issues,
        F.lit(0),
        lambda acc, x: acc + F.when(x["severity"] == "critical", 20).when(x["severity"] == "warning", 5).otherwise(0),
    )
    return F.greatest(F.lit(0), F.lit(100) - cost)


def score_band(value: Column) -> Column:
    return F.when(value >= 90, "good").when(value >= 70, "warn").otherwise("bad")


def severity_count(issues: Column, severity: str) -> Column:
    return F.size(F.filter(issues, lambda x: x["severity"] == severity))


def with_score(df: DataFrame) -> DataFrame:
    """Add score, band and severity counts from ``issues``."""
    i = F.col("issues")
    return df.withColumns(
        {"score": score(i), **{s: severity_count(i, s) for s in ("critical", "warning", "info")}}
    ).withColumn("band", score_band(F.col("score")))


def apply_policy(issues: Column, rules: Column) -> Column:
    """Drop disabled checks and override severities."""
    kept = F.filter(issues, lambda x: ~F.array_contains(rules["disabled_checks"], x["id"]))
    return F.transform(
        kept,
        lambda x: F.struct(
            x["id"].alias("id"),
            F.coalesce(F.try_element_at(rules["severity_overrides"], x["id"]), x["severity"]).alias("severity"),
            x["category"].alias("category"),
            x["title"].alias("title"),
            x["message"].alias("message"),
            x["refs"].alias("refs"),
        ),
    )


def apply_rules(df: DataFrame) -> DataFrame:
    """Required signals, then the issue policy, then a new score."""
    r = F.col("rules")
    need = r["required"]
    optional = {
        "title.missing": "title", "description.missing": "description", "canonical.missing": "canonical", "headings.h1.missing": "h1",
    }
    kept = F.filter(
        "issues",
        lambda x: ~F.coalesce(*[F.when(x["id"] == k, ~need[v]) for k, v in optional.items()], F.lit(False)),
    )
    typed = F.exists("schemas", lambda s: s["valid"] & (F.size(s["types"]) > 0))
    extra = F.filter(
        F.array(
            F.when(
                need["schema"] & ~typed,
                issue(
                    "schema.required", "warning", "Structured data", "Structured data is required",
                    "No valid typed structured-data block was found.",
                ),
            ),
            F.when(
                need["hreflang"] & (F.size("hreflang") == 0),
                issue("hreflang.required", "warning", "International", "Hreflang is required", "No hreflang declaration was found."),
            ),
            F.when(
                need["https"] & ~F.col("norm_url").startswith("https:"),
                issue("https.required", "critical", "HTTP", "HTTPS is required", "The audited page URL does not use HTTPS."),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return with_score(settled(df, {"issues": apply_policy(F.concat(kept, extra), r)}))


def apply_profile(df: DataFrame) -> DataFrame:
    """Expectations of the page's domain profile (column ``profile``), policy and score again."""
    p = F.col("profile")
    active = F.coalesce(p["enabled"], F.lit(False))
    have_types = F.transform(
        F.flatten(F.transform(F.filter("schemas", lambda s: s["valid"]), lambda s: s["types"])), lambda t: F.lower(t)
    )
    have_langs = F.transform("hreflang", lambda h: F.lower(F.trim(h["lang"])))
    missing = lambda expected, have: F.filter(
        F.coalesce(expected, str_array([])), lambda e: ~F.array_contains(have, F.lower(e))
    )
    no_type, no_lang = missing(p["schema_types"], have_types), missing(p["hreflang"], have_langs)
    says = lambda arr: F.concat(F.lit("Missing: "), F.array_join(arr, ", "), F.lit("."))
    extra = F.filter(
        F.array(
            F.when(
                active & (F.size(no_type) > 0),
                issue("profile.schema.expected", "warning", "Domain profile", "Expected schema type is missing", says(no_type)),
            ),
            F.when(
                active & (F.size(no_lang) > 0),
                issue("profile.hreflang.expected", "warning", "Domain profile", "Expected hreflang value is missing", says(no_lang)),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return with_score(settled(df, {"issues": apply_policy(F.concat("issues", extra), F.col("rules"))}))


def issue_rows(df: DataFrame) -> DataFrame:
    """Long table: one row per issue with its place in the page's list."""
    return df.select("page_id", F.posexplode("issues").alias("pos", "i")).select("page_id", "pos", "i.*")


def top_issues(df: DataFrame, k: int = 5, severity: str | None = None) -> DataFrame:
    """First ``k`` issues of each page in check order, optionally of one severity (a top-k report)."""
    chosen = F.col("issues") if severity is None else F.filter("issues", lambda x: x["severity"] == severity)
    return issue_rows(df.withColumn("issues", F.slice(chosen, 1, k)))
