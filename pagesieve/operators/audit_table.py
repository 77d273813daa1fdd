"""The flat audit table: rows, duplicates, pagination families, filters, sorts, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import clean, per_session, settled
from .extract import link_kind
from .pagetype import page_traits

DUPLICATE_FIELDS = ["title", "description", "h1"]
CRAWL_SORT_KEYS = ["depth", "url", "page_type", "status", "title", "h1", "indexability", "score", "issue_count"]
SET_SORT_KEYS = [
    "url", "title", "page_type", "status", "indexability", "score", "issue_count", "critical", "warnings", "h1",
]
VERDICTS = ["Indexable", "Noindex", "Blocked", "Canonicalized", "Redirected", "Error", "Unknown"]


@per_session
def _row_columns() -> list[Column]:
    c = F.col
    h1 = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"]
    robots = F.filter(F.transform("robots", lambda r: clean(r["content"])), lambda v: v != "")
    status = F.coalesce(c("status"), F.lit(0))
    return [
        U.http_url(c("requested_url")).alias("requested_url"),
        U.http_url(c("url")).alias("url"),
        F.coalesce(c("redirected"), F.lit(False)).alias("redirected_"),
        status.alias("status"),
        F.lit(True).alias("available"),
        F.lit("").alias("error"),
        clean(c("title")).alias("title"),
        clean(c("description")).alias("description"),
        F.coalesce(clean(h1), F.lit("")).alias("h1"),
        F.size(F.filter("headings", lambda h: h["level"] == 1)).alias("h1_count"),
        clean(c("canonical.href")).alias("canonical"),
        F.array_join(robots, " | ").alias("robots"),
        c("verdict").alias("indexability"),
        c("score"),
        c("page_type.label").alias("page_type"),
        c("page_type.primary").alias("page_type_primary"),
        c("page_type.confidence").alias("page_type_confidence"),
        page_traits(c("page_type")).alias("page_traits"),
        c("critical"),
        c("warning").alias("warnings"),
        F.size("issues").alias("issue_count"),
        F.size(F.filter("links", lambda l: link_kind(l["raw_href"]) == "http")).alias("link_count"),
    ]


def audit_rows(reports: DataFrame) -> DataFrame:
    """One flat row per page report; ``depth`` and ``source_url`` are kept when present."""
    have = set(reports.columns)
    df = reports
    if "requested_url" not in have:
        df = df.withColumn("requested_url", F.col("url"))
    for name, default in (("redirected", F.lit(False)), ("status", F.lit(0)), ("depth", F.lit(0)), ("source_url", F.lit(""))):
        if name not in have:
            df = df.withColumn(name, default)
    out = settled(
        df.select("page_id", "depth", "source_url", *_with_prefix()), {"comparable_": F.struct("r_url", "r_requested_url")}
    ).drop("comparable_")
    out = out.toDF(*[c.removeprefix("r_") for c in out.columns])
    moved = (F.col("requested_url") != "") & (F.col("url") != "") & (F.col("requested_url") != F.col("url"))
    return out.withColumn("redirected", F.col("redirected_") | moved).drop("redirected_")


@per_session
def _with_prefix() -> list[Column]:
    names = [
        "requested_url", "url", "redirected_", "status", "available", "error", "title", "description", "h1", "h1_count",
        "canonical", "robots", "indexability", "score", "page_type", "page_type_primary", "page_type_confidence",
        "page_traits", "critical", "warnings", "issue_count", "link_count",
    ]
    return [c.alias(f"r_{n}") for n, c in zip(names, _row_columns())]


def error_rows(failed: DataFrame, like: DataFrame) -> DataFrame:
    """Rows for pages that could not be read; no fact is invented.

    ``failed``: ``page_id, url, final_url, status, redirected, error``.
    """
    known = {
        "page_id": F.col("page_id"),
        "requested_url": U.http_url(F.col("url")),
        "url": F.coalesce(F.nullif(U.http_url(F.col("final_url")), F.lit("")), U.http_url(F.col("url"))),
        "status": F.coalesce("status", F.lit(0)),
        "redirected": F.coalesce("redirected", F.lit(False)),
        "available": F.lit(False),
        "error": clean(F.coalesce(F.nullif("error", F.lit("")), F.lit("network"))),
        "indexability": F.lit("Unknown"),
        "score": F.lit(None),
    }
    empty = {"string": F.lit(""), "int": F.lit(0), "bigint": F.lit(0), "boolean": F.lit(False)}
    return failed.select(
        *[known.get(f.name, empty.get(f.dataType.simpleString())).cast(f.dataType).alias(f.name) for f in like.schema]
    )


def text_fields(facts: DataFrame) -> DataFrame:
    """What duplicates are judged by, as in :func:`audit_rows`, from ``title``, ``description`` and ``headings`` alone."""
    h1 = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"]
    texts = {"title": clean(F.col("title")), "description": clean(F.col("description")), "h1": F.coalesce(clean(h1), F.lit(""))}
    return facts.select("page_id", U.http_url(F.col("url")).alias("url"), F.lit(True).alias("available"), *[v.alias(k) for k, v in texts.items()])


def duplicate_key(value: Column) -> Column:
    return F.lower(clean(value))


def _long(rows: DataFrame, fields: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    keep = [c for c in ("page_id", "url") if c in rows.columns]
    out = rows.where("available").select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")
    return settled(out, {"key": duplicate_key(F.col("value"))}).where("key <> ''")


def duplicate_groups(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``field, key, value, first_page, pages`` of every value shared by more than one page.

    Only counts and one sample travel to a key, so a value on a third of all pages is
    combined map-side like any other; the members stay rows (:func:`duplicate_members`).
    """
    long = _long(rows, fields or DUPLICATE_FIELDS)
    groups = long.groupBy("field", "key").agg(
        F.count("*").alias("pages"), F.min_by(clean(F.col("value")), "page_id").alias("value"), F.min("page_id").alias("first_page")
    )
    return groups.where("pages > 1")


def duplicate_members(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per page in a duplicate group."""
    long = _long(rows, fields or DUPLICATE_FIELDS)
    return long.join(duplicate_groups(rows, fields).select("field", "key", "pages"), ["field", "key"])


def annotate_duplicates(rows: DataFrame, by: str = "url") -> DataFrame:
    """Add duplicate_title, duplicate_description, duplicate_h1.

    Flags are by URL (a crawl) or by ``page_id`` (a page set). One aggregation finds
    the repeated values of all fields; members fold to one flag row per page.
    """
    members = duplicate_members(rows)
    flags = members.groupBy(by).agg(*[F.bool_or(F.col("field") == f).alias(f"duplicate_{f}") for f in DUPLICATE_FIELDS])
    out = rows.join(flags, by, "left")
    return out.withColumns({f"duplicate_{f}": F.coalesce(f"duplicate_{f}", F.lit(False)) for f in DUPLICATE_FIELDS})


def filter_audit(
    rows: DataFrame,
    query: str = "",
    errors_only: bool = False,
    redirects_only: bool = False,
    duplicates_only: bool = False,
    issues_only: bool = False,
    available_only: bool = False,
    indexability: str | None = None,
) -> DataFrame:
    """Rows that pass all the given filters; ``query`` searches eight text fields."""
    out = rows
    if errors_only:
        out = out.where("NOT available OR status >= 400")
    if redirects_only:
        out = out.where("redirected")
    if duplicates_only:
        out = out.where("duplicate_title OR duplicate_description OR duplicate_h1")
    if issues_only:
        out = out.where("issue_count > 0")
    if available_only:
        out = out.where("available")
    if indexability and indexability != "All":
        out = out.where(F.col("indexability") == indexability)
    needle = " ".join(query.split()).lower()
    if needle:
        fields = ["url", "title", "description", "h1", "canonical", "robots", "page_type", "page_traits"]
        out = out.where(F.contains(F.lower(F.concat_ws("\n", *fields)), F.lit(needle)))
    return out


def sort_audit(rows: DataFrame, key: str = "depth", direction: str = "asc", keys: list[str] | None = None) -> DataFrame:
    """Order by a permitted key, then URL; unknown keys fall back to the first permitted one."""
    keys = keys or CRAWL_SORT_KEYS
    key = key if key in keys else keys[0]
    value = F.coalesce(F.col(key), F.lit(0)) if key in ("depth", "status", "score", "issue_count", "critical", "warnings") else F.col(key)
    return rows.orderBy(value.desc() if direction == "desc" else value.asc(), F.col("url").asc())


def select_pages(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """http(s) pages, one per id, in id order; optionally the first ``cap`` (the page-set feature)."""
    rows = pages.where(F.col("url").rlike(r"(?i)^\s*https?://"))
    others = [c for c in rows.columns if c != "page_id"]
    one = rows.groupBy("page_id").agg(F.min(F.struct(*others)).alias("r")).select("page_id", "r.*")
    return one if cap is None else one.orderBy("page_id").limit(cap)


def _families(rows: DataFrame) -> DataFrame:
    live = rows.where("available")
    live = settled(
        live, {"family": U.pagination_family_key(F.col("url")), "norm_": U.http_url(F.col("url")), "paged_": U.page_signal(F.col("url"))["detected"]}
    )
    return live.where("family <> '' AND norm_ <> ''")


def pagination_families(rows: DataFrame) -> DataFrame:
    """``family, pages, urls`` of series: more than one URL and a page signal."""
    live = _families(rows)
    urls = live.groupBy("family", "norm_").agg(F.count("*").alias("n"), F.bool_or("paged_").alias("paged"))
    groups = urls.groupBy("family").agg(F.sum("n").alias("pages"), F.count("*").alias("urls"), F.bool_or("paged").alias("paged"))
    return groups.where("urls > 1 AND paged").drop("paged")


def pagination_duplicates(rows: DataFrame, fields: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """``family, field, key, urls``: values shared by several URLs of one series."""
    return _family_values(rows, fields).groupBy("family", "field", "key").agg(
        F.count("*").alias("urls"), F.min("value").alias("value")
    ).where("urls > 1")


def _family_values(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    live = _families(rows).join(pagination_families(rows).select("family"), "family", "left_semi")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    long = live.select("family", "url", F.explode(cells).alias("c")).select("family", "url", "c.*")
    long = settled(long, {"key": F.lower(clean(F.col("value")))}).where("key <> ''")
    return long.groupBy("family", "field", "key", "url").agg(F.min(clean(F.col("value"))).alias("value"))


def annotate_pagination(rows: DataFrame) -> DataFrame:
    """Add pagination_family and the two in-series duplicate flags, by URL."""
    fields = ("title", "description")
    groups = pagination_duplicates(rows, fields).select("family", "field", "key")
    members = _family_values(rows, fields).join(groups, ["family", "field", "key"])
    flags = members.groupBy("url").agg(*[F.bool_or(F.col("field") == f).alias(f"duplicate_pagination_{f}") for f in fields])
    out = rows.withColumn("pagination_family", U.pagination_family_key(F.col("url"))).join(flags, "url", "left")
    return out.withColumns({f"duplicate_pagination_{f}": F.coalesce(f"duplicate_pagination_{f}", F.lit(False)) for f in fields})


def pagination_link_status(pager: DataFrame, results: DataFrame) -> DataFrame:
    """State of every pager link: unchecked, unknown, broken, redirect or ok."""
    from .links import link_results_latest, status_kind

    r = link_results_latest(results).withColumn("seen", F.lit(True))
    rows = pager.withColumn("norm", U.http_url(F.col("href"))).where("norm <> ''").join(r, "norm", "left")
    state = F.when(F.col("seen").isNull(), "unchecked").otherwise(status_kind(F.col("status"), F.col("redirected"), F.col("error")))
    return rows.withColumn("state", state)


def pagination_link_counts(rows: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.groupBy("page_id").agg(
        F.count_if(F.col("state") != "unchecked").alias("checked"), is_("ok"), is_("broken"), is_("redirect"), is_("unknown")
    )


def audit_summary(rows: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Totals over all rows, or a rollup over the given dimensions."""
    measures = [
        F.count("*").alias("processed"),
        F.count_if("available").alias("available"),
        F.count_if(~F.col("available") | (F.col("status") >= 400)).alias("failures"),
        F.count_if("redirected").alias("redirects"),
        F.sum("critical").alias("critical"),
        F.sum("warnings").alias("warnings"),
    ]
    return rows.agg(*measures) if not dims else rows.rollup(*dims).agg(*measures)
