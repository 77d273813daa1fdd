"""Link graph: anchors, results, targets, broken links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import clean
from ..sources.fetch import latest

# Anchor texts that say nothing about the target (fixed values).
GENERIC_ANCHORS = [
    "click here", "here", "read more", "more", "learn more", "details", "view details", "view more", "this", "link",
    "website", "visit website", "continue",
]


def normalize_label(value: Column) -> Column:
    return F.lower(clean(value))


def is_generic_anchor(value: Column) -> Column:
    return normalize_label(value).isin(GENERIC_ANCHORS)


def status_kind(status: Column, redirected: Column, error: Column) -> Column:
    """ok, redirect, broken or unknown."""
    return (
        F.when((F.coalesce(error, F.lit("")) != "") | F.coalesce(status == 0, F.lit(True)), "unknown")
        .when(status >= 400, "broken")
        .when(F.coalesce(redirected, F.lit(False)) | status.between(300, 399), "redirect")
        .otherwise("ok")
    )


def _labelled(links: DataFrame) -> DataFrame:
    return links.where("kind = 'http' AND norm <> ''").withColumn("label_", normalize_label(F.col("label"))).where("label_ <> ''")


def _conflicts(links: DataFrame, key: str, other: str, scope: list[str]) -> DataFrame:
    """Keys that occur with more than one partner value.

    Two steps keep hot keys cheap: the first aggregation shrinks each
    (key, partner) pair to one row before rows meet by key alone.
    """
    pairs = _labelled(links).groupBy(*scope, key, other).agg(F.count("*").alias("n"))
    groups = pairs.groupBy(*scope, key).agg(F.count("*").alias("partners"), F.sum("n").alias("links"))
    return groups.where("partners > 1")


def anchor_conflicts(links: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Anchor texts that lead to more than one URL, within ``scope`` columns or corpus-wide."""
    return _conflicts(links, "label_", "norm", list(scope)).withColumnRenamed("label_", "label").withColumnRenamed("partners", "urls")


def multi_anchor_targets(links: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """URLs reached under more than one anchor text."""
    return _conflicts(links, "norm", "label_", list(scope)).withColumnRenamed("norm", "url").withColumnRenamed("partners", "labels")


def conflict_members(links: DataFrame, groups: DataFrame, key: str, other: str) -> DataFrame:
    """The (key, partner) pairs behind conflict groups, one row each; lists of any length stay rows."""
    pairs = _labelled(links).groupBy("label_", "norm").agg(F.count("*").alias("links"))
    named = pairs.withColumnsRenamed({"label_": "label", "norm": "url"})
    return named.join(groups.select(key), key, "left_semi").select(key, other, "links")


def anchor_summary(links: DataFrame) -> DataFrame:
    """HTTP links, generic and empty anchors per page."""
    http = F.col("kind") == "http"
    return links.groupBy("page_id").agg(
        F.count_if(http).alias("http_links"),
        F.count_if(http & is_generic_anchor(F.col("label"))).alias("generic"),
        F.count_if(http & (normalize_label(F.col("label")) == "")).alias("empty"),
    )


def link_results_latest(results: DataFrame) -> DataFrame:
    """Last result per comparable URL: ``norm, status, redirected, final_url, error``."""
    rows = results.withColumn("norm", U.http_url(F.col("url"), browser=True)).where("norm <> ''")
    return latest(rows.select("norm", "status", "redirected", "final_url", "error", "checked_at"), "norm", "checked_at").select(
        "norm", "status", "redirected", "final_url", "error"
    )


def with_results(links: DataFrame, results: DataFrame) -> DataFrame:
    """Links with their latest result and state; unchecked links keep NULLs."""
    r = link_results_latest(results).withColumn("checked", F.lit(True))
    out = links.join(r, "norm", "left")
    state = status_kind(F.col("status"), F.col("redirected"), F.col("error"))
    return out.withColumns(
        {"checked": F.coalesce("checked", F.lit(False)), "state": F.when(F.col("checked"), state).otherwise("unknown")}
    )


def filter_links(rows: DataFrame, name: str) -> DataFrame:
    """Named link filters; ``broken`` and ``redirecting`` need :func:`with_results`."""
    c = F.col
    return {
        "all": lambda: rows,
        "external": lambda: rows.where("kind = 'http' AND NOT internal"),
        "nofollow": lambda: rows.where("nofollow"),
        "sponsored": lambda: rows.where("sponsored"),
        "ugc": lambda: rows.where("ugc"),
        "generic": lambda: rows.where((c("kind") == "http") & is_generic_anchor(c("label"))),
        "broken": lambda: rows.where("state = 'broken'"),
        "redirecting": lambda: rows.where("state = 'redirect'"),
    }[name]()


def first_occurrences(links: DataFrame) -> DataFrame:
    """One row per page and target: the first link to it decides."""
    rows = links.where("kind = 'http' AND norm <> ''")
    others = [c for c in rows.columns if c not in ("page_id", "norm")]
    first = rows.groupBy("page_id", "norm").agg(F.min_by(F.struct(*others), "idx").alias("f"))
    return first.select("page_id", "norm", "f.*")


def link_summary(links: DataFrame, results: DataFrame) -> DataFrame:
    """Checked, ok, redirect, broken and unknown targets per page, and internal links to redirects."""
    rows = with_results(first_occurrences(links), results).where("checked")
    is_ = lambda s: F.col("state") == s
    return rows.groupBy("page_id").agg(
        F.count("*").alias("checked"),
        *[F.count_if(is_(s)).alias(s) for s in ("ok", "redirect", "broken", "unknown")],
        F.count_if(is_("redirect") & F.col("internal")).alias("internal_redirect"),
    )


def select_targets(links: DataFrame, cap: int | None = None, checked: DataFrame | None = None) -> DataFrame:
    """Distinct http targets in first-seen order, without those already checked.

    With a ``cap`` (the feature's own limit) the first ``cap`` targets are kept.
    """
    seen = links.where("kind = 'http' AND norm <> ''").groupBy("norm").agg(F.min(F.struct("page_id", "idx")).alias("first"))
    if checked is not None:
        seen = seen.join(checked.select(U.http_url(F.col("url")).alias("norm")), "norm", "left_anti")
    if cap is not None:
        seen = seen.orderBy("first").limit(cap)
    return seen.select("norm", F.col("first.page_id").alias("page_id"), F.col("first.idx").alias("idx"))


def page_targets(links: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` distinct targets of each page and whether the page has more."""
    w = Window.partitionBy("page_id").orderBy("idx")
    total = F.count("*").over(Window.partitionBy("page_id"))
    rows = first_occurrences(links).withColumns({"rn": F.row_number().over(w), "capped": total > cap})
    return rows.where(F.col("rn") <= cap).select("page_id", "norm", "rn", "capped")


def broken_links(links: DataFrame, results: DataFrame) -> DataFrame:
    """Every link to a failing target, one row per source link."""
    bad = link_results_latest(results).where((F.col("error") == "") & (F.col("status") >= 400))
    return links.where("kind = 'http'").join(bad, "norm").select("norm", "status", "page_id", "idx", "label")
