"""Fetch-log projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import settled, str_array

# Response headers the audits read (fixed values).
SEO_HEADERS = ["x-robots-tag", "content-type", "content-language", "link", "cache-control"]
SECURITY_HEADERS = [
    "content-security-policy", "content-security-policy-report-only", "strict-transport-security", "x-frame-options",
    "referrer-policy", "permissions-policy", "x-content-type-options",
]


def header(name: str):
    """Values of one header, empty when missing."""
    return F.coalesce(F.try_element_at("picked", F.lit(name)), str_array([]))


def response_meta(fetch_log: DataFrame) -> DataFrame:
    """One row per fetched URL: status, redirects and the audited headers, names lower-cased.

    A header that occurs under several spellings keeps all its values. ``page_id`` is kept
    where the log has it.
    """
    wanted = SEO_HEADERS + SECURITY_HEADERS
    entries = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]).isin(wanted))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    merged = F.map_from_entries(
        F.transform(
            names,
            lambda n: F.struct(
                n, F.flatten(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]))
            ),
        )
    )
    rows = fetch_log.withColumn("picked", F.coalesce(merged, F.create_map().cast("map<string,array<string>>")))
    snake = lambda n: n.replace("-", "_")
    rows = settled(
        rows, {"norm_url": U.normalize_url(F.col("url"), browser=True), "final_": U.normalize_url(F.col("final_url"), browser=True)}
    )
    return rows.select(
        *[c for c in ("page_id",) if c in fetch_log.columns],
        "norm_url",
        "status",
        "redirected",
        F.col("final_").alias("final_url"),
        "error",
        "redirect_chain",
        "captured_at",
        header("x-robots-tag").alias("x_robots"),
        *[header(n).alias(snake(n)) for n in wanted if n != "x-robots-tag"],
    )


def latest(results: DataFrame, key: str, at: str) -> DataFrame:
    """Last result per key."""
    others = [c for c in results.columns if c != key]
    last = results.groupBy(key).agg(F.max_by(F.struct(*others), at).alias("r"))
    return last.select(key, "r.*")
