"""Hreflang clusters: tags, local audit, reciprocity and target health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import keep_true, settled


def normalize_tag(value: Column) -> Column:
    v = F.trim(value)
    parts = F.filter(F.split(v, "-"), lambda p: p != "")
    cased = F.transform(
        parts,
        lambda p, i: F.when(i == 0, F.lower(p))
        .when(p.rlike(r"^[A-Za-z]{4}$"), F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 3))))
        .when(p.rlike(r"^(?:[A-Za-z]{2}|\d{3})$"), F.upper(p))
        .otherwise(F.lower(p)),
    )
    return F.when(F.lower(v) == "x-default", F.lit("x-default")).otherwise(F.array_join(cased, "-"))


def valid_tag(value: Column) -> Column:
    shape = r"^[a-z]{2,3}(?:-[A-Z][a-z]{3})?(?:-(?:[A-Z]{2}|\d{3}))?(?:-(?:[A-Za-z0-9]{5,8}|\d[A-Za-z0-9]{3}))*$"
    tag = normalize_tag(value)
    return (tag == "x-default") | tag.rlike(shape)


def has_noindex(values: Column) -> Column:
    """``noindex`` among directives split at commas and semicolons, text after a colon ignored."""
    parts = F.flatten(F.transform(values, lambda v: F.split(F.lower(v), "[;,]")))
    return F.exists(parts, lambda p: F.trim(F.substring_index(F.trim(p), ":", 1)) == "noindex")


def tagged(edges: DataFrame) -> DataFrame:
    """Edges with normalised tag, comparable target and comparable source URL."""
    return settled(
        edges,
        {"tag": normalize_tag(F.col("lang")), "target": U.normalize_url(F.col("href"), "raw"), "source": U.normalize_url(F.col("page_url"), "raw", browser=True)},
    )


def hreflang_local(edges: DataFrame) -> DataFrame:
    """One row per local problem: ``page_id, code, tag``."""
    t = tagged(edges)
    invalid = t.where(~valid_tag(F.col("lang"))).select("page_id", F.lit("invalid-tag").alias("code"), F.trim("lang").alias("tag"))
    tags = t.where("tag <> ''").groupBy("page_id", "tag").agg(F.count("*").alias("n"))
    duplicate = tags.where("n > 1").select("page_id", F.lit("duplicate-tag").alias("code"), "tag")
    pages = t.groupBy("page_id").agg(
        F.count_if((F.col("target") == F.col("source")) & (F.col("tag") != "x-default")).alias("own"),
        F.count_if(F.col("tag") == "x-default").alias("fallback"),
    )
    codes = keep_true(
        (F.col("own") == 0, F.lit("missing-self")),
        (F.col("fallback") == 0, F.lit("missing-x-default")),
        (F.col("fallback") > 1, F.lit("duplicate-x-default")),
    )
    whole = pages.select("page_id", F.explode(codes).alias("code")).withColumn("tag", F.lit(""))
    return invalid.unionByName(duplicate).unionByName(whole)


def hreflang_targets(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Health of every declared alternate: reciprocity, status, redirect, noindex, canonical.

    ``pages``: ``page_id, norm_url, status, redirected, error, noindex, norm_canonical``;
    of pages that share a URL the one with the smallest id counts. Return links are found by joining the edges with themselves on
    (source, target) swapped; both sides are distinct on their key first.
    """
    facts = F.struct("status", "redirected", "error", "noindex", "norm_canonical")
    pages = pages.groupBy("norm_url").agg(F.min_by(facts, "page_id").alias("f")).select("norm_url", "f.*")
    t = tagged(edges)
    own = t.where("target = source AND tag <> 'x-default'").select("source", "tag").distinct()
    links = t.select(F.col("source").alias("from_"), F.col("target").alias("to_"), F.col("tag").alias("back_tag")).distinct()
    # A return link counts when its tag is one of the source's own tags (any tag if it has none).
    back = links.join(
        own.select(F.col("source").alias("to_"), F.col("tag").alias("back_tag"), F.lit(True).alias("fits")), ["to_", "back_tag"], "left"
    )
    back = back.groupBy("from_", "to_").agg(F.bool_or(F.coalesce("fits", F.lit(False))).alias("fits"))
    has_own = own.select(F.col("source").alias("source_")).distinct().withColumn("has_own", F.lit(True))
    rows = (
        t.join(has_own, F.col("source") == F.col("source_"), "left")
        .join(back, (F.col("target") == F.col("from_")) & (F.col("source") == F.col("to_")), "left")
        .join(pages.withColumnRenamed("norm_url", "known"), F.col("target") == F.col("known"), "left")
    )
    reciprocal = F.when(F.coalesce("has_own", F.lit(False)), F.coalesce("fits", F.lit(False))).otherwise(F.col("fits").isNotNull())
    mismatch = F.coalesce((F.col("norm_canonical") != "") & (F.col("norm_canonical") != F.col("target")), F.lit(False))
    status = F.coalesce("status", F.lit(0))
    error = F.coalesce("error", F.lit(""))
    noindex, redirected = F.coalesce("noindex", F.lit(False)), F.coalesce("redirected", F.lit(False))
    problems = keep_true(
        ((error != "") | (status == 0), F.when(error != "", error).otherwise(F.lit("network"))),
        ((error == "") & (status >= 400), F.concat(F.lit("HTTP "), status.cast("string"))),
        (redirected, F.lit("redirect")),
        (noindex, F.lit("noindex")),
        (mismatch, F.lit("canonical mismatch")),
        (~reciprocal, F.lit("missing reciprocal")),
    )
    critical = (error != "") | (status == 0) | (status >= 400) | noindex
    out = rows.withColumns({"reciprocal": reciprocal, "problems": problems})
    level = F.when(critical, "critical").when(F.size("problems") > 0, "warning").otherwise("ok")
    return out.select("page_id", "idx", "tag", "target", status.alias("status"), "reciprocal", "problems", level.alias("level"))


def hreflang_counts(targets: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("level") == s).alias(s)
    return targets.groupBy("page_id").agg(F.count("*").alias("total"), is_("critical"), is_("warning"), is_("ok"))
