"""Indexability verdicts with reasons, and the canonical and redirect diagnostics behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import keep_true, let, per_session, settled, str_array

HOPS = "array<struct<from:string,to:string,status:int>>"


def robots_directives(values: Column) -> Column:
    """Distinct lower-case directives, split at commas and white space."""
    parts = F.flatten(F.transform(values, lambda v: F.split(F.lower(v), r"[,\s]+")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def canonical_diagnostics(page: Column, canonical: Column) -> Column:
    """How the canonical URL differs from the page URL; all false when either is missing."""
    a, b = U.split_url(page), U.split_url(canonical)
    known = a.isNotNull() & b.isNotNull()
    both = lambda cond: F.coalesce(known & cond, F.lit(False))
    same_but_slash = (U.strip_trailing_slash(a["path"]) == U.strip_trailing_slash(b["path"])) & (a["path"] != b["path"])
    query = lambda s: F.when(s["query"] == "?", F.lit("")).otherwise(s["query"])
    return F.struct(
        both(U.hostname_of(a) != U.hostname_of(b)).alias("cross_domain"),
        both(a["scheme"] != b["scheme"]).alias("protocol_mismatch"),
        both(U.hostname_of(a) != U.hostname_of(b)).alias("hostname_mismatch"),
        both(same_but_slash).alias("trailing_slash_mismatch"),
        both(query(a) != query(b)).alias("query_mismatch"),
    )


def redirect_path(chain: Column) -> Column:
    """URLs visited by a chain of hops, without immediate repeats at the joints."""

    def step(path: Column, hop: Column) -> Column:
        last = F.try_element_at(path, F.lit(-1))
        joins = (hop["from"] != "") & (last.isNull() | (last != hop["from"]))
        return F.concat(
            path,
            F.when(joins, F.array(hop["from"])).otherwise(str_array([])),
            F.when(hop["to"] != "", F.array(hop["to"])).otherwise(str_array([])),
        )

    ends = lambda h: F.transform(F.array(h["from"], h["to"]), lambda u: U.normalize_url(u))
    hops = F.transform(chain, lambda h: let(ends(h), lambda e: F.struct(e[0].alias("from"), e[1].alias("to"))))
    return F.aggregate(hops, F.array().cast("array<string>"), step)


@per_session
def redirect_diagnostics(chain: Column) -> Column:
    return let(
        redirect_path(chain),
        lambda path: F.struct(
            F.size(chain).alias("hops"),
            (F.size(path) > F.size(F.array_distinct(path))).alias("loop"),
            (F.size(chain) > 5).alias("excessive"),
        ),
    )


def indexability(df: DataFrame) -> DataFrame:
    """Add ``verdict``, ``indexable``, ``reasons`` (codes in order) and the directive arrays.

    Uses ``status``, ``x_robots``, ``redirect_chain`` and ``robots_blocked`` when present;
    a corpus without a fetch log is judged on its pages alone.
    """
    have = set(df.columns)
    if not {"norm_url", "norm_canonical"} <= have:
        df = settled(df, comparable_urls())
    flags = tuple(c in have for c in ("status", "x_robots", "redirect_chain", "robots_blocked"))
    first, second = _verdict_columns(*flags)
    out = settled(settled(df, first), second)
    return out.withColumn("indexable", F.col("verdict") == "Indexable")


@per_session
def _verdict_columns(has_status: bool, has_x_robots: bool, has_chain: bool, has_blocked: bool):
    no_hops = F.array().cast(HOPS)
    status = F.col("status") if has_status else F.lit(None).cast("int")
    x_robots = F.coalesce(F.col("x_robots"), str_array([])) if has_x_robots else str_array([])
    chain = F.coalesce(F.col("redirect_chain"), no_hops) if has_chain else no_hops
    blocked = F.coalesce(F.col("robots_blocked"), F.lit(False)) if has_blocked else F.lit(False)
    first = {
        "meta_directives": robots_directives(F.transform("robots", lambda r: r["content"])),
        "header_directives": robots_directives(x_robots),
        "redirects": redirect_diagnostics(chain),
    }
    meta = F.array_contains("meta_directives", "noindex")
    header = F.array_contains("header_directives", "noindex")
    explicit = F.array_contains("meta_directives", "index") | F.array_contains("header_directives", "index")
    count = F.col("canonical")["count"]
    different = (count == 1) & (F.col("norm_canonical") != "") & (F.col("norm_url") != "") & (
        F.col("norm_canonical") != F.col("norm_url")
    )
    error = F.coalesce(status >= 400, F.lit(False))
    hops = F.col("redirects")["hops"]
    reasons = keep_true(
        (error, F.lit("http.error")),
        (blocked, F.lit("robots.blocked")),
        (meta, F.lit("robots.meta.noindex")),
        (header, F.lit("robots.header.noindex")),
        (explicit & (meta | header), F.lit("robots.conflict")),
        (hops > 0, F.lit("redirect.detected")),
        (F.col("redirects")["loop"], F.lit("redirect.loop")),
        (F.col("redirects")["excessive"], F.lit("redirect.excessive")),
        (different, F.lit("canonical.different")),
        (count > 1, F.lit("canonical.multiple")),
    )
    verdict = (
        F.when(error, "Error")
        .when(blocked, "Blocked")
        .when(meta | header, "Noindex")
        .when(hops > 0, "Redirected")
        .when(different, "Canonicalized")
        .otherwise("Indexable")
    )
    second = {
        "verdict": verdict,
        "reasons": let(reasons, lambda r: F.when(F.size(r) == 0, F.array(F.lit("indexable"))).otherwise(r)),
    }
    return first, second


@per_session
def comparable_urls() -> dict[str, Column]:
    return {"norm_url": U.normalize_url(F.col("url"), browser=True), "norm_canonical": U.normalize_url(F.col("canonical")["href"])}


def _changed(a: DataFrame, b: DataFrame, fields: dict[str, str], names: tuple[str, str]) -> DataFrame:
    """Rows (page_id, field, left, right) where two versions of a page differ."""
    def long(df: DataFrame, side: str) -> DataFrame:
        cells = [F.struct(F.lit(label).alias("field"), F.expr(e).cast("string").alias(side)) for label, e in fields.items()]
        return df.select("page_id", F.explode(F.array(*cells)).alias("c")).select("page_id", "c.*")

    left, right = long(a, names[0]), long(b, names[1])
    return left.join(right, ["page_id", "field"]).where(~F.col(names[0]).eqNullSafe(F.col(names[1])))


def indexability_diff(rendered: DataFrame, raw: DataFrame) -> DataFrame:
    """Verdict, directives and canonical that differ between the rendered and the raw page."""
    fields = {
        "Verdict": "verdict",
        "Meta directives": "array_join(meta_directives, ',')",
        "Header directives": "array_join(header_directives, ',')",
        "Canonical": "norm_canonical",
    }
    return _changed(rendered, raw, fields, ("rendered", "raw"))


def facts_diff(rendered: DataFrame, raw: DataFrame) -> DataFrame:
    """The eight page facts that differ between the rendered and the raw page."""
    fields = {
        "title": "title",
        "description": "description",
        "canonical": "canonical.href",
        "H1 count": "size(filter(headings, h -> h.level = 1))",
        "Heading count": "size(headings)",
        "Link count": "size(links)",
        "Image count": "size(images)",
        "Schema types": "array_join(array_sort(array_distinct(flatten(transform(schemas, s -> s.types)))), ',')",
    }
    return _changed(rendered, raw, fields, ("rendered", "raw"))
