"""Transport security: response headers, mixed content, third-party scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let, per_session, settled

MIXED_SAMPLE = 50
# Header rows by key (fixed values).
HEADER_KEYS = ["csp", "hsts", "xfo", "referrer", "permissions", "xcto"]


def parse_csp(value: Column) -> Column:
    """Map of directive to its tokens; a repeated directive keeps its last tokens."""
    chunks = F.filter(
        F.transform(F.split(value, ";"), lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")),
        lambda t: F.size(t) > 0,
    )
    entries = F.transform(chunks, lambda t, i: F.struct(F.lower(t[0]).alias("k"), F.slice(t, 2, 1 << 20).alias("v"), i.alias("i")))
    last = lambda es: F.filter(es, lambda e: ~F.exists(es, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))
    return let(entries, lambda es: F.map_from_entries(F.transform(last(es), lambda e: F.struct(e["k"], e["v"]))))


def csp_risks(value: Column) -> Column:
    """Broad script tokens of the policy, most specific directive first."""
    tokens = lambda m: F.coalesce(F.try_element_at(m, F.lit("script-src")), F.try_element_at(m, F.lit("default-src")), F.array().cast("array<string>"))
    return let(
        parse_csp(value),
        lambda m: F.array_compact(
            F.array(
                F.when(F.array_contains(tokens(m), "'unsafe-eval'"), F.lit("'unsafe-eval'")),
                F.when(F.array_contains(tokens(m), "*"), F.lit("*")),
            )
        ),
    )


def has_frame_ancestors(value: Column) -> Column:
    return F.map_contains_key(parse_csp(value), "frame-ancestors")


def parse_hsts(value: Column) -> Column:
    """``struct(max_age, include_subdomains, preload)``."""
    parts = F.transform(F.split(value, ";"), lambda p: F.lower(F.trim(p)))
    ages = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"^max-age\s*=\s*(\d+)$", 1)), lambda a: a != "")
    return F.struct(
        F.try_element_at(ages, F.lit(-1)).try_cast("bigint").alias("max_age"),
        F.array_contains(parts, "includesubdomains").alias("include_subdomains"),
        F.array_contains(parts, "preload").alias("preload"),
    )


@per_session
def _header_rows() -> Column:
    first = lambda c: F.trim(F.coalesce(F.get(c, F.lit(0)), F.lit("")))
    csp, report = first("content_security_policy"), first("content_security_policy_report_only")
    hsts, xfo = first("strict_transport_security"), first("x_frame_options")
    referrer, permissions, xcto = first("referrer_policy"), first("permissions_policy"), first("x_content_type_options")
    https = F.col("https")

    def row(key: str, value: Column, state: Column, code: Column, severity: Column) -> Column:
        return F.struct(
            F.lit(key).alias("key"), value.alias("value"), state.alias("state"), severity.alias("severity"), code.alias("code")
        )

    warn = lambda state: F.when(state.isin("missing", "review"), F.lit("warning")).otherwise(F.lit(""))
    none = F.lit(None).cast("string")
    csp_state = F.when(csp == "", "missing").when(F.size(csp_risks(csp)) > 0, "review").otherwise("present")
    hsts_state = (
        F.when(~https, "not-applicable")
        .when(hsts == "", "missing")
        .when(F.coalesce(parse_hsts(hsts)["max_age"], F.lit(0)) == 0, "review")
        .otherwise("present")
    )
    xfo_state = (
        F.when(F.lower(xfo).isin("deny", "sameorigin"), "present")
        .when(xfo != "", "review")
        .when(has_frame_ancestors(csp), "covered")
        .otherwise("missing")
    )
    unsafe = F.array_contains(F.transform(F.split(F.lower(referrer), ","), lambda p: F.trim(p)), "unsafe-url")
    ref_state = F.when(referrer == "", "missing").when(unsafe, "review").otherwise("present")
    per_state = F.when(permissions == "", "missing").otherwise("present")
    xcto_state = F.when(xcto == "", "missing").when(F.lower(xcto) != "nosniff", "review").otherwise("present")
    code = lambda state, missing, review: F.when(state == "missing", F.lit(missing)).when(state == "review", F.lit(review)).otherwise(none)
    return F.array(
        row("csp", csp, csp_state, code(csp_state, "missing-csp", "csp-broad-script-policy"), warn(csp_state)),
        row("hsts", hsts, hsts_state, code(hsts_state, "missing-hsts", "weak-hsts"), warn(hsts_state)),
        row("xfo", xfo, xfo_state, code(xfo_state, "missing-frame-protection", "invalid-x-frame-options"), warn(xfo_state)),
        row("referrer", referrer, ref_state, code(ref_state, "missing-referrer-policy", "unsafe-referrer-policy"), warn(ref_state)),
        row("permissions", permissions, per_state, none, F.when(per_state == "missing", F.lit("info")).otherwise(F.lit(""))),
        row("xcto", xcto, xcto_state, code(xcto_state, "missing-nosniff", "invalid-nosniff"), warn(xcto_state)),
    )


def security_headers(meta: DataFrame) -> DataFrame:
    """Add ``headers``: one state row per audited header. Needs ``response_meta`` columns and ``norm_url``."""
    return settled(meta.withColumn("https", F.col("norm_url").startswith("https:")), {"headers": _header_rows()})


def header_rows(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode("headers").alias("h")).select(*keep, "h.*")


def mixed_content(resources: DataFrame) -> DataFrame:
    """http resources of https pages, once per URL and kind: ``page_id, url, kind, active``.

    ``resources``: ``page_id, page_url, url, kind, active`` from markup and timing.
    """
    rows = resources.where("page_url ILIKE 'https:%' AND url LIKE 'http:%'")
    return rows.groupBy("page_id", "url", "kind").agg(F.bool_or("active").alias("active"))


def timing_candidates(timing: DataFrame) -> DataFrame:
    """Resource-timing rows in the shape of :func:`mixed_content` input."""
    return timing.select("page_id", "page_url", "url", "kind", (~F.col("kind").isin("image", "media")).alias("active"))


def mixed_summary(mixed: DataFrame) -> DataFrame:
    return mixed.groupBy("page_id").agg(
        F.count("*").alias("mixed"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("passive")
    )


def mixed_sample(mixed: DataFrame, k: int = MIXED_SAMPLE) -> DataFrame:
    """First ``k`` mixed resources per page, active first (a top-k report)."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy(F.desc("active"), "url", "kind")
    return mixed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def third_party_scripts(scripts: DataFrame) -> DataFrame:
    """Third-party script count and distinct hosts per page."""
    rows = scripts.where("external AND third_party AND host <> ''")
    hosts = rows.groupBy("page_id", "host").agg(F.count("*").alias("n"))
    return hosts.groupBy("page_id").agg(
        F.sum("n").alias("scripts"), F.count("*").alias("hosts"), F.min("host").alias("first_host")
    )


def security_issues(headers: DataFrame, mixed: DataFrame) -> DataFrame:
    """``page_id, code, severity``: transport, mixed content and header findings.

    ``headers``: pages with ``page_id, norm_url, headers``; pages are joined to at most
    one summary row each.
    """
    rows = headers.join(mixed_summary(mixed), "page_id", "left")
    entry = lambda cond, code, sev: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity")))
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    fixed = F.array_compact(
        F.array(
            entry(some("active"), "active-mixed-content", "critical"),
            entry(~F.col("norm_url").startswith("https:"), "page-not-https", "critical"),
            entry(some("passive"), "passive-mixed-content", "warning"),
        )
    )
    found = F.transform(
        F.filter("headers", lambda h: h["code"].isNotNull()),
        lambda h: F.struct(h["code"].alias("code"), F.lit("warning").alias("severity")),
    )
    return rows.select("page_id", F.explode(F.concat(fixed, found)).alias("i")).select("page_id", "i.*")
