"""Per-page audits: issues, policy, verdicts, page types, content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import clean
from ..operators import content as C
from ..operators import extract as X
from ..operators import indexability as N
from ..operators import issues as I
from ..operators import pagetype as T
from ..operators import rules as R
from ..operators import schema as S
from ..plans.audit import page_facts, page_reports
from ..sources.fetch import response_meta
from .facts import LINKS_SQL, HREFLANG_SQL
from .registry import keys, query, table
from .seed import BASE_SQL, SEED_SQL, fetch_log, seeded_pages

_T = "trim(title)"
JUMP = "(p % 3 = 1 OR (p % 17 = 0 AND (p % 13 = 0 OR p % 3 = 2)))"
DUP_LANG = "p IN (SELECT p FROM hl GROUP BY p HAVING count(*) > count(DISTINCT lower(tag)))"
# id, severity, condition on the seeded columns; in check order.
CHECKS = [
    ("title.missing", "critical", f"{_T} = ''"),
    ("title.short", "warning", f"{_T} <> '' AND length({_T}) < 15"),
    ("title.long", "warning", f"length({_T}) > 60"),
    ("description.missing", "warning", "description = ''"),
    ("description.short", "warning", "description <> '' AND length(description) < 50"),
    ("description.long", "warning", "length(description) > 160"),
    ("viewport.missing", "warning", "viewport = ''"),
    ("canonical.missing", "warning", "canon_count = 0"),
    ("canonical.multiple", "critical", "canon_count > 1"),
    ("canonical.different", "warning", "canon_href <> '' AND canon_href <> u"),
    ("robots.meta.noindex", "critical", "p % 7 IN (0, 2)"),
    ("robots.header.noindex", "critical", "xrobots = 'noindex'"),
    ("robots.nofollow", "warning", "(p % 7 = 1 OR xrobots LIKE '%nofollow%')"),
    ("headings.h1.multiple", "warning", "p % 13 = 0"),
    ("headings.jump", "warning", JUMP),
    ("html.lang.missing", "warning", "trim(lang) = ''"),
    ("hreflang.duplicate", "warning", DUP_LANG),
    ("images.alt.missing", "warning", "p % 2 = 1 AND p % 3 > 0"),
    ("images.dimensions.missing", "warning", "p % 3 > 0 AND p % 5 <> 0"),
    ("links.label.missing", "warning", "p % 9 = 2"),
    ("links.javascript", "warning", "p % 8 = 1"),
    ("schema.invalid", "critical", "p % 16 = 3"),
    ("schema.product.name", "warning", "p % 4 = 1 AND p % 10 = 1"),
    ("schema.product.offers", "warning", "p % 4 = 1 AND p % 12 NOT IN (5, 9)"),
    ("http.error", "critical", "status >= 400"),
]


def checks_sql(fetched: bool = True) -> str:
    """CTE ``iss(p, pos, id, severity)``."""
    parts = []
    for pos, (id_, severity, cond) in enumerate(CHECKS):
        if not fetched and ("xrobots" in cond or "status" in cond):
            if id_ == "robots.nofollow":
                cond = "p % 7 = 1"
            else:
                continue
        parts.append(f"SELECT p, {pos} AS pos, '{id_}' AS id, '{severity}' AS severity FROM s WHERE {cond}")
    return HREFLANG_SQL + ",\niss AS (" + "\nUNION ALL ".join(parts) + ")"


ISSUES_SQL = checks_sql()
SCORES = """
sc_ AS (SELECT s.p, count(id) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical,
          count(*) FILTER (WHERE severity = 'warning') AS warning,
          greatest(0, 100 - 20 * count(*) FILTER (WHERE severity = 'critical') - 5 * count(*) FILTER (WHERE severity = 'warning')) AS score
        FROM s LEFT JOIN iss ON iss.p = s.p GROUP BY s.p)"""


def _evaluated(spark, sf_dir, *extra):
    fields = tuple(dict.fromkeys((*I.FACTS_NEEDED, *extra)))
    return I.evaluate(page_facts(seeded_pages(spark, sf_dir), *fields, fetch_log=fetch_log(spark, sf_dir)))


@query("issues", f"WITH {ISSUES_SQL} SELECT p AS page_id, id, severity FROM iss")
def issues(spark, sf_dir):
    return I.issue_rows(_evaluated(spark, sf_dir)).select("page_id", "id", "severity")


@query(
    "issues_raw",
    f"""WITH {BASE_SQL} SELECT p AS page_id, id, message FROM (
        SELECT p, 'title.short' AS id, length({_T}) || ' characters; configured minimum is 15.' AS message FROM b WHERE {_T} <> '' AND length({_T}) < 15
        UNION ALL SELECT p, 'title.missing', 'The page has no non-empty <title> element.' FROM b WHERE {_T} = ''
        UNION ALL SELECT p, 'description.missing', 'No non-empty meta description was found.' FROM b
        UNION ALL SELECT p, 'viewport.missing', 'No viewport meta tag was found.' FROM b
        UNION ALL SELECT p, 'canonical.missing', 'No canonical link element was found.' FROM b
        UNION ALL SELECT p, 'links.label.missing', n || ' HTTP link' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' have no text, aria-label, title, or image alt label.'
          FROM (SELECT p, len(regexp_extract_all(html, '<a href="[^"]*">\\s*</a>')) AS n FROM b) WHERE n > 0)""",
)
def issues_raw(spark, sf_dir):
    facts = S.with_schemas(X.extract_facts(table(spark, sf_dir, "pages"), *I.FACTS_NEEDED))
    return I.issue_rows(I.evaluate(facts)).select("page_id", "id", "message")


_LEAST = {"title.short": "minimum is 15", "title.long": "maximum is 60", "description.short": "minimum is 50", "description.long": "maximum is 160"}
_SAID = {
    "title.missing": "The page has no non-empty <title> element.", "description.missing": "No non-empty meta description was found.", "viewport.missing": "No viewport meta tag was found.",
    "canonical.missing": "No canonical link element was found.", "canonical.multiple": "2 canonical link elements were found.",
    "robots.meta.noindex": "The page asks compliant crawlers not to index it.", "robots.header.noindex": "The HTTP response asks compliant crawlers not to index this page.",
    "robots.nofollow": "A robots directive asks compliant crawlers not to follow links from this page.", "headings.h1.multiple": "2 H1 headings were found.",
    "html.lang.missing": "The root HTML element has no language value.", "schema.product.name": "A Product JSON-LD object was found without a name.",
    "schema.product.offers": "A Product JSON-LD object was found without offers.", "http.error": "The main document returned an error status.",
}
TITLES = {
    "title.missing": "Missing title", "title.short": "Title is short", "title.long": "Title is long", "description.missing": "Missing meta description", "description.short": "Meta description is short",
    "description.long": "Meta description is long", "viewport.missing": "Missing viewport meta tag", "canonical.missing": "Missing canonical", "canonical.multiple": "Multiple canonicals",
    "canonical.different": "Canonical points elsewhere", "robots.meta.noindex": "Meta robots contains noindex", "robots.header.noindex": "X-Robots-Tag contains noindex", "robots.nofollow": "Page-level nofollow found",
    "headings.h1.multiple": "Multiple H1 headings", "headings.jump": "Heading levels are skipped", "html.lang.missing": "Missing html lang attribute", "hreflang.duplicate": "Duplicate hreflang values",
    "images.alt.missing": "Images missing alt attributes", "images.dimensions.missing": "Images missing explicit dimensions", "links.label.missing": "Links without descriptive text", "links.javascript": "javascript: links found",
    "schema.invalid": "Invalid JSON-LD", "schema.product.name": "Product schema missing name", "schema.product.offers": "Product schema missing offers",
}
# What is counted, by id: the noun and what follows it.
_COUNTED = {
    "headings.jump": ("heading transition", " skip one or more levels."), "hreflang.duplicate": ("duplicate hreflang declaration", " found."), "images.alt.missing": ("image", " have no alt attribute."),
    "images.dimensions.missing": ("image", " lack a width or height attribute."), "links.label.missing": ("HTTP link", " have no text, aria-label, title, or image alt label."),
    "links.javascript": ("javascript: link", " found."), "schema.invalid": ("JSON-LD block", " could not be parsed."),
}
MESSAGES_SQL = (
    ISSUES_SQL + "," + LINKS_SQL.removeprefix(SEED_SQL + ",")
    + """,
hd AS (SELECT p, level, o, row_number() OVER (PARTITION BY p ORDER BY o) - 1 AS idx FROM (
  SELECT p, 0 AS o, 1 AS level FROM s UNION ALL SELECT p, 1, 2 FROM s WHERE p % 3 = 0 UNION ALL SELECT p, 2, 4 FROM s WHERE p % 3 = 1 UNION ALL SELECT p, 3, 1 FROM s WHERE p % 13 = 0 UNION ALL SELECT p, 4, 3 FROM s WHERE p % 17 = 0)),
rf AS (
  SELECT p, 'headings.h1.multiple' AS id, idx FROM hd WHERE level = 1
  UNION ALL SELECT p, 'headings.jump', idx FROM (SELECT *, lag(level) OVER (PARTITION BY p ORDER BY idx) AS above FROM hd) WHERE level > above + 1
  UNION ALL SELECT p, 'hreflang.duplicate', idx FROM (SELECT *, row_number() OVER (PARTITION BY p, lower(tag) ORDER BY idx) AS n FROM hl) WHERE n > 1
  UNION ALL SELECT p, 'images.alt.missing', 0 FROM s
  UNION ALL SELECT p, 'images.dimensions.missing', unnest(range(0, p % 3)) FROM s
  UNION ALL SELECT p, 'links.label.missing', idx FROM lk WHERE kind = 'http' AND trim(label) = ''
  UNION ALL SELECT p, 'links.javascript', idx FROM lk WHERE kind = 'javascript'
  UNION ALL SELECT p, 'schema.invalid', 0 FROM s),
rs_ AS (SELECT p, id, count(*) AS n, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS refs FROM rf GROUP BY p, id)"""
)
MESSAGE = (
    "CASE i.id WHEN 'canonical.different' THEN canon_href "
    + " ".join(f"WHEN '{k}' THEN length({'trim(title)' if k.startswith('title') else 'description'}) || ' characters; configured {v}.'" for k, v in _LEAST.items())
    + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SAID.items())
    + " " + " ".join(f"WHEN '{k}' THEN n || ' {noun}' || CASE WHEN n = 1 THEN '' ELSE 's' END || '{rest}'" for k, (noun, rest) in _COUNTED.items()) + " END"
)


@query(
    "issue_messages",
    f"""WITH {MESSAGES_SQL} SELECT i.p AS page_id, i.id, {MESSAGE} AS message, coalesce(r.refs, '') AS refs FROM iss i JOIN s ON s.p = i.p LEFT JOIN rs_ r ON r.p = i.p AND r.id = i.id""",
)
def issue_messages(spark, sf_dir):
    rows = I.issue_rows(_evaluated(spark, sf_dir))
    return rows.select("page_id", "id", "message", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))


@query(
    "score",
    f"""WITH {ISSUES_SQL}, {SCORES} SELECT p AS page_id, score::INT AS score, critical::INT AS critical, warning::INT AS warning,
        CASE WHEN score >= 90 THEN 'good' WHEN score >= 70 THEN 'warn' ELSE 'bad' END AS band FROM sc_""",
)
def score(spark, sf_dir):
    return I.with_score(_evaluated(spark, sf_dir)).select("page_id", "score", "critical", "warning", "band")


@query("severity_counts", f"WITH {ISSUES_SQL} SELECT severity, id, count(*) AS pages FROM iss GROUP BY ALL")
def severity_counts(spark, sf_dir):
    return I.issue_rows(_evaluated(spark, sf_dir)).groupBy("severity", "id").agg(F.count("*").alias("pages"))


_STRICT = {
    "thresholds": {
        "title_min": 20, "title_max": 50, "description_min": 50, "description_max": 160, "oversized_image_ratio": 2, "image_max_bytes": 524288,
    },
    "required": {"title": True, "description": False, "canonical": True, "h1": True, "schema": True, "hreflang": True, "https": True},
    "disabled_checks": ["viewport.missing", "links.javascript"],
    "severity_overrides": {"canonical.missing": "critical", "schema.required": "info"},
}
_TYPED = "(p % 4 IN (1, 2) OR p % 16 IN (7, 11, 15))"
RULED_SQL = (
    checks_sql().replace(f"length({_T}) < 15", f"length({_T}) < 20").replace(f"length({_T}) > 60", f"length({_T}) > 50")
    + f""",
ruled AS (
  SELECT p, id, CASE id WHEN 'canonical.missing' THEN 'critical' WHEN 'schema.required' THEN 'info' ELSE severity END AS severity FROM (
    SELECT p, id, severity FROM iss WHERE id NOT IN ('viewport.missing', 'links.javascript', 'description.missing')
    UNION ALL SELECT p, 'schema.required', 'warning' FROM s WHERE NOT {_TYPED}
    UNION ALL SELECT p, 'hreflang.required', 'warning' FROM s WHERE p NOT IN (SELECT p FROM hl)
    UNION ALL SELECT p, 'https.required', 'critical' FROM s WHERE scheme <> 'https')
)"""
)


@query("apply_rules", f"WITH {RULED_SQL} SELECT p AS page_id, id, severity FROM ruled")
def apply_rules(spark, sf_dir):
    df = page_facts(seeded_pages(spark, sf_dir), *I.FACTS_NEEDED, fetch_log=fetch_log(spark, sf_dir))
    df = I.apply_rules(I.evaluate(df.withColumn("rules", R.rules_literal(_STRICT))))
    return I.issue_rows(df).select("page_id", "id", "severity")


@query(
    "issue_policy",
    f"""WITH {ISSUES_SQL} SELECT p AS page_id, id, CASE WHEN id = 'canonical.missing' THEN 'critical' ELSE severity END AS severity
        FROM iss WHERE id NOT IN ('viewport.missing', 'links.javascript')""",
)
def issue_policy(spark, sf_dir):
    df = _evaluated(spark, sf_dir)
    return I.issue_rows(df.withColumn("issues", I.apply_policy(F.col("issues"), R.rules_literal(_STRICT)))).select(
        "page_id", "id", "severity"
    )


@query(
    "top_issues",
    f"""WITH {ISSUES_SQL} SELECT p AS page_id, (rn - 1)::INT AS pos, id FROM (
        SELECT p, id, row_number() OVER (PARTITION BY p ORDER BY pos) AS rn FROM iss WHERE severity = 'warning') WHERE rn <= 5""",
)
def top_issues(spark, sf_dir):
    return I.top_issues(_evaluated(spark, sf_dir), 5, "warning").select("page_id", "pos", "id")


@query(
    "custom_checks",
    f"""WITH {SEED_SQL} SELECT p AS page_id, 'custom.deep-url' AS id FROM s WHERE len(string_split(u, '/')) > 5
        UNION ALL SELECT p, 'custom.h1' FROM s WHERE p % 13 = 0""",
)
def custom_checks(spark, sf_dir):
    facts = page_facts(seeded_pages(spark, sf_dir), *I.FACTS_NEEDED)
    custom = [
        ("custom.deep-url", "info", "size(split(norm_url, '/')) > 5"),
        ("custom.h1", "warning", "size(filter(headings, h -> h.level = 1)) > 1"),
    ]
    rows = I.issue_rows(I.evaluate(facts, custom=custom))
    return rows.where("category = 'Custom'").select("page_id", "id")


# --- rule configurations and domain profiles built from the customer and nation tables ---


def _configs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"),
        F.struct(
            F.struct(
                F.when(key % 4 == 0, None).otherwise((key % 90) - 5.0).alias("title_min"),
                ((key % 70) * 10.0).alias("title_max"),
                F.lit(None).cast("double").alias("description_min"),
                F.when(key % 3 == 0, (key % 2500) * 1.0).alias("description_max"),
                ((key % 30) / 1.0).alias("oversized_image_ratio"),
                (key * 1000.0).alias("image_max_bytes"),
            ).alias("thresholds"),
            F.struct(
                F.when(key % 2 == 0, F.lit(False)).alias("title"),
                *[F.lit(None).cast("boolean").alias(k) for k in ("description", "canonical", "h1", "schema", "hreflang", "https")],
            ).alias("required"),
            F.array(F.lit("x.b"), F.lit("bad id!"), F.lit("a.a"), F.lit("x.b")).alias("disabled_checks"),
            F.create_map(F.lit("a"), F.lit("CRITICAL"), F.lit("b"), F.lit("fatal")).alias("severity_overrides"),
        ).alias("config"),
    )


_CFG = """
cfg AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 90) - 5.0 END AS tmin, (c_custkey % 70) * 10.0 AS tmax,
          CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 2500) * 1.0 END AS dmax, (c_custkey % 30) AS ratio, c_custkey * 1000.0 AS bytes, c_custkey % 2 = 0 AS off
        FROM customer)"""


@query(
    "normalize_rules",
    f"""WITH {_CFG}, n AS (SELECT id, least(500, greatest(0, coalesce(tmin, 15))) AS a, least(500, greatest(1, coalesce(tmax, 60))) AS b,
          50 AS c, least(2000, greatest(1, coalesce(dmax, 160))) AS d, least(20, greatest(1, ratio)) AS r,
          least(104857600, greatest(1024, bytes)) AS m, NOT off AS title FROM cfg)
        SELECT id, least(a, b)::INT AS title_min, greatest(a, b)::INT AS title_max, least(c, d)::INT AS description_min,
          greatest(c, d)::INT AS description_max, r::DOUBLE AS ratio, m::INT AS image_max_bytes, title AS need_title, true AS need_h1,
          'a.a,x.b' AS disabled, 'a=critical' AS overrides FROM n""",
)
def normalize_rules(spark, sf_dir):
    r = _configs(spark, sf_dir).select("id", R.normalize_rules(F.col("config")).alias("r"))
    overrides = F.transform(F.map_entries("r.severity_overrides"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return r.select(
        "id",
        *[F.col(f"r.thresholds.{k}").alias(k) for k in ("title_min", "title_max", "description_min", "description_max", "image_max_bytes")],
        F.col("r.thresholds.oversized_image_ratio").alias("ratio"),
        F.col("r.required.title").alias("need_title"),
        F.col("r.required.h1").alias("need_h1"),
        F.array_join("r.disabled_checks", ",").alias("disabled"),
        F.array_join(overrides, ",").alias("overrides"),
    )


@query(
    "validate_rules",
    f"""WITH {_CFG} SELECT id, error FROM (
        SELECT id, 'Title minimum must be between 0 and 500.' AS error FROM cfg WHERE tmin IS NULL OR tmin < 0 OR tmin > 500
        UNION ALL SELECT id, 'Title maximum must be between 1 and 500.' FROM cfg WHERE tmax < 1 OR tmax > 500
        UNION ALL SELECT id, 'Description minimum must be between 0 and 2000.' FROM cfg
        UNION ALL SELECT id, 'Description maximum must be between 1 and 2000.' FROM cfg WHERE dmax IS NULL OR dmax < 1 OR dmax > 2000
        UNION ALL SELECT id, 'Oversized image ratio must be between 1 and 20.' FROM cfg WHERE ratio < 1 OR ratio > 20
        UNION ALL SELECT id, 'Image file-size limit must be between 1024 and 104857600.' FROM cfg WHERE bytes < 1024 OR bytes > 104857600
        UNION ALL SELECT id, 'Title minimum cannot exceed title maximum.' FROM cfg WHERE tmin > tmax)""",
)
def validate_rules(spark, sf_dir):
    return _configs(spark, sf_dir).select("id", F.explode(R.validate_rules(F.col("config"))).alias("error"))


def profiles(spark, sf_dir):
    """One profile per host of the corpus, from its first page."""
    pages = keys(spark, sf_dir).select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    hosts = pages.groupBy("host").agg(F.min("page_id").alias("k"))
    k = F.col("k")
    nothing = F.lit(None).cast("double")
    return hosts.select(
        F.concat(F.lit("https://"), F.upper("host"), F.lit("/x")).alias("hostname"),
        F.concat(F.lit("  Site  "), k.cast("string")).alias("label"),
        (k % 5 != 4).alias("enabled"),
        F.struct(
            F.struct(
                F.when(k % 2 == 0, F.lit(30.0)).alias("title_min"),
                nothing.alias("title_max"),
                nothing.alias("description_min"),
                F.when(k % 3 == 0, F.lit(80.0)).alias("description_max"),
                nothing.alias("oversized_image_ratio"),
                F.when(k % 7 == 3, F.lit(12.0)).alias("image_max_bytes"),
            ).alias("thresholds"),
            F.struct(
                F.lit(None).cast("boolean").alias("title"),
                F.when(k % 4 == 1, F.lit(False)).alias("description"),
                *[F.lit(None).cast("boolean").alias(n) for n in ("canonical", "h1", "schema", "hreflang", "https")],
            ).alias("required"),
            F.lit(None).cast("array<string>").alias("disabled_checks"),
            F.create_map(F.lit("canonical.missing"), F.lit("critical")).alias("severity_overrides"),
        ).alias("rules"),
        F.array(F.lit("Product"), F.lit("product"), F.lit("bad type!")).alias("schema_types"),
        F.array(F.lit("EN"), F.lit("x-default"), F.lit("e n")).alias("hreflang"),
        F.array(F.lit("viewport.missing"), F.lit("no such!")).alias("ignore_checks"),
    )


_PROFILES = """
pf AS (SELECT host, min(p) AS k FROM s GROUP BY host), pf_all AS (SELECT host, k, row_number() OVER (ORDER BY host) AS rn FROM pf)"""


@query(
    "profile_summary",
    f"WITH {SEED_SQL}, {_PROFILES} SELECT host AS hostname, 'Site ' || k AS label, k % 5 <> 4 AS enabled, 'Product' AS schema_types, 'en,x-default' AS hreflang, 'viewport.missing' AS ignored FROM pf",
)
def profile_summary(spark, sf_dir):
    s = R.profile_summary(profiles(spark, sf_dir))
    return s.select(
        "hostname", "label", "enabled", F.array_join("schema_types", ",").alias("schema_types"),
        F.array_join("hreflang", ",").alias("hreflang"), F.array_join("ignore_checks", ",").alias("ignored"),
    )


@query(
    "validate_profiles",
    f"""WITH {SEED_SQL}, {_PROFILES} SELECT 'https://' || upper(host) || '/x' AS hostname, e AS error FROM pf, (SELECT unnest(['Invalid expected schema type: bad type!', 'Invalid expected hreflang: e n']) AS e)
        UNION ALL SELECT 'https://' || upper(host) || '/x', 'image_max_bytes must be between 1024 and 104857600.' FROM pf WHERE k % 7 = 3""",
)
def validate_profiles(spark, sf_dir):
    return R.validate_profiles(profiles(spark, sf_dir))


@query(
    "upsert_profiles",
    f"""WITH {SEED_SQL}, {_PROFILES} SELECT host AS hostname, CASE WHEN k % 2 = 1 THEN 'New' ELSE 'Site ' || k END AS label FROM pf_all WHERE rn <= 200""",
)
def upsert_profiles(spark, sf_dir):
    current = profiles(spark, sf_dir)
    incoming = current.where(F.regexp_extract("label", r"(\d+)", 1).cast("int") % 2 == 1).withColumn("label", F.lit("New"))
    return R.upsert_profiles(current, incoming).select("hostname", "label")


@query("remove_profiles", f"WITH {SEED_SQL}, {_PROFILES} SELECT host AS hostname FROM pf WHERE k % 2 = 0")
def remove_profiles(spark, sf_dir):
    current = profiles(spark, sf_dir)
    gone = current.where(F.regexp_extract("label", r"(\d+)", 1).cast("int") % 2 == 1).select("hostname")
    return R.remove_profiles(current, gone).select("hostname")


def _hosted(df):
    return df.withColumn("host", F.regexp_extract("url", r"^https?://([^/]+)", 1))


@query(
    "resolve_rules",
    f"""WITH {SEED_SQL}, {_PROFILES} SELECT p AS page_id, (k IS NOT NULL) AS profiled,
        CASE WHEN k % 2 = 0 THEN 30 ELSE 15 END::INT AS title_min, CASE WHEN k % 3 = 0 THEN 80 ELSE 160 END::INT AS description_max,
        CASE WHEN k % 7 = 3 THEN 1024 ELSE 524288 END::INT AS image_max_bytes, NOT coalesce(k % 4 = 1, false) AS need_description,
        CASE WHEN k IS NULL THEN '' ELSE 'viewport.missing' END AS disabled
        FROM s LEFT JOIN (SELECT * FROM pf_all WHERE rn <= 200 AND k % 5 <> 4) pf_ ON pf_.host = s.host""",
)
def resolve_rules(spark, sf_dir):
    pages = _hosted(keys(spark, sf_dir))
    out = R.resolve_rules(pages, profiles(spark, sf_dir))
    t = F.col("rules.thresholds")
    return out.select(
        "page_id", F.col("profile").isNotNull().alias("profiled"), t["title_min"].alias("title_min"),
        t["description_max"].alias("description_max"), t["image_max_bytes"].alias("image_max_bytes"),
        F.col("rules.required.description").alias("need_description"), F.array_join("rules.disabled_checks", ",").alias("disabled"),
    )


@query(
    "apply_profile",
    f"""WITH {HREFLANG_SQL}, {_PROFILES}, pp AS (SELECT s.*, k IS NOT NULL AS on_ FROM s LEFT JOIN (SELECT * FROM pf_all WHERE rn <= 200 AND k % 5 <> 4) pf_ ON pf_.host = s.host)
        SELECT p AS page_id, id FROM (
          SELECT p, 'profile.schema.expected' AS id FROM pp WHERE on_ AND p % 4 <> 1
          UNION ALL SELECT p, 'profile.hreflang.expected' FROM pp WHERE on_ AND NOT (p IN (SELECT p FROM hl WHERE tag = 'en') AND p IN (SELECT p FROM hl WHERE lower(tag) = 'x-default')))""",
)
def apply_profile(spark, sf_dir):
    df = _hosted(page_facts(seeded_pages(spark, sf_dir), *I.FACTS_NEEDED))
    df = I.apply_profile(I.apply_rules(I.evaluate(R.resolve_rules(df, profiles(spark, sf_dir)))))
    return I.issue_rows(df).where("category = 'Domain profile'").select("page_id", "id")


# --- verdicts ---

_DIFF = "(canon_count = 1 AND canon_href <> '' AND canon_href <> u)"
VERDICT = f"""CASE WHEN status >= 400 THEN 'Error' WHEN p % 7 IN (0, 2) OR xrobots = 'noindex' THEN 'Noindex'
  WHEN hops > 0 THEN 'Redirected' WHEN {_DIFF} THEN 'Canonicalized' ELSE 'Indexable' END"""
_REASONS = f"""array_to_string(list_filter([
  CASE WHEN status >= 400 THEN 'http.error' END, CASE WHEN p % 7 IN (0, 2) THEN 'robots.meta.noindex' END,
  CASE WHEN xrobots = 'noindex' THEN 'robots.header.noindex' END,
  CASE WHEN p % 7 = 2 OR (p % 7 = 1 AND xrobots = 'noindex') THEN 'robots.conflict' END,
  CASE WHEN hops > 0 THEN 'redirect.detected' END, CASE WHEN hops > 0 AND (p % 17 NOT IN (0, 1)) THEN 'redirect.loop' END,
  CASE WHEN hops > 5 THEN 'redirect.excessive' END, CASE WHEN {_DIFF} THEN 'canonical.different' END,
  CASE WHEN canon_count > 1 THEN 'canonical.multiple' END], lambda x: x IS NOT NULL), ',')"""


@query(
    "indexability",
    f"""WITH {SEED_SQL} SELECT p AS page_id, {VERDICT} AS verdict, coalesce(nullif({_REASONS}, ''), 'indexable') AS reasons FROM s""",
)
def indexability(spark, sf_dir):
    df = page_facts(seeded_pages(spark, sf_dir), "canonical", "robots", fetch_log=fetch_log(spark, sf_dir))
    return N.indexability(df).select("page_id", "verdict", F.array_join("reasons", ",").alias("reasons"))


@query(
    "canonical_diagnostics",
    f"""WITH {SEED_SQL}, d AS (SELECT *, canon_href <> '' AS k, regexp_extract(canon_href, '^https?://([^/]+)', 1) AS ch, regexp_extract(canon_href, '^(https?)', 1) AS cs,
          regexp_extract(canon_href, '^https?://[^/]+([^?#]*)', 1) AS cp, regexp_extract(canon_href, '(\\?.*)$', 1) AS cq FROM s)
        SELECT p AS page_id, k AND ch <> host AS cross_domain, k AND cs <> scheme AS protocol_mismatch, k AND ch <> host AS hostname_mismatch,
          k AND rtrim(cp, '/') = rtrim(path, '/') AND cp <> path AS trailing_slash_mismatch, k AND cq <> query AS query_mismatch FROM d""",
)
def canonical_diagnostics(spark, sf_dir):
    df = page_facts(seeded_pages(spark, sf_dir), "canonical")
    return df.select("page_id", N.canonical_diagnostics(F.col("url"), F.col("canonical.href")).alias("d")).select("page_id", "d.*")


@query(
    "redirect_diagnostics",
    f"""WITH {SEED_SQL} SELECT p AS page_id, hops::INT AS hops, (hops > 0 AND p % 17 NOT IN (0, 1)) AS loop, hops > 5 AS excessive FROM s""",
)
def redirect_diagnostics(spark, sf_dir):
    return fetch_log(spark, sf_dir).select("page_id", N.redirect_diagnostics(F.col("redirect_chain")).alias("d")).select(
        "page_id", "d.*"
    )


@query(
    "response_meta",
    f"""WITH {SEED_SQL} SELECT u AS norm_url, status::INT AS status, hops > 0 AS redirected, CASE WHEN p % 29 = 7 THEN 'timeout' ELSE '' END AS error, xrobots AS x_robots,
        CASE p % 4 WHEN 0 THEN 'de, en' WHEN 1 THEN 'en-US;q=1' ELSE '' END AS content_language, CASE p % 7 WHEN 0 THEN 'DENY' WHEN 1 THEN 'ALLOWALL' ELSE '' END AS x_frame_options FROM s""",
)
def meta(spark, sf_dir):
    join = lambda c: F.array_join(c, "|").alias(c)
    return response_meta(fetch_log(spark, sf_dir)).select(
        "norm_url", "status", "redirected", "error", join("x_robots"), join("content_language"), join("x_frame_options")
    )


@query(
    "indexability_diff",
    f"""WITH {SEED_SQL}, v AS (SELECT p, {VERDICT.replace("WHEN status >= 400 THEN 'Error'", "").replace(" OR xrobots = 'noindex'", "").replace("WHEN hops > 0 THEN 'Redirected'", "")} AS verdict,
          CASE p % 7 WHEN 0 THEN 'noindex' WHEN 1 THEN 'index,nofollow' WHEN 2 THEN 'index,noindex' WHEN 3 THEN 'noarchive' ELSE '' END AS meta, canon_href FROM s)
        SELECT p AS page_id, 'Verdict' AS field, verdict AS rendered, 'Indexable' AS raw FROM v WHERE verdict <> 'Indexable'
        UNION ALL SELECT p, 'Meta directives', meta, '' FROM v WHERE meta <> ''
        UNION ALL SELECT p, 'Canonical', canon_href, '' FROM v WHERE canon_href <> ''""",
)
def indexability_diff(spark, sf_dir):
    rendered = N.indexability(X.extract_facts(seeded_pages(spark, sf_dir), "canonical", "robots"))
    raw = N.indexability(X.extract_facts(table(spark, sf_dir, "pages"), "canonical", "robots"))
    return N.indexability_diff(rendered, raw)


@query(
    "facts_diff",
    f"""WITH {SEED_SQL}, lc AS (SELECT s.p, len(regexp_extract_all(html, '<a href=')) AS raw_links,
           (t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT + (p % 8 = 1)::INT + (p % 8 = 2)::INT + (p % 9 = 2)::INT + (p % 9 = 3)::INT
           + CASE WHEN p % 4 = 2 THEN 12 ELSE 0 END + (p % 11 = 5)::INT + CASE WHEN p % 11 = 6 THEN 2 ELSE 0 END AS extra FROM s)
        SELECT p AS page_id, 'description' AS field, description AS rendered, '' AS raw FROM s WHERE description <> ''
        UNION ALL SELECT p, 'canonical', canon_href, '' FROM s WHERE canon_href <> ''
        UNION ALL SELECT p, 'H1 count', '2', '1' FROM s WHERE p % 13 = 0
        UNION ALL SELECT p, 'Heading count', (1 + n)::VARCHAR, '1' FROM (SELECT p, (p % 3 < 2)::INT + (p % 13 = 0)::INT + (p % 17 = 0)::INT AS n FROM s) WHERE n > 0
        UNION ALL SELECT p, 'Link count', (raw_links + extra)::VARCHAR, raw_links::VARCHAR FROM lc WHERE extra > 0
        UNION ALL SELECT p, 'Image count', (p % 3)::VARCHAR, '0' FROM s WHERE p % 3 > 0
        UNION ALL SELECT p, 'Schema types', t, '' FROM (SELECT p, CASE
             WHEN p % 4 = 1 THEN array_to_string(list_sort(list_filter([CASE WHEN p % 10 <> 9 THEN 'Brand' END, 'Product', CASE WHEN p % 12 = 5 THEN 'Offer' WHEN p % 12 = 9 THEN 'AggregateOffer' END,
               CASE WHEN p % 24 = 5 THEN 'AggregateRating' END, CASE WHEN p % 8 = 1 THEN 'BreadcrumbList' END], lambda x: x IS NOT NULL)), ',')
             WHEN p % 4 = 2 THEN 'ItemList,ListItem' WHEN p % 16 = 7 THEN 'CollectionPage,WebPage' WHEN p % 16 = 11 THEN 'Article,Person' WHEN p % 16 = 15 THEN 'SearchResultsPage' ELSE '' END AS t FROM s) WHERE t <> ''""",
)
def facts_diff(spark, sf_dir):
    fields = ("title", "description", "canonical", "headings", "links", "images", "jsonld")
    rendered = page_facts(seeded_pages(spark, sf_dir), *fields)
    raw = page_facts(table(spark, sf_dir, "pages"), *fields)
    return N.facts_diff(rendered, raw)


# --- page types ---

# Text of the seeded body fragments, in order.
_FRAGMENT = """(CASE WHEN t1 IS NULL THEN '' ELSE 'Read more' END || CASE WHEN t2 IS NULL THEN '' ELSE 'child ' || (p % 5) END || CASE p % 8 WHEN 1 THEN 'js' WHEN 2 THEN 'mail' ELSE '' END
  || CASE WHEN p % 4 = 2 THEN 'c1c2c3c4c5c6c7c8c9c10c11c12' ELSE '' END || CASE p % 3 WHEN 0 THEN 'Sub' WHEN 1 THEN 'Deep' ELSE '' END || CASE WHEN p % 13 = 0 THEN 'Second' ELSE '' END
  || CASE p % 5 WHEN 1 THEN 'one two three' WHEN 2 THEN 'four five' WHEN 3 THEN 'six' WHEN 4 THEN 's t u' ELSE '' END || CASE p % 11 WHEN 5 THEN 'item' WHEN 6 THEN 'onetwo' ELSE '' END)"""
_WORDS = "len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_extract(replace(html, '<footer>', " + _FRAGMENT + " || '<footer>'), '(?s)<body>(.*)$', 1), '<!--[^>]*-->', '', 'g'), '<[^>]*>', '', 'g'), '\\s+'), lambda x: x <> ''))"
TYPE_SQL = (
    SEED_SQL
    + f""",
us AS (SELECT s.*, path IN ('', '/') AS home_path, regexp_matches(lower(path), '(?:^|/)(?:search|search-results|results|find)(?:/|$)') AS search_path,
         query LIKE '%page=2%' AS paged_param, p % 11 IN (3, 4) AND (CASE WHEN p % 11 = 3 THEN nxt ELSE prv END) IS NOT NULL AS rel_paged, {_WORDS} AS words FROM s),
ts AS (SELECT *, CASE WHEN status >= 400 THEN 0 ELSE (p % 16 = 15)::INT * 8 + search_path::INT * 5 + (p % 12 = 0)::INT END AS s_search,
         CASE WHEN status >= 400 THEN 0 ELSE (p % 4 = 1)::INT * 7 + (p % 11 = 0)::INT * 5 + (p % 11 = 5)::INT * 4 END AS s_product,
         CASE WHEN status >= 400 THEN 0 ELSE (p % 16 = 11)::INT * 7 + (p % 11 = 1)::INT * 5 + (words >= 300)::INT * 4 END AS s_article,
         CASE WHEN status >= 400 THEN 0 ELSE (p % 16 = 7)::INT * 7 + (p % 4 = 2)::INT * 6 + (p % 11 = 6)::INT * 4 END AS s_category
       FROM us),
pt AS (SELECT *, CASE WHEN status >= 400 THEN 'error' WHEN (p % 16 = 15 OR search_path) AND s_search >= 4 THEN 'search'
         WHEN greatest(s_product, s_article, s_category) < 4 THEN 'generic' WHEN s_product >= greatest(s_article, s_category) THEN 'product'
         WHEN s_article >= s_category THEN 'article' ELSE 'category' END AS primary_,
         paged_param OR rel_paged AS paginated FROM ts),
ptp AS (SELECT *, CASE primary_ WHEN 'error' THEN 10 WHEN 'search' THEN s_search WHEN 'generic' THEN 1 ELSE greatest(s_product, s_article, s_category) END AS points FROM pt)"""
)
# Without a fetch log no page is an error page.
TYPE_RAW_SQL = TYPE_SQL.replace("status >= 400", "false")


def _typed(spark, sf_dir):
    return T.page_type(page_facts(seeded_pages(spark, sf_dir), *T.FACTS_NEEDED, fetch_log=fetch_log(spark, sf_dir)))


@query(
    "page_type",
    f"""WITH {TYPE_SQL} SELECT p AS page_id, primary_ AS primary_type, CASE WHEN points >= 7 THEN 'high' WHEN points >= 4 THEN 'medium' ELSE 'low' END AS confidence,
        points::INT AS points, false AS faceted, paginated FROM ptp""",
)
def page_type(spark, sf_dir):
    t = F.col("page_type")
    return _typed(spark, sf_dir).select(
        "page_id", t["primary"].alias("primary_type"), t["confidence"].alias("confidence"), t["score"].alias("points"),
        t["faceted"].alias("faceted"), t["pagination"].alias("paginated"),
    )


@query(
    "page_type_scores",
    f"WITH {TYPE_SQL} SELECT p AS page_id, s_search::INT AS search, s_product::INT AS product, s_article::INT AS article, s_category::INT AS category FROM ts",
)
def page_type_scores(spark, sf_dir):
    return _typed(spark, sf_dir).select("page_id", "page_type.search", "page_type.product", "page_type.article", "page_type.category")


@query(
    "page_type_evidence",
    f"""WITH {TYPE_SQL}, ev AS (
          SELECT p, 'error' AS type, 'http-status' AS signal, 10 AS weight FROM ptp WHERE status >= 400
          UNION ALL SELECT p, 'search', 'schema', 8 FROM ptp WHERE p % 16 = 15
          UNION ALL SELECT p, 'search', 'url-path', 5 FROM ptp WHERE search_path
          UNION ALL SELECT p, 'search', 'dom', 1 FROM ptp WHERE p % 12 = 0
          UNION ALL SELECT p, 'product', 'schema', 7 FROM ptp WHERE p % 4 = 1
          UNION ALL SELECT p, 'product', 'open-graph', 5 FROM ptp WHERE p % 11 = 0
          UNION ALL SELECT p, 'product', 'microdata', 4 FROM ptp WHERE p % 11 = 5
          UNION ALL SELECT p, 'category', 'schema', 7 FROM ptp WHERE p % 16 = 7
          UNION ALL SELECT p, 'category', 'schema', 6 FROM ptp WHERE p % 4 = 2
          UNION ALL SELECT p, 'category', 'microdata', 4 FROM ptp WHERE p % 11 = 6
          UNION ALL SELECT p, 'article', 'schema', 7 FROM ptp WHERE p % 16 = 11
          UNION ALL SELECT p, 'article', 'open-graph', 5 FROM ptp WHERE p % 11 = 1
          UNION ALL SELECT p, 'article', 'semantic-html', 4 FROM ptp WHERE words >= 300
          UNION ALL SELECT p, 'generic', 'fallback', 1 FROM ptp
          UNION ALL SELECT p, 'pagination', 'pagination', 4 FROM ptp WHERE paginated)
        SELECT p AS page_id, ev.type, signal, weight FROM ptp JOIN ev USING (p) WHERE ev.type IN (primary_, 'pagination')""",
)
def page_type_evidence(spark, sf_dir):
    return _typed(spark, sf_dir).select("page_id", F.explode("page_type.evidence").alias("e")).select("page_id", "e.type", "e.signal", "e.weight")


@query(
    "url_signals",
    """SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) IN ('', '/') AS homepage_path,
       regexp_matches(lower(url), '^https?://[^/]+.*/(search|search-results|results|find)(/|$|[?#])') AS search_path,
       CASE WHEN url LIKE '%?page=2%' THEN 'page' ELSE '' END AS pagination_params, '' AS filter_params FROM pages""",
)
def url_signals(spark, sf_dir):
    s = table(spark, sf_dir, "pages").select("page_id", T.url_signals(F.col("url")).alias("s"))
    return s.select(
        "page_id", "s.homepage_path", "s.search_path", F.array_join("s.pagination_params", ",").alias("pagination_params"),
        F.array_join("s.filter_params", ",").alias("filter_params"),
    )


# --- content ---


@query(
    "language_audit",
    f"""WITH {HREFLANG_SQL}, l AS (SELECT s.p, lower(lang) AS lang, CASE p % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en-us' ELSE '' END AS header,
          coalesce((SELECT string_agg(replace(lower(tag), '_', '-'), ',' ORDER BY idx) FROM hl WHERE hl.p = s.p AND hl.href = s.u AND lower(tag) <> 'x-default'), '') AS own,
          coalesce((SELECT bool_or(regexp_extract(replace(lower(tag), '_', '-'), '^([^-]*)', 1) = lower(lang)) FROM hl WHERE hl.p = s.p AND hl.href = s.u AND lower(tag) <> 'x-default'), false) AS fits FROM s)
        SELECT p AS page_id, lang AS html_lang, header AS header_lang, own AS self_hreflang,
          array_to_string(list_filter([CASE WHEN header <> '' AND left(header, 2) <> lang THEN 'content-language-mismatch' END,
            CASE WHEN own <> '' AND NOT fits THEN 'self-hreflang-mismatch' END], lambda x: x IS NOT NULL), ',') AS codes FROM l""",
)
def language_audit(spark, sf_dir):
    df = page_facts(seeded_pages(spark, sf_dir), "lang", "hreflang", fetch_log=fetch_log(spark, sf_dir))
    return C.language_audit(df).select(
        "page_id", "html_lang", "header_lang", F.array_join("self_hreflang", ",").alias("self_hreflang"),
        F.array_join("language_issues", ",").alias("codes"),
    )


@query(
    "heading_audit",
    f"""WITH {SEED_SQL} SELECT p AS page_id, (1 + (p % 3 < 2)::INT + (p % 13 = 0)::INT + (p % 17 = 0)::INT)::INT AS total, (1 + (p % 13 = 0)::INT)::INT AS h1,
        (p % 3 = 0)::INT AS h2, (p % 17 = 0)::INT AS h3, (p % 3 = 1)::INT AS h4, ((p % 17 = 0)::INT)::INT AS empty,
        CASE WHEN p % 3 = 1 THEN '1>4' ELSE '' END || CASE WHEN p % 3 = 1 AND p % 17 = 0 AND p % 13 = 0 THEN ',' ELSE '' END || CASE WHEN p % 17 = 0 AND (p % 13 = 0 OR p % 3 = 2) THEN '1>3' ELSE '' END AS jumps FROM s""",
)
def heading_audit(spark, sf_dir):
    h = C.heading_audit(X.extract_facts(seeded_pages(spark, sf_dir), "headings"))
    jumps = F.transform("jumps", lambda j: F.concat_ws(">", j["from"], j["to"]))
    return h.select("page_id", "total", "h1", "h2", "h3", "h4", "empty", F.array_join(jumps, ",").alias("jumps"))


@query(
    "thin_content",
    "SELECT doc_id, lang, n AS visible_words FROM (SELECT doc_id, lang, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[''’\\-][\\p{L}\\p{N}]+)*'))::INT AS n FROM documents) WHERE n < 150",
)
def thin_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return C.thin_content(docs, C.word_count(F.col("text"))).select("doc_id", "lang", "visible_words")


def _px(text: str, font: int) -> str:
    rest, units = f"length({text})", []
    for rx, weight in C.WEIGHTS:
        n = f"len(regexp_extract_all({text}, '{rx.replace(chr(39), chr(39) * 2)}'))"
        units.append(f"{n} * {weight}")
        rest += f" - {n}"
    return f"floor((({' + '.join(units)}) + ({rest}) * {C.DEFAULT_WEIGHT}) * {font} / 100.0 + 0.5)::INT"


def _serp_sql() -> str:
    parts = []
    for d, tmax, line, lines, tf, df in C.DEVICES:
        parts.append(
            f"""SELECT p AS page_id, '{d}' AS device, tp AS title_px, greatest(tp - {tmax}, 0)::INT AS title_overflow_px, tp > {tmax} AS title_truncated, dp AS description_px,
            CASE WHEN description = '' THEN 0 ELSE greatest(1, ceil(dp / {line}.0)) END::INT AS description_lines, greatest(dp - {line * lines}, 0)::INT AS description_overflow_px,
            dp > {line * lines} AS description_truncated, description = '' AS description_missing,
            replace(host || rtrim(replace(path, '/', ' › '), '› '), '  ', ' ') AS breadcrumb
            FROM (SELECT *, {_px("trim(title)", tf)} AS tp, {_px("description", df)} AS dp FROM s)"""
        )
    return f"WITH {SEED_SQL} " + " UNION ALL ".join(parts)


@query("serp", _serp_sql())
def serp(spark, sf_dir):
    return C.serp(X.extract_facts(seeded_pages(spark, sf_dir), "title", "description")).drop("title_missing")


@query(
    "word_deltas",
    f"""WITH {SEED_SQL} SELECT p AS page_id, ((CASE WHEN t1 IS NULL THEN 0 ELSE 2 END + CASE WHEN t2 IS NULL THEN 0 ELSE 2 END + (p % 8 = 1)::INT + (p % 8 = 2)::INT
           + CASE WHEN p % 4 = 2 THEN 12 ELSE 0 END + (p % 3 < 2)::INT + (p % 13 = 0)::INT + (p % 11 = 5)::INT + CASE WHEN p % 11 = 6 THEN 2 ELSE 0 END) + [0, 3, 2, 1, 3][(p % 5 + 1)::INT])::INT AS rendered_delta,
        [0, 3, 2, 1, 3][(p % 5 + 1)::INT]::INT AS hidden_delta FROM s""",
)
def word_deltas(spark, sf_dir):
    raw = X.extract_facts(table(spark, sf_dir, "pages"), "text")
    rendered = X.extract_facts(seeded_pages(spark, sf_dir), "text")
    return C.word_deltas(raw, rendered).select("page_id", "rendered_delta", "hidden_delta")
