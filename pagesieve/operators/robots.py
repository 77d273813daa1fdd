"""robots.txt: parsing with windows, group choice, rule evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import per_session, settled


def robots_lines(docs: DataFrame) -> DataFrame:
    """``host, line, field, value`` of every non-empty line; ``field`` is NULL without a colon."""
    text = F.regexp_replace(F.col("text"), "^\\ufeff", "")
    rows = docs.select("host", F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace(F.regexp_replace("raw", "\r$", ""), r"(^|[^%])#.*", "$1"))
    rows = rows.select("host", (F.col("pos") + 1).alias("line"), line.alias("content")).where("content <> ''")
    colon = F.instr("content", ":")
    return rows.select(
        "host",
        "line",
        F.when(colon > 1, F.lower(F.trim(F.substring_index("content", ":", 1)))).alias("field"),
        F.when(colon > 1, F.trim(F.regexp_replace("content", "^[^:]*:", ""))).alias("value"),
    )


def _grouped(docs: DataFrame) -> DataFrame:
    """Lines with the running number of the user-agent group they belong to.

    A group starts at a user-agent line that follows a rule (or nothing). One
    document per host bounds each window by the size of one robots.txt.
    """
    by_line = Window.partitionBy("host").orderBy("line")
    relevant = robots_lines(docs).where("(field = 'user-agent' AND value <> '') OR field IN ('allow', 'disallow')")
    is_agent = F.col("field") == "user-agent"
    previous = F.lag("field").over(by_line)
    starts = (is_agent & (previous.isNull() | (previous != "user-agent"))).cast("int")
    flagged = relevant.withColumn("seen_agent", F.max(is_agent.cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    # Rules before any group are reported elsewhere and must not end a group.
    flagged = flagged.where("seen_agent = 1").withColumn("starts", starts)
    running = F.sum("starts").over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("group_id", running.cast("int"))


def robots_rules(docs: DataFrame) -> DataFrame:
    """``host, group_id, type, path, line``."""
    rows = _grouped(docs).where("field IN ('allow', 'disallow')")
    return rows.select("host", "group_id", F.col("field").alias("type"), F.col("value").alias("path"), "line")


def robots_agents(docs: DataFrame) -> DataFrame:
    """``host, group_id, agent``."""
    rows = _grouped(docs).where("field = 'user-agent'")
    return rows.select("host", "group_id", F.lower("value").alias("agent"), "line")


def robots_warnings(docs: DataFrame) -> DataFrame:
    by_line = Window.partitionBy("host").orderBy("line")
    seen = F.max((F.coalesce(F.col("field") == "user-agent", F.lit(False)) & (F.col("value") != "")).cast("int")).over(
        by_line.rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = robots_lines(docs).withColumn("seen", seen)
    message = (
        F.when(F.col("field").isNull(), "Directive is missing a colon.")
        .when((F.col("field") == "sitemap") & (F.col("value") == ""), "Empty Sitemap directive.")
        .when((F.col("field") == "user-agent") & (F.col("value") == ""), "Empty User-agent directive.")
        .when(
            F.col("field").isin("allow", "disallow") & (F.coalesce("seen", F.lit(0)) == 0),
            F.concat(F.col("field"), F.lit(" appears before a User-agent group.")),
        )
    )
    return rows.select("host", "line", message.alias("message")).where("message IS NOT NULL")


def robots_sitemaps(docs: DataFrame) -> DataFrame:
    """Sitemap URLs declared in robots.txt, resolved against it, once per host."""
    lines = robots_lines(docs).where("field = 'sitemap' AND value <> ''")
    rows = lines.join(docs.select("host", "robots_url"), "host")
    url = U.absolute_url(F.col("value"), U.split_url(F.col("robots_url")))
    return (
        settled(rows, {"sitemap": url})
        .where(F.col("sitemap").rlike("^https?://"))
        .groupBy("host", "sitemap")
        .agg(F.min("line").alias("line"))
    )


def agent_weight(agent: Column, crawler: str) -> Column:
    """Length of the agent token if the crawler name contains it, 0 for '*', else -1."""
    a = F.lower(F.trim(agent))
    return (
        F.when(a == "", -1).when(a == "*", 0).when(F.contains(F.lit(crawler.lower().strip()), a), F.length(a)).otherwise(-1)
    )


def robots_groups(agents: DataFrame, crawler: str = "Googlebot") -> DataFrame:
    """Groups that apply to a crawler: the most specific agent token wins, ties are combined."""
    groups = agents.groupBy("host", "group_id").agg(F.max(agent_weight(F.col("agent"), crawler)).alias("weight"))
    best = F.max("weight").over(Window.partitionBy("host"))
    return groups.where("weight >= 0").withColumn("best", best).where("weight = best").select("host", "group_id", "weight")


def robots_path(u: Column) -> Column:
    parts = U.split_url(u)
    return F.coalesce(F.concat(parts["path"], F.when(parts["query"] == "?", F.lit("")).otherwise(parts["query"])), u)


def rule_regex(path: Column) -> Column:
    """Regular expression of a rule path: '*' matches anything, a final '$' anchors.

    Each part between stars is matched at its first place and kept there (an atomic group),
    so a rule with many stars needs no backtracking over them.
    """
    anchored = path.endswith("$")
    body = F.when(anchored, F.left(path, F.length(path) - 1)).otherwise(path)
    escaped = F.split(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*")
    first = F.get(escaped, F.lit(0))
    rest = F.filter(F.slice(escaped, F.lit(2), F.greatest(F.size(escaped), F.lit(1))), lambda x: x != "")
    middle = F.when(anchored, F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    held = F.array_join(F.transform(middle, lambda x: F.concat(F.lit("(?>.*?"), x, F.lit(")"))), "")
    open_end = F.get(F.reverse(escaped), F.lit(0)) == ""
    # Anchored: the last part ends the path, unless a star stands before the '$'.
    last = F.when(F.size(escaped) == 1, F.lit("$")).when(open_end, F.coalesce(F.concat(F.lit("(?>.*?"), F.get(F.reverse(rest), F.lit(0)), F.lit(")")), F.lit(""))).otherwise(
        F.concat(F.lit(".*"), F.get(F.reverse(rest), F.lit(0)), F.lit("$")))
    return F.concat(F.lit("(?s)^"), first, held, F.when(anchored, last).otherwise(F.lit("")))


def rule_start(path: Column) -> Column:
    """What every path under the rule begins with: the text before its first '*' or final '$'."""
    return F.regexp_extract(path, r"^([^*]*?)(?:\*.*|\$)?$", 1)


def rule_weight(path: Column) -> Column:
    return F.length(F.regexp_replace(F.replace(path, F.lit("*"), F.lit("")), r"\$$", ""))


@per_session
def _page_keys() -> dict[str, Column]:
    return {"host": U.url_host(F.col("url")), "path": robots_path(F.col("url"))}


def compiled_rules(docs: DataFrame, crawler: str = "Googlebot") -> DataFrame:
    """One row per host: its applicable rules as an array, best first.

    The array is bounded by one robots.txt document, so joining pages to it by host
    needs no pair of (page, rule) rows and no skewed rule side.
    """
    rules = robots_rules(docs).join(robots_groups(robots_agents(docs), crawler), ["host", "group_id"])
    rules = rules.where("path <> ''")
    entry = F.struct(
        (-rule_weight(F.col("path"))).alias("w"),
        (F.col("type") != "allow").cast("int").alias("t"),
        F.col("line"),
        F.col("type"),
        F.col("path"),
        rule_start(F.col("path")).alias("start"),
        F.when(F.col("path").rlike(r"\*|\$$"), rule_regex(F.col("path"))).alias("rx"),
    )
    return rules.groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("rules"))


def robots_eval(pages: DataFrame, docs: DataFrame, crawler: str = "Googlebot") -> DataFrame:
    """``page_id, url, host, path, allowed, rule_type, rule, rule_line`` for every page."""
    return _evaluated(pages, compiled_rules(docs, crawler))


def _evaluated(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages joined once with one row a host (``host, rules`` and what else it has)."""
    kept = [c for c in hosts.columns if c not in ("host", "rules")]
    rows = settled(pages.select("page_id", "url"), _page_keys()).join(hosts, "host", "left")
    rows = settled(rows.withColumnRenamed("path", "page_path").withColumnRenamed("rules", "rules_"), {"hit": _first_match()})
    return rows.select(
        "page_id",
        "url",
        "host",
        F.col("page_path").alias("path"),
        F.coalesce(F.col("hit.type") == "allow", F.lit(True)).alias("allowed"),
        F.coalesce("hit.type", F.lit("")).alias("rule_type"),
        F.coalesce("hit.path", F.lit("")).alias("rule"),
        F.col("hit.line").alias("rule_line"),
        *kept,
    )


_HIT = "struct<type:string,path:string,line:int>"


def _first_match() -> Column:
    """First rule that matches, in order; later ones are not tried, nor is a pattern whose start differs."""
    path = F.col("page_path")
    fits = lambda r: F.startswith(path, r["start"]) & (r["rx"].isNull() | F.regexp_like(path, r["rx"]))
    this = lambda r: F.struct(r["type"].alias("type"), r["path"].alias("path"), r["line"].cast("int").alias("line"))
    return F.aggregate("rules_", F.lit(None).cast(_HIT), lambda acc, r: F.when(acc.isNotNull(), acc).when(fits(r), this(r)))


def robots_status(pages: DataFrame, docs: DataFrame, crawler: str = "Googlebot") -> DataFrame:
    """blocked, allowed or unknown per page.

    A missing robots.txt (404, 410) allows everything; any other failure is unknown.
    ``docs`` needs ``host, status, text``.
    """
    compiled = compiled_rules(docs.where("status BETWEEN 200 AND 299"), crawler)
    rows = _evaluated(pages, docs.select("host", F.col("status").alias("robots_status")).join(compiled, "host", "left"))
    state = (
        F.when(F.col("robots_status").isNull() | F.col("robots_status").isin(404, 410), "allowed")
        .when(~F.col("robots_status").between(200, 299), "unknown")
        .when(F.col("allowed"), "allowed")
        .otherwise("blocked")
    )
    return rows.withColumn("state", state)


def sitemap_seeds(hosts: DataFrame, docs: DataFrame) -> DataFrame:
    """Sitemaps to read per host: those declared, else ``/sitemap.xml``."""
    declared = robots_sitemaps(docs).select("host", "sitemap")
    rows = hosts.join(declared, "host", "left")
    return rows.select(
        "host", F.coalesce("sitemap", F.concat("origin", F.lit("/sitemap.xml"))).alias("sitemap"),
        F.col("sitemap").isNotNull().alias("declared"),
    )
