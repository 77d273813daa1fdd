"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.rules import CONFIG_SCHEMA, normalize_rules

HTML_TYPE = r"(?i)^\s*(?:text/html|application/xhtml\+xml)\b"
# Export columns: field and heading (fixed values).
CRAWL_COLUMNS = [
    ("depth", "Depth"), ("requested_url", "Requested URL"), ("url", "Final URL"), ("status", "Status"), ("redirected", "Redirected"),
    ("page_type", "Page type"), ("page_type_confidence", "Page type confidence"), ("page_traits", "Page traits"), ("title", "Title"),
    ("description", "Description"), ("h1", "H1"), ("canonical", "Canonical"), ("robots", "Robots"), ("indexability", "Indexability"),
    ("score", "Score"), ("critical", "Critical"), ("warnings", "Warnings"), ("issue_count", "Issues"), ("link_count", "Links"),
    ("duplicate_title", "Duplicate title"), ("duplicate_description", "Duplicate description"), ("duplicate_h1", "Duplicate H1"),
    ("source_url", "Discovered from"), ("error", "Error"),
]
AUDIT_COLUMNS = [
    ("url", "URL"), ("status", "Status"), ("page_type", "Page type"), ("page_type_confidence", "Page type confidence"),
    ("page_traits", "Page traits"), ("title", "Title"), ("description", "Description"), ("h1", "H1"), ("h1_count", "H1 count"),
    ("canonical", "Canonical"), ("robots", "Robots"), ("indexability", "Indexability"), ("score", "Score"), ("critical", "Critical"),
    ("warnings", "Warnings"), ("issue_count", "Issues"), ("duplicate_title", "Duplicate title"),
    ("duplicate_description", "Duplicate description"), ("duplicate_h1", "Duplicate H1"), ("available", "Available"), ("error", "Error"),
]
# Exported history: field names as in the file (fixed values), older spellings beside them.
_SNAP = "struct<id:string,name:string,createdAt:string,created_at:string,savedAt:string,snapshot:string>"
_PAGES = f"map<string,struct<baselineId:string,baseline_id:string,snapshots:array<{_SNAP}>>>"
SNAPSHOT_FILE = f"history struct<version:int,pages:{_PAGES}>, version int, pages {_PAGES}"


def usable_pages(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Pages with an HTML-like content type (if known) and, where a limit is set, at most ``max_bytes`` of source."""
    rows = pages if max_bytes is None else pages.where(F.octet_length("html") <= max_bytes)
    if "content_type" in pages.columns:
        kind = F.coalesce("content_type", F.lit(""))
        rows = rows.where((kind == "") | kind.rlike(HTML_TYPE))
    return rows


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows to ``spark.pagesieve.readPartitions`` tasks, where that is set.

    For a corpus in a file or two, whose parsing one task would do alone. Leave it unset for
    a corpus in many files: they are read as they lie, without a shuffle.
    """
    n = df.sparkSession.conf.get("spark.pagesieve.readPartitions", None)
    return df.repartition(int(n)) if n else df


def read_pages(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    return spread(usable_pages(spark.read.parquet(path), max_bytes))


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """robots.txt files, one per host: the file name without ending is the host."""
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    host = F.url_decode(F.regexp_extract("file", r"([^/]+?)(?:\.txt)?$", 1))
    return docs.select(
        host.alias("host"), F.concat(F.lit("https://"), host, F.lit("/robots.txt")).alias("robots_url"), F.lit(200).alias("status"),
        F.col("value").alias("text"),
    )


def read_sitemaps(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """Sitemap files (.xml or .xml.gz, whole text): ``sitemap_url, text``."""
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    name = F.url_decode(F.regexp_extract("file", r"([^/]+)$", 1))
    return docs.select(F.concat(F.lit(base), name).alias("sitemap_url"), F.col("value").alias("text"))


def read_snapshots(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rows of exported history files: with an envelope or bare; others are dropped.

    One document a file, or with ``lines`` one document a line, as :func:`write_snapshots`
    writes them.
    """
    files = spark.read.schema(SNAPSHOT_FILE).json(path, multiLine=not lines)
    pages = files.select(F.explode(F.coalesce("history.pages", "pages")).alias("url", "page"))
    rows = pages.select("url", F.coalesce("page.baselineId", "page.baseline_id").alias("baseline_id"), F.posexplode("page.snapshots").alias("position", "s"))
    return rows.select(
        "url", "baseline_id", "position", "s.id", "s.name", F.coalesce("s.createdAt", "s.created_at").alias("created_at"), F.col("s.savedAt").alias("saved_at"), "s.snapshot"
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Normalised rule configuration from JSON: one row with a ``rules`` struct."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", CONFIG_SCHEMA).alias("c"))
    return raw.select(normalize_rules(F.col("c")).alias("rules"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    schema = f"hostname string, label string, enabled boolean, rules {CONFIG_SCHEMA}, schema_types array<string>, hreflang array<string>, ignore_checks array<string>"
    return spark.read.schema(schema).json(path)


def _flat(rows: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    have = set(rows.columns)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    return rows.select(*[value(c).alias(label) for c, label in columns])


def _write_csv(rows: DataFrame, columns: list[tuple[str, str]], path: str) -> None:
    _flat(rows, columns).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', lineSep="\r\n", emptyValue="")


def write_crawl_csv(rows: DataFrame, path: str) -> None:
    _write_csv(rows, CRAWL_COLUMNS, path)


def write_audit_csv(rows: DataFrame, path: str) -> None:
    _write_csv(rows, AUDIT_COLUMNS, path)


def write_audit_json(rows: DataFrame, groups: DataFrame, path: str) -> None:
    """Rows and duplicate groups as JSON lines in two folders."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    groups.write.mode("overwrite").json(f"{path}/duplicates")


def write_reports(reports: DataFrame, path: str, format: str = "parquet") -> None:
    reports.write.mode("overwrite").format(format).save(path)


def write_snapshots(history: DataFrame, path: str, baselines: DataFrame | None = None) -> None:
    """History as JSON lines that :func:`read_snapshots` reads: one envelope a URL, newest snapshot first.

    A URL has as many snapshots as retention left it, so a line is bounded. ``snapshot`` may
    be a struct or JSON text.
    """
    text = dict(history.dtypes)["snapshot"] == "string"
    body = F.try_parse_json("snapshot") if text else F.to_variant_object("snapshot")
    item = F.struct(
        F.col("created_at").alias("at"), F.struct("id", "name", F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("createdAt"), F.to_json(body).alias("snapshot")).alias("s"),
    )
    pages = history.groupBy("url").agg(F.reverse(F.array_sort(F.collect_list(item))).alias("items"))
    if baselines is not None:
        pages = pages.join(baselines.select("url", "baseline_id"), "url", "left")
    else:
        pages = pages.withColumn("baseline_id", F.lit(None).cast("string"))
    one = lambda i: F.to_json(F.struct(i["s"]["id"].alias("id"), i["s"]["name"].alias("name"), i["s"]["createdAt"].alias("createdAt")))
    # The snapshot's own JSON goes in as it is, not as quoted text.
    entry = lambda i: F.concat(F.regexp_replace(one(i), r"\}$", ""), F.lit(',"snapshot":'), F.coalesce(i["s"]["snapshot"], F.lit("null")), F.lit("}"))
    quoted = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.substring(quoted(c), F.lit(2), F.length(quoted(c)) - 2)
    line = F.concat(
        F.lit('{"version":2,"history":{"version":2,"pages":{'), inner(F.col("url")), F.lit(':{"baselineId":'), F.coalesce(inner(F.col("baseline_id")), F.lit("null")),
        F.lit(',"snapshots":['), F.array_join(F.transform("items", entry), ","), F.lit("]}}}}"),
    )
    pages.select(line.alias("value")).write.mode("overwrite").text(path)


def issue_text(issues: DataFrame) -> Column:
    return F.format_string("[%s] %s: %s", F.upper("severity"), F.col("title"), F.col("message"))


def write_issue_text(issues: DataFrame, path: str) -> None:
    issues.select(issue_text(issues).alias("value")).write.mode("overwrite").text(path)
