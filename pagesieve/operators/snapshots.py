"""Snapshot tables: making, cleaning, appending with retention, merging, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import clean, str_array
from .schema import schema_types

KEEP = 50
MAX_NAME = 120


def sorted_unique(values: Column) -> Column:
    trimmed = F.transform(values, lambda v: F.trim(F.coalesce(v, F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda v: v != "")))


def make_snapshots(reports: DataFrame) -> DataFrame:
    """``url, snapshot`` from page reports.

    Optional columns add the parts measured elsewhere: ``link_counts`` (checked, broken,
    redirect), ``image_counts`` (checked, broken), ``performance`` (requests, total_bytes,
    known_sizes, third_party_count, third_party_bytes, ttfb, load), ``mixed`` (active,
    passive) and ``headers``. What was not measured stays 0 and is never compared.
    """
    have = set(reports.columns)
    c = F.col

    def part(column: str, field: str, kind: str = "bigint") -> Column:
        return F.coalesce(c(column)[field].cast(kind), F.lit(0).cast(kind)) if column in have else F.lit(0).cast(kind)

    def values(column: str) -> Column:
        return sorted_unique(c(column)) if column in have else str_array([])

    level = lambda n: F.filter("headings", lambda h: h["level"] == n)
    http = lambda l: F.lower(l["raw_href"]).rlike(r"^(?:https?://|/|\./|\.\./|\?)")
    internal = F.size(F.filter("links", lambda l: http(l) & _internal(l["raw_href"])))
    headers = (
        F.map_from_entries(
            F.transform("headers", lambda h: F.struct(h["key"], F.struct(h["state"].alias("state"), h["value"].alias("value"))))
        )
        if "headers" in have
        else F.create_map().cast("map<string,struct<state:string,value:string>>")
    )
    fields = {
        "title": c("title"),
        "description": c("description"),
        "canonical": c("canonical.href"),
        "robots": sorted_unique(F.transform("robots", lambda r: r["content"])),
        "h1": F.transform(level(1), lambda h: h["text"]),
        "outline": F.transform("headings", lambda h: F.concat_ws(":", h["level"].cast("string"), h["text"])),
        "heading_count": F.size("headings"),
        "links_total": F.size("links"),
        "links_internal": internal,
        "links_checked": part("link_counts", "checked"),
        "links_broken": part("link_counts", "broken"),
        "links_redirect": part("link_counts", "redirect"),
        "images_total": F.size("images"),
        "images_missing_alt": F.size(F.filter("images", lambda i: ~i["alt_present"])),
        "images_missing_dimensions": F.size(F.filter("images", lambda i: (i["width_attr"] == "") | (i["height_attr"] == ""))),
        "images_oversized": part("image_counts", "oversized"),
        "images_checked": part("image_counts", "checked"),
        "images_broken": part("image_counts", "broken"),
        "schema_types": schema_types(c("schemas")),
        "schema_invalid": F.size(F.filter("schemas", lambda s: ~s["valid"])),
        "hreflang": F.array_sort(
            F.transform("hreflang", lambda h: F.concat_ws("|", F.lower(h["lang"]), h["ref"]))
        ),
        "hreflang_count": F.size("hreflang"),
        "status": c("status") if "status" in have else F.lit(None).cast("int"),
        "x_robots": values("x_robots"),
        "content_type": values("content_type"),
        "content_language": values("content_language"),
        "cache_control": values("cache_control"),
        "request_count": part("performance", "requests"),
        "total_bytes": part("performance", "total_bytes"),
        "known_sizes": part("performance", "known_sizes"),
        "third_party_requests": part("performance", "third_party_count"),
        "third_party_bytes": part("performance", "third_party_bytes"),
        "dom_nodes": c("dom.nodes").cast("bigint"),
        "dom_depth": c("dom.max_depth").cast("bigint"),
        "ttfb": part("performance", "ttfb", "double"),
        "load": part("performance", "load", "double"),
        "https": c("norm_url").startswith("https:"),
        "mixed_active": part("mixed", "active"),
        "mixed_passive": part("mixed", "passive"),
        "headers": headers,
        "score": c("score"),
        "issue_ids": sorted_unique(F.transform("issues", lambda i: i["id"])),
        "verdict": c("verdict"),
        "indexable": c("indexable"),
        "reasons": sorted_unique(c("reasons")),
    }
    return reports.select("page_id", c("norm_url").alias("url"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias("snapshot"))


def _internal(raw: Column) -> Column:
    origin = U.origin_of(F.col("base"))
    return ~raw.rlike(r"^(?i)(?:https?:)?//") | F.startswith(F.lower(raw), F.concat(origin, F.lit("/")))


def sanitize_snapshots(raw: DataFrame) -> DataFrame:
    """Usable history rows: http(s) URL, snapshot present, default names, valid dates, first id wins.

    ``raw``: ``url, position, id, name, created_at (string), saved_at (string), snapshot``.
    """
    c = F.col
    stamp = lambda v: F.try_to_timestamp(v)
    rows = raw.where("snapshot IS NOT NULL").withColumn("url", U.http_url(c("url"))).where("url <> ''")
    created = F.coalesce(stamp(c("created_at")), stamp(c("saved_at")))
    rows = rows.withColumn("created_at", created).where("created_at IS NOT NULL")
    fallback = F.concat(F.lit("import-"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-"), c("position").cast("string"))
    name = clean(c("name"), MAX_NAME)
    rows = rows.withColumns(
        {
            "id": F.coalesce(F.nullif(F.trim(F.coalesce("id", F.lit(""))), F.lit("")), fallback),
            "name": F.when(name == "", "Snapshot").otherwise(name),
        }
    )
    first = rows.groupBy("url", "id").agg(F.min_by(F.struct("name", "created_at", "snapshot"), "position").alias("f"))
    return first.select("url", "id", "f.*")


def newest(history: DataFrame, keep: int = KEEP) -> DataFrame:
    """The newest ``keep`` snapshots per URL.

    Row-number limits are applied before the shuffle as well, so a URL that holds a
    third of all rows sends at most ``keep`` rows per task.
    """
    w = Window.partitionBy("url").orderBy(F.desc("created_at"), "id")
    return history.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= keep).drop("rn_")


def append_snapshots(history: DataFrame, new: DataFrame, keep: int = KEEP) -> DataFrame:
    """Add snapshots; the same id replaces the old row; retention applies."""
    rest = history.join(new.select("url", "id"), ["url", "id"], "left_anti")
    return newest(rest.unionByName(new), keep)


def merge_snapshots(current: DataFrame, incoming: DataFrame, keep: int = KEEP) -> DataFrame:
    """Union by id where the current row wins; retention applies."""
    fresh = incoming.join(current.select("url", "id"), ["url", "id"], "left_anti")
    return newest(current.unionByName(fresh), keep)


def delete_snapshots(history: DataFrame, gone: DataFrame) -> DataFrame:
    return history.join(gone.select("url", "id"), ["url", "id"], "left_anti")


def import_legacy(history: DataFrame, legacy: DataFrame, keep: int = KEEP) -> DataFrame:
    """Old single snapshots join the history unless the page already has the same content."""
    digest = lambda df: df.withColumn("digest", F.sha2(F.to_json(F.struct("snapshot")), 256))
    fresh = digest(legacy).join(digest(history).select("url", "digest"), ["url", "digest"], "left_anti")
    one = fresh.groupBy("url", "digest").agg(F.min_by(F.struct("id", "created_at", "snapshot"), "id").alias("f"))
    rows = one.select("url", "f.id", F.lit("Legacy snapshot").alias("name"), "f.created_at", "f.snapshot")
    return append_snapshots(history, rows, keep)


def set_baselines(history: DataFrame, baselines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``url, baseline_id``: a valid wish replaces the old baseline, an invalid one keeps it,
    an empty one clears it; baselines whose snapshot is gone are dropped."""
    ids = history.select("url", F.col("id").alias("known"))
    wish = wanted.select("url", F.col("baseline_id").alias("wish"))
    both = baselines.join(wish, "url", "full")
    valid = both.join(ids.withColumnRenamed("known", "wish").withColumn("ok", F.lit(True)), ["url", "wish"], "left")
    chosen = F.when(F.col("wish") == "", F.lit(None)).when(F.col("ok"), F.col("wish")).otherwise(F.col("baseline_id"))
    return valid.select("url", chosen.alias("baseline_id")).where("baseline_id IS NOT NULL").join(
        ids.withColumnRenamed("known", "baseline_id"), ["url", "baseline_id"], "left_semi"
    )


def baseline_for(history: DataFrame, baselines: DataFrame) -> DataFrame:
    return history.join(baselines.withColumnRenamed("baseline_id", "id"), ["url", "id"], "left_semi")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Twelve-field difference of two versions: ``url, field, before, after``."""
    fields = {
        "title": "snapshot.title", "description": "snapshot.description", "canonical": "snapshot.canonical",
        "robots": "array_join(snapshot.robots, ',')", "h1": "array_join(snapshot.h1, '|')", "headingCount": "snapshot.heading_count",
        "linkCount": "snapshot.links_total", "imageCount": "snapshot.images_total",
        "schemaTypes": "array_join(snapshot.schema_types, ',')", "hreflangCount": "size(snapshot.hreflang)", "score": "snapshot.score",
        "issueIds": "array_join(snapshot.issue_ids, ',')",
    }
    cells = lambda: F.array(*[F.struct(F.lit(k).alias("field"), F.expr(e).cast("string").alias("v")) for k, e in fields.items()])
    a = before.select("url", cells().alias("a"))
    b = after.select("url", cells().alias("b"))
    rows = a.join(b, "url").select("url", F.explode(F.arrays_zip("a", "b")).alias("z"))
    return rows.select("url", "z.a.field", F.col("z.a.v").alias("before"), F.col("z.b.v").alias("after")).where(
        "NOT (before <=> after)"
    )
