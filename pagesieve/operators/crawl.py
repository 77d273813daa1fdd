"""Bounded breadth-first crawl over a stored link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import bucketed, stored

MAX_DEPTH = 3
MAX_URLS = 250


def clamp_int(value: Column, default: int, low: int, high: int) -> Column:
    """Half-up rounded number within bounds, ``default`` when it is no number."""
    number = value.try_cast("double")
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(number + 0.5)))
    return F.when(number.isNull() | F.isnan(number), F.lit(default)).otherwise(bounded).cast("int")


def crawl_options(url_limit=None, depth_limit=None, same_host: bool = True) -> dict:
    """Options with defaults; without a limit everything reachable is crawled."""
    return {
        "url_limit": None if url_limit is None else max(1, round(url_limit)),
        "depth_limit": None if depth_limit is None else max(0, round(depth_limit)),
        "same_host": same_host,
    }


def discover_links(links: DataFrame, seed: str | None = None, same_host: bool = True) -> DataFrame:
    """Distinct http targets per page, in order; optionally only those on the seed's host."""
    rows = links.where("kind = 'http' AND norm <> ''")
    if same_host and seed is not None:
        rows = rows.where(F.col("host") == U.url_host(F.lit(seed)))
    return rows.groupBy("page_id", F.col("norm").alias("url")).agg(F.min("idx").alias("idx"))


def next_frontier(candidates: DataFrame, seen: DataFrame, remaining: int | None, known: DataFrame | None = None) -> DataFrame:
    """Unseen candidates in discovery order, at most ``remaining`` of them.

    ``candidates``: ``url, source, rank, idx``. The first discovery of a URL is its
    minimum (rank, idx); the budget is a top-n over one small row per URL.
    """
    first = candidates.groupBy("url").agg(F.min_by(F.struct("source", "rank", "idx"), F.struct("rank", "idx")).alias("f"))
    fresh = first.join(seen.select("url"), "url", "left_anti")
    if known is not None:
        fresh = fresh.join(known.select("url"), "url", "left_semi")
    fresh = fresh.select("url", "f.*")
    return fresh if remaining is None else fresh.orderBy("rank", "idx").limit(remaining)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank``, a number that rises in the given order (with gaps); what it replaces may be part of the order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id())


def crawl(
    edges: DataFrame, seeds: DataFrame, depth_limit: int | None = None, url_limit: int | None = None, known: DataFrame | None = None
) -> DataFrame:
    """``url, source, depth, rank, capped`` of every URL reached from ``seeds`` (``url``).

    ``edges``: ``source, url, idx``, distinct. One round per level, until nothing new is
    found or a limit is reached; ``capped`` marks URLs with a link that a limit left out.
    ``rank`` is a number in order of discovery: of the source, then of the link. ``known``
    limits expansion to URLs that have a page.

    Edges, known and visited URLs are bucketed tables on shared storage, dealt by the key
    they are joined on. After the first writing, no level moves them again: a level sends
    the links it has found to the visited URLs, and nothing else is shuffled.
    """
    edges, _ = bucketed(edges.select("source", "url", "idx"), "edges", "source")
    if known is not None:
        known, _ = bucketed(known.select("url").distinct(), "known", "url")
    level = seeds.select("url").distinct().select("url", F.lit("").alias("source"), F.lit(0).alias("depth"))
    if url_limit is not None:
        used = min(level.count(), url_limit)
        level = level.orderBy("url").limit(url_limit)
    seen, name = bucketed(_numbered(level, "url"), "crawl", "url")
    depth = 0
    while depth_limit is None or depth < depth_limit:
        remaining = None if url_limit is None else url_limit - used
        if remaining == 0:
            break
        now = seen.where(F.col("depth") == depth).select(F.col("url").alias("source"), "rank")
        found = now.join(edges, "source").select("url", "source", "rank", "idx")
        fresh = stored(_numbered(next_frontier(found, seen, remaining, known), "rank", "idx"), "level")
        count = fresh.count() if url_limit is not None else (0 if fresh.isEmpty() else 1)
        if count == 0:
            return seen.withColumn("capped", F.lit(False))
        depth += 1
        if url_limit is not None:
            used += count
        seen, name = bucketed(fresh.select("url", "source", F.lit(depth).alias("depth"), "rank"), "crawl", "url", into=name)
    # A limit ended it: links of the last two levels may lead to URLs that were left out.
    late = seen.where(F.col("depth") >= depth - 1).select(F.col("url").alias("source")).join(edges, "source").select("source", "url")
    late = late.join(seen.select("url"), "url", "left_anti")
    if known is not None:
        late = late.join(known, "url", "left_semi")
    out = late.groupBy(F.col("source").alias("url")).agg(F.lit(True).alias("capped"))
    return seen.join(out, "url", "left").withColumn("capped", F.coalesce("capped", F.lit(False)))
