"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import time

from pagesieve.catalog import load
from pagesieve.session import local_session

HEADLINE = [
    "page_meta", "links", "images", "dom_stats", "text_scan", "scripts", "dom_resources", "issues", "score", "indexability", "page_type",
    "product_fields", "category_audit", "audit_rows", "duplicate_titles", "duplicate_groups", "anchor_conflicts", "link_summary", "robots_eval",
    "sitemap_membership", "hreflang_targets", "canonical_chain", "crawl", "resource_summary", "third_party", "security_audit", "image_audit",
    "regressions", "append_snapshots", "debounce_changes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus))
    queries, _ = load()
    # One untimed run starts the JVM's code caches and the Python workers.
    queries["page_meta"](spark, folder).write.format("noop").mode("overwrite").save()
    times, first = {}, {}
    # Expressions are built once per session. The first building and planning of each query is
    # timed on its own: "cold" is that plus the run, "queries" is the run with expressions at hand.
    for name in HEADLINE:
        start = time.perf_counter()
        if name != "debounce_changes":
            queries[name](spark, folder)._jdf.queryExecution().executedPlan()
        first[name] = time.perf_counter() - start
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    cold = {name: round(first[name] + times[name], 3) for name in HEADLINE}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "cold": cold, "cold_total": round(sum(cold.values()), 3), "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
