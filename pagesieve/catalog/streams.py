"""Streaming queries over the events table, run to completion on what is available."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..streaming import jobs
from .history import REGRESSION_SQL, versions
from .registry import query

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark, sf_dir):
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


_E = """e AS (SELECT event_id, ts, user_id, event_type, value FROM events), m AS (SELECT date_trunc('millisecond', max(ts)) AS hi FROM events)"""


@query(
    "debounce_changes",
    f"""WITH {_E}, g AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM (
          SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS starts FROM e)),
        w AS (SELECT user_id, min(ts) AS first_change, max(ts) + INTERVAL 1 HOUR AS due, count(*) AS changes FROM g GROUP BY user_id, grp)
        SELECT user_id, first_change, due, changes FROM w, m WHERE due <= hi - INTERVAL 10 MINUTE""",
)
def debounce_changes(spark, sf_dir):
    return jobs.run_to_table(jobs.debounce_changes(event_stream(spark, sf_dir), "user_id", "1 hour"))


def _requests(stream):
    """Every user is a request; events by type are its redirect, header, completion and error signals."""
    kind = (
        F.when(F.col("event_type") == "click", "redirect").when(F.col("event_type") == "view", "headers")
        .when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "signup", "request").otherwise("error")
    )
    url = F.concat(F.lit("https://r.example.com/"), F.col("event_id").cast("string"))
    # A new request id per event-type run would hide chains; ids group ten consecutive events.
    return stream.select(
        F.floor(F.col("event_id") / 5).cast("string").alias("request_id"), "event_id", "ts", kind.alias("kind"), url.alias("url"), url.alias("target"),
        F.lit(301).alias("status"),
    )


@query(
    "redirect_chains",
    f"""WITH {_E}, k AS (SELECT event_id, ts, event_id // 5 AS r, CASE event_type WHEN 'click' THEN 'redirect' WHEN 'view' THEN 'headers' WHEN 'signup' THEN 'request' WHEN 'purchase' THEN 'end' ELSE 'end' END AS kind FROM e),
        x AS (SELECT k.*, row_number() OVER w AS n, coalesce(sum(CASE WHEN kind = 'end' THEN 1 END) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS part FROM k, m
              WHERE date_trunc('millisecond', ts) + INTERVAL 1 MILLISECOND < hi - INTERVAL 10 MINUTE WINDOW w AS (PARTITION BY r ORDER BY ts, event_id))
        SELECT a.r::VARCHAR AS request_id, 'https://r.example.com/' || a.event_id AS final_url, count(b.event_id)::INT AS hops FROM x a LEFT JOIN x b ON b.r = a.r AND b.kind = 'redirect' AND b.n < a.n AND b.part = a.part
        WHERE a.kind = 'headers' GROUP BY a.r, a.event_id""",
)
def redirect_chains(spark, sf_dir):
    rows = jobs.run_to_table(jobs.redirect_chains(_requests(event_stream(spark, sf_dir))), typed=True)
    return rows.select("request_id", "final_url", "hops")


@query(
    "link_cache",
    f"""WITH {_E} SELECT DISTINCT 'https://l.example.com/' || user_id AS url FROM e WHERE event_type <> 'error'""",
)
def link_cache(spark, sf_dir):
    results = event_stream(spark, sf_dir).select(
        F.concat(F.lit("https://l.example.com/"), F.col("user_id").cast("string")).alias("url"), "ts",
        F.when(F.col("event_type") == "error", "timeout").otherwise("").alias("error"), F.lit(200).alias("status"),
    )
    return jobs.run_to_table(jobs.link_cache(results, "60 days")).select("url")


@query(
    "robots_cache",
    f"""WITH {_E}, w AS (SELECT 'h' || (user_id % 7) AS host, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, arg_max(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END, ts) AS status, count(*) AS requests FROM e GROUP BY 1, 2)
        SELECT host, window_start, status::INT AS status, requests FROM w, m WHERE window_start + INTERVAL 5 MINUTE <= hi - INTERVAL 10 MINUTE""",
)
def robots_cache(spark, sf_dir):
    fetches = event_stream(spark, sf_dir).select(
        F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("host"), "ts", F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status")
    )
    return jobs.run_to_table(jobs.robots_cache(fetches))


@query(
    "check_progress",
    f"""WITH {_E} SELECT event_type AS operation, count(*) AS requested, count(*) FILTER (WHERE value > 0) AS checked, count(*) FILTER (WHERE value > 50) AS failed FROM e GROUP BY event_type""",
)
def check_progress(spark, sf_dir):
    results = event_stream(spark, sf_dir).select(
        F.col("event_type").alias("operation"), (F.col("value") > 0).alias("checked"), (F.col("value") > 50).alias("failed")
    )
    return jobs.run_to_table(jobs.check_progress(results), "complete")


@query("stream_regressions", f"WITH {REGRESSION_SQL} SELECT 'https://shop.example.com/o/' || o AS url, id, direction FROM ch UNION ALL SELECT 'https://shop.example.com/o/' || o, 'new', 'kept' FROM v WHERE v = 0")
def stream_regressions(spark, sf_dir):
    before, after = versions(spark, sf_dir)
    root = f"{checkpoint_dir(spark)}/alerts-{uuid.uuid4().hex}"
    arriving = after.select("url", F.lit("new").alias("id"), F.lit("Snapshot").alias("name"), F.current_timestamp().alias("created_at"), "snapshot")
    arriving.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    jobs.stream_regressions(stream, before, root).awaitTermination()
    changes = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/changes")
    kept = jobs.stream_history(spark, root, fields=("created_at",)).select("url", "id", F.lit("kept").alias("direction"))
    return changes.select("url", "id", "direction").unionByName(kept)
