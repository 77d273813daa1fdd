"""Redirect chains from typed state: batch borders, timers, and the state read back as a table."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagesieve.streaming import jobs

START = datetime(2024, 1, 1)
EVENTS = "request_id string, event_id long, ts timestamp, kind string, url string, target string, status int"


def at(minute, request, number, kind, url="u", target="t"):
    return (request, number, START + timedelta(minutes=minute), kind, url, target, 301 if kind == "redirect" else 200)


# Three files; the second has an event of the first one's time, the last only moves the watermark.
FILES = [
    [at(0, "a", 1, "request"), at(1, "a", 2, "redirect", "a1", "a2"), at(3, "a", 4, "headers", "a3"), at(1, "b", 5, "redirect", "b1", "b2"), at(2, "c", 6, "redirect", "c1", "c2")],
    [at(2, "a", 3, "redirect", "a2", "a3"), at(4, "a", 7, "complete"), at(5, "a", 8, "headers", "a9"), at(3, "c", 9, "error"), at(4, "c", 10, "headers", "c9")],
    [at(60, "z", 99, "request"), at(59, "y", 98, "headers", "y1")],
]


def run(spark, tmp_path, files_at_once):
    for i, rows in enumerate(FILES):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(str(tmp_path / "in"))
    query = jobs.redirect_chains(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(jobs.CHAIN).parquet(str(tmp_path / "out")).collect()
    return sorted((r["request_id"], r["final_url"], r["hops"], r["chain"]) for r in rows)


def test_same_with_one_file_a_trigger_and_all(spark, tmp_path):
    want = [("a", "a3", 2, "a1 > a2 > a3"), ("a", "a9", 0, "a9"), ("c", "c9", 0, "c9")]
    assert run(spark, tmp_path / "one", 1) == want
    assert run(spark, tmp_path / "all", 10) == want
    for folder in ("one", "all"):
        hops = jobs.open_state(spark, str(tmp_path / folder / "state"), "hops")
        # Requests that completed have left nothing; b is still open, y and z wait for the watermark.
        assert [(r["request_id"], r["url"], r["target"], r["status"]) for r in hops.collect()] == [("b", "b1", "b2", 301)]
        waiting = jobs.open_state(spark, str(tmp_path / folder / "state"), "waiting")
        assert sorted((r["request_id"], r["kind"]) for r in waiting.collect()) == [("y", "headers"), ("z", "request")]
        assert dict(hops.dtypes) == {"request_id": "string", "url": "string", "target": "string", "status": "int"}
        assert waiting.where(F.col("ts").isNull()).count() == 0


def test_runs_without_the_provider_set(spark, tmp_path):
    kept = spark.conf.get(jobs.PROVIDER)
    spark.conf.set(jobs.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        other = spark.conf.get(jobs.PROVIDER)
        for rows in FILES:
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        rows = jobs.run_to_table(jobs.redirect_chains(stream), typed=True).collect()
        assert sorted((r["request_id"], r["final_url"], r["hops"]) for r in rows) == [("a", "a3", 2), ("a", "a9", 0), ("c", "c9", 0)]
        # The session's own setting is back.
        assert spark.conf.get(jobs.PROVIDER) == other
    finally:
        spark.conf.set(jobs.PROVIDER, kept)


def test_requests_share_keys_of_the_state(spark, tmp_path):
    """Hundreds of requests in two buckets: few keys in the state, the chains of a plain reading."""
    rng, kinds = random.Random(7), ["redirect", "redirect", "headers", "complete", "error", "request"]
    rows = [at(i // 60, f"r{rng.randrange(300)}", i, rng.choice(kinds), f"u{i}", f"t{i}") for i in range(1800)]
    for part in (rows[:700], rows[700:1300], rows[1300:]):
        spark.createDataFrame(rng.sample(part, len(part)), EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.redirect_chains(stream, "15 minutes", buckets=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    mark, hops, want = rows[-1][2] - timedelta(minutes=15), {}, []
    for request, number, ts, kind, url, _, status in rows:
        if ts + timedelta(milliseconds=1) >= mark:
            continue
        mine = hops.setdefault(request, [])
        if kind == "redirect":
            mine.append(url)
        elif kind == "headers":
            want.append((request, url, status, len(mine), " > ".join([*mine, url])))
        elif kind != "request":
            mine.clear()
    assert sorted(tuple(r) for r in spark.read.schema(jobs.CHAIN).parquet(str(tmp_path / "out")).collect()) == sorted(want)
    state = str(tmp_path / "state")
    assert sorted(r["url"] for r in jobs.open_state(spark, state, "hops").collect()) == sorted(u for mine in hops.values() for u in mine)
    assert jobs.open_state(spark, state, "waiting").count() == sum(r[2] + timedelta(milliseconds=1) >= mark for r in rows)
    keys = spark.read.format("statestore").option("path", state).option("stateVarName", "waiting").load().select("key").distinct()
    assert keys.count() <= 2
