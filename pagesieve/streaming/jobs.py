"""Structured Streaming jobs: redirect chains, debouncing, result reuse, alerts, progress."""

from __future__ import annotations

import contextlib
import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.regression import regressions
from ..operators.snapshots import newest
from ..session import checkpoint_dir

# Executors need not have this package installed: the state function travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHAIN = "request_id string, final_url string, status int, hops int, chain string"
# Columns side by side: an element of a state list holds many rows.
WAITING = "request_id array<string>, ts array<long>, event_id array<long>, kind array<string>, url array<string>, target array<string>, status array<int>"
HOPS = "request_id array<string>, url array<string>, target array<string>, status array<int>"
CHUNK = 10_000
# Requests share this many state keys; fixed for the life of a checkpoint.
BUCKETS = 1024


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def typed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which state of several variables needs.

    A query takes the session's settings when it starts, so the session has its own back afterwards.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_to_table(stream: DataFrame, mode: str = "append", typed: bool = False) -> DataFrame:
    """Process what is available, write it under the shared folder, return the result table.

    In the other modes each batch holds current totals, and the newest batch is returned.
    ``typed``: the stream's state has several variables.
    """
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    with typed_state(spark) if typed else contextlib.nullcontext():
        if mode == "append":
            query = writer.format("parquet").option("path", f"{root}/rows").start()
        else:
            query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/rows/batch_id={n}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{root}/rows")
    rows = spark.read.parquet(f"{root}/rows")
    newest = rows.agg(F.max("batch_id")).first()[0]
    return rows.where(F.col("batch_id") == F.lit(newest)).drop("batch_id")


def _elements(rows: list[tuple]) -> list[tuple]:
    """Rows as elements of a state list, columns side by side."""
    return [tuple(list(column) for column in zip(*rows[i:i + CHUNK])) for i in range(0, len(rows), CHUNK)]


def _rows(state) -> list[tuple]:
    return [row for element in state.get() for row in zip(*element)]


class _Chains(StatefulProcessor):
    """Holds the events of a bucket of requests until the watermark has passed them, then reads them in order of time.

    A call into the state store costs far more than a row, so many requests share a key and
    many rows an element. State are two lists: events not yet passed, and the open hops. A
    timer at the earliest event that waits wakes the bucket when the watermark gets there.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.hops = handle.getListState("hops", HOPS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = []
        for b in rows:
            # Events that still wait are only added to; the list is read again when its turn has come.
            self.waiting.appendValue(tuple(b[c].tolist() for c in ("request_id", "us", "event_id", "kind", "url", "target", "status")))
            earliest.append(int(b["us"].min()))
        yield from self._read(timerValues, min(earliest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._read(timerValues, 0)

    def _read(self, timerValues, earliest: int) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if earliest // 1000 + 1 >= mark:
            self.handle.registerTimer(max(mark + 1, earliest // 1000 + 1))
            return
        events = sorted(_rows(self.waiting), key=lambda e: e[1:])
        ready = [e for e in events if e[1] // 1000 + 1 < mark]
        left = events[len(ready):]
        hops, done = {}, []
        for request, *hop in _rows(self.hops) if ready else ():
            hops.setdefault(request, []).append(tuple(hop))
        for request, _, _, kind, url, target, status in ready:
            if kind == "redirect":
                hops.setdefault(request, []).append((url, target, status))
            elif kind == "headers":
                mine = hops.get(request, ())
                done.append((request, url, status, len(mine), " > ".join([h[0] for h in mine] + [url])))
            elif kind in ("complete", "error"):
                hops.pop(request, None)
        if ready:
            for state, rows in ((self.waiting, left), (self.hops, [(request, *h) for request, mine in hops.items() for h in mine])):
                if rows:
                    state.put(_elements(rows))
                else:
                    state.clear()
        if left:
            self.handle.registerTimer(max(mark + 1, left[0][1] // 1000 + 1))
        if done:
            yield pd.DataFrame(done, columns=["request_id", "final_url", "status", "hops", "chain"])

    def close(self) -> None:
        pass


def redirect_chains(events: DataFrame, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """One chain per response: the redirects of its request since the last completion or error.

    ``events``: ``request_id, event_id, ts, kind (request|redirect|headers|complete|error),
    url, target, status``. Events count in order of (ts, event_id) once the watermark is
    past them, so batch borders and late arrival within ``delay`` do not change the result.
    State is the open hops of a request and its events not yet passed; both are gone when
    the request completes. Requests are dealt to ``buckets``;
    a task holds the waiting events and open hops of one of them at a time.
    """
    rows = events.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("request_id"), F.lit(buckets)).cast("int").alias("bucket"), "request_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "kind", "url", "target", "status")
    return rows.groupBy("bucket").transformWithStateInPandas(_Chains(), CHAIN, "Append", "EventTime")


def open_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable of a stateful job (``hops`` or ``waiting`` of :func:`redirect_chains`) as a table."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)
    elements = reader.option("flattenCollectionTypes", "true").load().select("list_element.*")
    return elements.select(F.inline(F.arrays_zip(*elements.columns)))


def debounce_changes(events: DataFrame, key: str, gap: str = "800 milliseconds", delay: str = "10 minutes") -> DataFrame:
    """Bursts of changes whose gaps are below ``gap`` become one re-audit each."""
    rows = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("changes"))
    return rows.select(key, F.col("w.start").alias("first_change"), F.col("w.end").alias("due"), "changes")


def link_cache(results: DataFrame, delay: str = "1 hour", force: bool = False) -> DataFrame:
    """Successful results, once per URL within the delay; ``force`` lets every result through."""
    good = results.where("error = '' AND status BETWEEN 1 AND 399").withWatermark("ts", delay)
    return good if force else good.dropDuplicatesWithinWatermark(["url"])


def robots_cache(fetches: DataFrame, ttl: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Latest robots result per host and time-to-live window."""
    w = F.window("ts", ttl).alias("w")
    rows = fetches.withWatermark("ts", delay).groupBy(w, "host").agg(F.max_by("status", "ts").alias("status"), F.count("*").alias("requests"))
    return rows.select("host", F.col("w.start").alias("window_start"), "status", "requests")


def check_progress(results: DataFrame) -> DataFrame:
    """Checked, failed and total counts per operation, for update or complete mode."""
    return results.groupBy("operation").agg(
        F.count("*").alias("requested"), F.count_if("checked").alias("checked"), F.count_if("failed").alias("failed")
    )


def stream_regressions(snapshots: DataFrame, baseline: DataFrame, target: str):
    """Start a query that compares arriving snapshots with a baseline and keeps the history.

    Per batch, the arriving rows are added to the history and the changes against the
    baseline are written, each into a folder of the batch's own, so a replayed batch
    overwrites itself. Nothing older is read or rewritten; :func:`stream_history` applies
    replacement and retention.
    """

    def step(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("created_at", F.col("created_at").cast("timestamp"))
        rows.write.mode("overwrite").parquet(f"{target}/history/batch={n}")
        latest = rows.groupBy("url").agg(F.max_by("snapshot", F.struct("created_at", "id")).alias("snapshot"))
        regressions(baseline, latest).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{target}/changes/{n}")

    return (
        snapshots.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{target}/state")
        .trigger(availableNow=True)
        .start()
    )


def stream_history(spark: SparkSession, target: str, keep: int = 50, fields: tuple[str, ...] = ("name", "created_at", "snapshot")) -> DataFrame:
    """History after the batches so far: the last row of each snapshot id, the newest ``keep`` per URL.

    ``fields`` besides URL and id, ``created_at`` among them; without ``snapshot`` no snapshot is read or moved.
    """
    rows = spark.read.parquet(f"{target}/history")
    last = rows.groupBy("url", "id").agg(F.max_by(F.struct(*fields), "batch").alias("f"))
    return newest(last.select("url", "id", "f.*"), keep)
