"""Session settings. On a cluster everything already set there wins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8, app: str = "pagesieve") -> SparkSession:
    """Local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.pagesieve.readPartitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PAGESIEVE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder the cluster names; a temporary one only in local mode where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back.

    It is computed once, later reads prune columns, and a lost executor re-reads files.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, *keys: str, into: str | None = None) -> tuple[DataFrame, str]:
    """Write a table dealt and sorted by ``keys`` to the shared folder; (table, its name).

    Joins and groupings on these keys read it without a shuffle. It has as many buckets as
    shuffles have partitions, so what is joined with it is dealt alike. ``into`` adds the
    rows to a table written before.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = into or f"{label}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    # Dealt as its reader expects, so a task writes one file of one bucket.
    dealt = df.repartition(n, *keys)
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).mode("append" if into else "error").format("parquet").saveAsTable(name)
    return spark.table(name), name
