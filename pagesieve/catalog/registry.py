"""Registered queries: a Spark callable each, and the equivalent SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL counterpart."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


# Tables whose rows cost enough work to spread a small file over all cores.
HEAVY = ("pages", "documents", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ids and URLs without the sources, as stored."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
