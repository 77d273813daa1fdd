"""Queries of this folder, and the small helpers its operators share."""

from __future__ import annotations

import importlib
import pkgutil
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Ids are compared and ordered with NULL as the smallest one.
NULL_ID = -(2**63)


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def load():
    """All queries and their SQL; imports every module of the folder."""
    package = importlib.import_module(__package__)
    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{__package__}.{module.name}")
    return QUERIES, ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and a lost executor re-reads files."""
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def id_of(column: str | Column) -> Column:
    """A document id with NULL as the smallest id."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID))


def id_back(column: Column) -> Column:
    return F.nullif(column, F.lit(NULL_ID))


def slices(texts: Iterable, limit: int = 1 << 20) -> Iterator[tuple[int, Sequence[bytes]]]:
    """Runs of texts as UTF-8 bytes, about ``limit`` bytes each, with the index of their first; NULL is empty."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if run and size + len(raw) > limit:
            yield start, run
            start, size, run = i, 0, []
        run.append(raw)
        size += len(raw)
    if run:
        yield start, run
