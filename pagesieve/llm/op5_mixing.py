"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import fresh, query, stored, table

SEED = 17
UNIT = float(2**52)


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... up to where the upper tail is below the draws' resolution."""
    top = math.ceil(rate + 12 * math.sqrt(rate) + 24)
    if rate <= 0:
        return [1.0]
    total, out = 0.0, []
    for k in range(top + 1):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(total)
    return out


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """Repetition rate of each source: (source, size, rate, cdf).

    A source's target share is its weight (0 where none is given), or without weights its
    number of code points to the power ``temperature``; shares are scaled to sum to 1. The
    mixture has ``epochs`` times the code points of the corpus, so
    rate = share * epochs * total / size. A source of empty texts has size 1 a document.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")).alias("size"))
    if weights is None:
        shares = sizes.withColumn("part", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        whole = F.lit(0.0)
        for name, weight in weights.items():
            whole = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(whole)
        shares = sizes.withColumn("part", whole)
    shares = stored(shares, "shares")
    total = shares.agg(F.sum("size").alias("size_all"), F.sum("part").alias("part_all"))

    def cdfs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cdf=[poisson_cdf(r) for r in b["rate"]])

    rate = F.when(F.col("part_all") > 0, F.col("part") / F.col("part_all") * epochs * F.col("size_all") / F.col("size")).otherwise(F.lit(0.0))
    one = total.first()  # one row: the two totals
    known = shares.withColumns({"size_all": F.lit(one["size_all"]).cast("double"), "part_all": F.lit(one["part_all"]).cast("double")})
    return stored(known.select("source", "size", rate.alias("rate")).mapInPandas(cdfs, "source string, size long, rate double, cdf array<double>"), "rates")


def replicate(docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = SEED,
              copy_name: str | None = None, key_name: str | None = None) -> DataFrame:
    """Every document as often as its draw says, in a globally random order.

    The draw inverts the Poisson distribution of the source's rate at a number in [0, 1)
    hashed from the seed and doc_id, so a run over more executors or a second run gives
    the same mixture. Copies are numbered from 1 and dealt to partitions by a hash of
    (seed, doc_id, copy), by which each partition is also sorted: the order over all
    partitions is a random permutation. All columns of ``docs`` stay; ``copy``
    and ``shuffle_key`` are added under these or the given names.

    A NULL source is a source like any other, a NULL doc_id is hashed as the word "null",
    a NULL or empty text counts one code point, and rows with the same doc_id get the same
    count. An empty table gives an empty mixture.
    """
    copy_name, key_name = copy_name or fresh(docs, "copy"), key_name or fresh(docs, "shuffle_key")
    of, cdf, u, n = (fresh(docs, x) for x in ("of_source", "cdf", "draw", "times"))
    table_ = rates(docs, weights, temperature, epochs).select(F.col("source").alias(of), F.col("cdf").alias(cdf))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name)), 1, 13), 16, 10).cast("long") / F.lit(UNIT)
    # One row a source on the right; Spark broadcasts it while it is small and splits a hot source otherwise.
    counted = docs.withColumn(u, draw).join(table_, F.col("source").eqNullSafe(F.col(of)), "inner")
    times = F.size(F.filter(cdf, lambda x: x <= F.col(u)))
    made = counted.withColumn(n, times).where(F.col(n) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy_name))
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.col(copy_name).cast("string")))
    return made.withColumn(key_name, key).repartition(key_name).sortWithinPartitions(key_name)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: copies of the documents, with the columns of the input, in random order."""
    return replicate(docs).select(*docs.columns)


SQL = """
WITH d AS (SELECT doc_id, text, source, CAST(('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, CAST(sum(greatest(coalesce(length(text), 0), 1)) AS DOUBLE) AS size FROM d GROUP BY source),
r AS (SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM s) * (SELECT sum(size) FROM s) / size AS rate FROM s),
p AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS mass FROM r, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) t(k)),
c AS (SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
n AS (SELECT d.doc_id, d.text, d.source, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.cdf <= d.u) AS times FROM d),
e AS (SELECT doc_id, text, source, CAST(unnest(range(1, times + 1)) AS INTEGER) AS copy FROM n)
SELECT doc_id, source, copy, text, md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(copy AS VARCHAR)) AS shuffle_key FROM e
"""


@query("op5_poisson_mixture", SQL)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return replicate(docs)
