"""Roll-ups that can be stored and merged: distinct counts and size quantiles as sketches.

An exact distinct count or quantile of a year needs the year's rows again. A sketch per host
and round is a few kilobytes, is made map-side, and those of several rounds are united
without the rows. Relative error of a distinct count: about 1.04 / sqrt(2^bits), 1.6 % at 12
bits, below three times that nearly always; rank error of a quantile: about 1.7 % at k = 200.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, RANKS = 12, 200


def distinct_error(bits: int = BITS) -> float:
    """Three standard errors of a distinct count."""
    return 3 * 1.04 / 2 ** (bits / 2)


def sketch(rows: DataFrame, by: list[str], distinct: Column | None = None, sizes: Column | None = None, bits: int = BITS, ranks: int = RANKS) -> DataFrame:
    """``by``, rows, and binary columns ``distinct_sketch`` and ``size_sketch`` where asked for.

    NULL values are in neither. Groups are combined before they are shuffled, so a host with
    a third of all rows sends one sketch a task.
    """
    made = [F.count("*").alias("rows")]
    if distinct is not None:
        made.append(F.hll_sketch_agg(distinct, F.lit(bits)).alias("distinct_sketch"))
    if sizes is not None:
        made.append(F.kll_sketch_agg_bigint(sizes.cast("bigint"), F.lit(ranks)).alias("size_sketch"))
    return rows.groupBy(*by).agg(*made)


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of any number of rounds, united by ``by`` (a subset of the keys they were made for)."""
    united = [F.sum("rows").alias("rows")]
    if "distinct_sketch" in sketches.columns:
        united.append(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"))
    if "size_sketch" in sketches.columns:
        united.append(F.kll_merge_agg_bigint("size_sketch").alias("size_sketch"))
    return sketches.groupBy(*by).agg(*united)


def estimates(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """What the sketches say: ``distinct`` and ``q50``, ``q95`` and so on; the sketches go."""
    out = sketches
    if "distinct_sketch" in sketches.columns:
        out = out.withColumn("distinct", F.hll_sketch_estimate("distinct_sketch")).drop("distinct_sketch")
    if "size_sketch" in sketches.columns:
        for q in quantiles:
            out = out.withColumn(f"q{round(q * 100)}", F.kll_sketch_get_quantile_bigint("size_sketch", F.lit(q)))
        out = out.drop("size_sketch")
    return out
