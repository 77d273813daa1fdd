"""Corpus pipeline: toxic documents go, repeated lines go, near copies go, sources are mixed, texts are encoded.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and, but for the
last, returns rows with the columns of its input. ``run`` applies them to the documents
table, writing each stage's rows as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesieve.llm import op4_toxicity, op5_mixing, op6_line_dedup, op7_setsketch, op9_bpe
from pagesieve.llm.registry import stored, table

STAGES = [
    ("toxicity", op4_toxicity.stage),
    ("line_dedup", op6_line_dedup.stage),
    ("near_dedup", op7_setsketch.stage),
    ("mixing", op5_mixing.stage),
    ("bpe", op9_bpe.stage),
]

# Learnt tags and byte-pair merges can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
