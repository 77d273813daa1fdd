"""Multi-party perspective rotation of dialogues, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, table

# Turns of one block are numbered together; block totals are then summed up, so no
# task sorts a long conversation as a whole.
BLOCK = 128


def rotate(turns: DataFrame, system: str = "system", block: int = BLOCK) -> DataFrame:
    """One rendering of every dialogue per participant, as ordered segments.

    Every speaker of a conversation but ``system`` is a participant. In that
    participant's rendering the own turns are the assistant's, all others those of named
    users: ``<|assistant|>\\n{text}\\n``, ``<|user|>{speaker}\\n{text}\\n``, and
    ``<|system|>\\n{text}\\n``. The concatenated ``segment`` values in order of
    ``position`` are the dialogue; ``start`` and ``end`` are code point offsets into it,
    and ``[mask_start, mask_end)`` is what the loss is taken on: text and line end of the
    participant's own turns (NULL elsewhere).

    Turns are ordered by (turn, role, text), NULLs first. A NULL role is the user
    "unknown" and no participant, a NULL text is empty, a NULL conv_id names a
    conversation like any other. Repeated rows are repeated segments. A conversation
    without participants has no rendering. Rows of other columns are not read.
    """
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    people = (
        own.where(F.col("role").isNotNull() & (F.col("role") != system))
        .select(F.col("conv_id").alias("of_conv"), F.col("role").alias("perspective"))
        .distinct()
    )
    mine = F.col("role").eqNullSafe(F.col("perspective"))
    head = (
        F.when(mine, F.lit("<|assistant|>\n"))
        .when(F.col("role") == system, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n")))
    )
    rows = own.join(people, F.col("conv_id").eqNullSafe(F.col("of_conv"))).select(
        "conv_id", "perspective", "turn", "role", "text", mine.alias("mine"), head.alias("head"),
        F.floor(F.coalesce("turn", F.lit(0)) / block).alias("block"),
    ).withColumn("n", (F.length("head") + F.length("text") + 1).cast("long"))
    keys = ["conv_id", "perspective", "block"]
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc("text")]
    inside = Window.partitionBy(*keys).orderBy(*order)
    # NULL turns come first; they stand in a block of their own.
    rows = rows.withColumn("block", F.when(F.col("turn").isNull(), F.lit(None)).otherwise(F.col("block")))
    rows = rows.select(
        "*",
        F.row_number().over(inside).alias("k"),
        F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    before = Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(F.count("*").alias("rows_in"), F.sum("n").alias("chars_in")).select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("rows_in").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("chars_in").over(before), F.lit(0)).alias("chars_before"),
    )
    joined = rows.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("block").eqNullSafe(F.col("b")))
    end = F.col("chars_before") + F.col("upto")
    start = end - F.col("n")
    return joined.select(
        "conv_id", "perspective",
        (F.col("rows_before") + F.col("k") - 1).alias("position"),
        F.concat("head", "text", F.lit("\n")).alias("segment"),
        start.alias("start"), end.alias("end"),
        F.when(F.col("mine"), start + F.length("head")).alias("mask_start"),
        F.when(F.col("mine"), end).alias("mask_end"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """Whole renderings with their mask spans, for conversations that fit into one row."""
    parts = F.array_sort(F.array_agg(F.struct("position", "segment", "mask_start", "mask_end")))
    return segments.groupBy("conv_id", "perspective").agg(parts.alias("parts")).select(
        "conv_id", "perspective",
        F.array_join(F.col("parts.segment"), "").alias("text"),
        F.transform(F.filter("parts", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("masks"),
    )


SQL = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL AND role <> 'system'),
r AS (
  SELECT t.*, p.perspective,
    CASE WHEN t.role IS NOT DISTINCT FROM p.perspective THEN '<|assistant|>' || chr(10)
         WHEN t.role = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user|>' || coalesce(t.role, 'unknown') || chr(10) END AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(head) + length(text) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text))
SELECT conv_id, perspective, position, head || text || chr(10) AS segment,
  e - length(head) - length(text) - 1 AS "start", e AS "end",
  CASE WHEN role = perspective THEN e - length(text) - 1 END AS mask_start,
  CASE WHEN role = perspective THEN e END AS mask_end
FROM s
"""


@query("op2_perspective_rotation", SQL)
def op2(spark, sf_dir):
    return rotate(table(spark, sf_dir, "conversations"))
