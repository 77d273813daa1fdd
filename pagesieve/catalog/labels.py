"""Labels, range sizes and clamped options over the lineitem table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl, images
from .registry import query, table

_V = """v AS (SELECT l_orderkey AS o, l_linenumber AS n, (l_orderkey * 37 + l_linenumber * 1013) * (l_linenumber % 4)::BIGINT AS b, l_quantity * l_linenumber * 7.25 AS ms, l_partkey AS part, l_suppkey AS supp, l_quantity AS q FROM lineitem)"""


def _half_up(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', floor({value} * {10 ** digits} + 0.5) / {10 ** digits})"


def _values(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), n.alias("n"), ((F.col("l_orderkey") * 37 + n * 1013) * (n % 4)).cast("bigint").alias("b"),
        (F.col("l_quantity") * n * 7.25).alias("ms"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("q"),
    )


@query(
    "size_labels",
    f"""WITH {_V} SELECT o, n,
          CASE WHEN b = 0 THEN '—' WHEN b < 1024 THEN b || ' B' WHEN b < 102400 THEN {_half_up('b / 1024.0', 1)} || ' KB' WHEN b < 1048576 THEN {_half_up('b / 1024.0', 0)} || ' KB'
            ELSE {_half_up('b / 1048576.0', 2)} || ' MB' END AS image_size,
          CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN {_half_up('b / 1024.0', 1)} || ' KB' ELSE {_half_up('b / 1048576.0', 2)} || ' MB' END AS transfer,
          CASE WHEN ms < 100 THEN {_half_up('ms', 1)} || ' ms' WHEN ms < 1000 THEN {_half_up('ms', 0)} || ' ms' ELSE {_half_up('ms / 1000', 2)} || ' s' END AS duration FROM v""",
)
def size_labels(spark, sf_dir):
    return _values(spark, sf_dir).select(
        "o", "n", images.bytes_label(F.col("b")).alias("image_size"), images.transfer_label(F.col("b")).alias("transfer"), images.ms_label(F.col("ms")).alias("duration")
    )


@query(
    "range_sizes",
    f"""WITH {_V}, r AS (SELECT o, n, CASE n % 3 WHEN 0 THEN 206 WHEN 1 THEN 200 ELSE 404 END AS status, CASE WHEN n % 2 = 0 THEN part ELSE 0 END AS total, CASE WHEN n % 5 = 0 THEN 0 ELSE supp END AS length FROM v)
        SELECT o, n, CASE WHEN total > 0 THEN total WHEN status = 200 AND length > 0 THEN length ELSE 0 END AS size_bytes,
          CASE WHEN total > 0 THEN 'content-range' WHEN status = 200 AND length > 0 THEN 'content-length' ELSE '' END AS size_source FROM r""",
)
def range_sizes(spark, sf_dir):
    n = F.col("n")
    status = F.when(n % 3 == 0, 206).when(n % 3 == 1, 200).otherwise(404)
    header = F.when(n % 2 == 0, F.concat(F.lit("bytes 0-0/ "), F.col("part").cast("string"))).when(n % 4 == 1, F.lit("bytes 0-0/*"))
    length = F.when(n % 5 == 0, F.lit("unknown")).otherwise(F.col("supp").cast("string"))
    return _values(spark, sf_dir).select("o", "n", images.size_from_range(status, header, length).alias("r")).select("o", "n", "r.*")


@query(
    "clamped_options",
    f"""WITH {_V} SELECT o, n, CASE WHEN n % 6 = 0 THEN 9 ELSE greatest(2, least(20, floor(q * 0.5 + 0.5))) END::INT AS depth FROM v""",
)
def clamped_options(spark, sf_dir):
    text = F.when(F.col("n") % 6 == 0, F.lit("many")).otherwise((F.col("q") * 0.5).cast("string"))
    return _values(spark, sf_dir).select("o", "n", crawl.clamp_int(text, 9, 2, 20).alias("depth"))
