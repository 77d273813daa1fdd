"""Regressions: the changes are compiled, and a history's reader moves only the fields it was asked for."""

import contextlib
import io

from pyspark.sql import functions as F

from pagesieve.catalog.history import versions
from pagesieve.operators import regression as R
from pagesieve.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_higher_order_functions_take_finished_arrays(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    text = plan(R.regressions(*versions(spark, FOLDER)))
    # The filter that drops what did not change has the finished arrays as its argument, not the comparisons.
    assert "filter(concat(fixed_" in text


def test_header_changes(spark):
    before, after = versions(spark, FOLDER)
    state = lambda s, v: F.struct(F.lit(s).alias("state"), F.lit(v).alias("value"))
    heads = lambda *x: F.map_from_arrays(F.array(*[F.lit(k) for k in "abcd"]), F.array(*x))
    with_ = lambda df, h: df.withColumn("snapshot", F.col("snapshot").withField("headers", h)).orderBy("url").limit(1)
    one = before.join(after.select("url"), "url", "left_semi")
    old = heads(state("present", "x"), state("missing", ""), state("odd", "x"), state("review", "x"))
    new = heads(state("Missing", ""), state("covered", "y"), state("present", "x"), state("review", "y"))
    rows = R.regressions(with_(one, old), with_(one, new)).select("id", "before", "after", "direction", "severity").collect()
    assert [tuple(r) for r in rows] == [
        ("security.header.a", "present", "Missing", "regression", "warning"), ("security.header.b", "missing", "covered", "improvement", "info"),
        ("security.header.c", "odd", "present", "changed", "info"), ("security.header.d", "review", "review", "changed", "info"),
    ]


def test_history_without_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("u", "i", "n", 1, "s"), ("u", "j", "n", 2, "s")], "url string, id string, name string, at int, snapshot string")
    rows.select("url", "id", "name", F.timestamp_seconds("at").alias("created_at"), "snapshot").write.parquet(str(tmp_path / "history" / "batch=0"))
    some = jobs.stream_history(spark, str(tmp_path), fields=("created_at",))
    assert sorted(r["id"] for r in some.collect()) == ["i", "j"] and "snapshot:string" not in plan(some)
    assert [r["id"] for r in jobs.stream_history(spark, str(tmp_path), keep=1).collect()] == ["j"]
