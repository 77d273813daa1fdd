"""Sketches against exact counts, in one piece and merged from rounds."""

import random

from pyspark.sql import functions as F

from pagesieve.operators import sketches as SK


def test_merged_rounds_like_the_whole(spark):
    r = random.Random(3)
    data = [(f"h{r.choice([0, 0, 0, 1, 2])}", r.randrange(3), f"u{r.randrange(20_000)}", r.randrange(100_000)) for _ in range(60_000)]
    rows = spark.createDataFrame(data, "host string, round int, url string, size long").repartition(6)
    whole = {x["host"]: x for x in SK.estimates(SK.sketch(rows, ["host"], F.col("url"), F.col("size"))).collect()}
    merged = {x["host"]: x for x in SK.estimates(SK.merge(SK.sketch(rows, ["round", "host"], F.col("url"), F.col("size")), ["host"])).collect()}
    assert set(whole) == set(merged) == {"h0", "h1", "h2"}
    for host in whole:
        exact = len({u for h, _, u, _ in data if h == host})
        sizes = sorted(s for h, _, _, s in data if h == host)
        for told in (whole[host], merged[host]):
            assert told["rows"] == len(sizes)
            assert abs(told["distinct"] - exact) <= SK.distinct_error() * exact
            for name, q in (("q50", 0.5), ("q95", 0.95)):
                assert abs(sum(s <= told[name] for s in sizes) / len(sizes) - q) < 0.03


def test_nulls_one_kind_and_empty(spark):
    rows = spark.createDataFrame([("h", None, None), ("h", "u", 5), (None, "u", 7)], "host string, url string, size long")
    got = {x["host"]: x for x in SK.estimates(SK.sketch(rows, ["host"], F.col("url"), F.col("size")), (0.5,)).collect()}
    assert got["h"]["rows"] == 2 and got["h"]["distinct"] == 1 and got["h"]["q50"] == 5 and got[None]["q50"] == 7
    assert SK.estimates(SK.merge(SK.sketch(rows, ["host"], distinct=F.col("url")), ["host"])).columns == ["host", "rows", "distinct"]
    assert SK.merge(SK.sketch(rows.limit(0), ["host"], F.col("url"), F.col("size")), ["host"]).count() == 0
