import math

from pyspark.sql import functions as F

from pagesieve.llm import op5_mixing as M


def test_matches_sql(odd_docs, no_docs, same):
    docs = odd_docs.select("doc_id", "source", "text")
    same(M.replicate(docs), M.SQL, documents=docs)
    assert M.replicate(no_docs).count() == 0


def test_cdf():
    for rate in (0.01, 1, 30, 2000):
        c = M.poisson_cdf(rate)
        assert c[0] == math.exp(-rate) and abs(c[-1] - 1) < 1e-9 and c == sorted(c)
    assert M.poisson_cdf(0) == [1.0]


def test_shares_meet_their_targets(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").alias("source"), F.lit("text").alias("text"))
    got = {r["source"]: r["n"] for r in M.replicate(docs, {"big": 1.0, "mid": 2.0, None: 1.0}, epochs=2.0).groupBy("source").agg(F.count("*").alias("n")).collect()}
    for name, share in (("big", 0.25), ("mid", 0.5), (None, 0.25)):
        assert abs(got[name] / 120_000 - share) < 0.01
    assert M.replicate(docs, {"mid": 1.0}).where("source = 'big' OR source IS NULL").count() == 0


def test_counts_are_poisson_and_seeded(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    n = docs.join(M.replicate(docs, epochs=1.5).groupBy("doc_id").count(), "doc_id", "left").select(F.coalesce("count", F.lit(0)).alias("n")).groupBy("n").count().collect()
    for r in n:
        want = 20_000 * math.exp(-1.5) * 1.5 ** r["n"] / math.factorial(r["n"])
        assert abs(r["count"] - want) < 5 * math.sqrt(want) + 5
    first, again, other = ({(r["doc_id"], r["copy"]) for r in M.replicate(docs, seed=s).collect()} for s in (1, 1, 2))
    assert first == again != other


def test_columns_with_the_same_names_stay(odd_docs):
    out = M.stage(odd_docs.sparkSession, odd_docs, "")
    assert out.columns == odd_docs.columns and set(r["copy"] for r in out.collect()) == {1}
