import bisect
import zlib
from collections import Counter

from pyspark.sql import functions as F

from pagesieve.llm import op10_ring as R


def hashes(docs, seed=1):
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return [(r["p"] % 2**64, r["s"], r["doc_id"]) for r in docs.select("doc_id", F.xxhash64(F.lit(seed), F.lit("order"), name).alias("p"),
                                                                     F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("ring"), name), 1).alias("s")).collect()]


def brute(rows, shards, epsilon=0.0):
    """One document after the other, clockwise to the first shard with room."""
    at, owner = R.ring(shards)
    room, out, held = R.capacities(len(rows), shards, epsilon), {}, [0] * shards
    for _, spot, doc in sorted(rows):
        k = bisect.bisect_left(at, spot) % len(at)
        while held[owner[k]] >= room[owner[k]]:
            k = (k + 1) % len(at)
        out[doc] = (owner[k], held[owner[k]])
        held[owner[k]] += 1
    return out


def placed(docs, **options):
    return {r["doc_id"]: (r["shard"], r["slot"]) for r in R.shard(docs, **options).collect()}


def test_like_one_after_the_other(spark):
    docs = spark.range(3001).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for shards, epsilon in ((8, 0.0), (5, 0.1), (1, 0.0)):
        assert placed(docs, shards=shards, epsilon=epsilon) == brute(hashes(docs), shards, epsilon)


def test_any_depth_of_search(spark, monkeypatch):
    docs = spark.range(500).select((F.col("id") * 37).alias("doc_id"), F.lit("t").alias("text"))
    monkeypatch.setattr(R, "FETCH", 0)
    assert placed(docs) == brute(hashes(docs), 8)


def test_odd_rows(odd_docs, no_docs):
    rows = R.shard(odd_docs).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == odd_docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert R.shard(no_docs).count() == 0


def test_one_id_for_all_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "FETCH", 50)
    rows = R.shard(spark.range(900).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"))).collect()
    assert max(Counter(r["shard"] for r in rows).values()) == 113 and len({(r["shard"], r["slot"]) for r in rows}) == 900


def test_one_more_shard_moves_few(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    old, new = placed(docs, shards=8, epsilon=0.25), placed(docs, shards=9, epsilon=0.25)
    moved = sum(old[i][0] != new[i][0] for i in old) / len(old)
    assert moved < 0.3
