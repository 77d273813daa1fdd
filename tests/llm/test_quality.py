import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagesieve.llm import op1_quality as Q

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, hit, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if often[x] > 1:
            hit.update(range(i, i + 5))
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def check(rows, docs):
    want = Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_counts_on_odd_texts(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    check(Q.judge(odd_docs, labels).collect(), odd_docs)
    assert Q.judge(no_docs, labels).count() == 0
    assert Q.judge(odd_docs, labels.limit(0)).where("size(failed) > 0").count() == 0


def test_counts_on_the_given_table(spark):
    check(Q.op1(spark, SF).collect(), spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("k, n, delta", [(0, 100, 0.05), (3, 100, 0.05), (7, 20, 0.001), (99, 100, 0.1)])
def test_bound_is_exact(k, n, delta):
    from math import comb

    p = Q.upper_bound(k, n, delta)
    assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(delta, rel=1e-6)


def test_bound_at_the_ends():
    assert Q.upper_bound(0, 0, 0.05) == 1 and Q.upper_bound(5, 5, 0.05) == 1


def test_cutoffs_follow_the_bound(spark):
    rates = {"a": 0.0, "b": 0.004, "c": 0.2}
    rows = [(s, float(i < r * 4000) * 0.6, 0.0, 0.0, 0.0, 0.0) for s, r in rates.items() for i in range(4000)] + [("d", 0.0, 0.0, 0.0, 0.0, 0.0)] * 5
    good = spark.createDataFrame(rows, "g string, " + ", ".join(f"{r} double" for r in Q.RULES))
    got = {r["stratum"]: r for r in Q.choose(good, "g").collect()}
    first, last = Q.RULES["symbol_share"][0], Q.RULES["symbol_share"][-1]
    assert got["a"]["symbol_share"] == last and got["b"]["symbol_share"] == last
    assert got["c"]["symbol_share"] is None and got["d"]["symbol_share"] is None
    level = Q.DELTA / (4 * len(Q.RULES))
    assert Q.upper_bound(16, 4000, level) <= Q.ALPHA / len(Q.RULES) < Q.upper_bound(800, 4000, level)
    assert first > last


def test_good_texts_outside_the_holdout_stay(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.judge(docs.select("doc_id", "text", "lang"), labels).join(labels, "doc_id").where(~F.col("base_failed"))
    r = {x["quality"]: x["kept"] for x in out.where(~Q.in_holdout(F.col("doc_id"))).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert r[1] > 0.95 and r[0] < 0.7
