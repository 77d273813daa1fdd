import pytest
from pyspark.sql import functions as F

from pagesieve.llm import op6_line_dedup as L


def digest(docs, **options):
    return L.dedup_lines(docs.select("doc_id", "text"), **options).select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text"), 256).alias("kept_sha256"))


def test_matches_sql(odd_docs, no_docs, same):
    docs = odd_docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    same(digest(docs), L.SQL, documents=docs)
    assert digest(no_docs).count() == 0


@pytest.mark.parametrize("bits", [0, 64])
def test_a_small_filter_only_suspects_more(odd_docs, same, bits):
    docs = odd_docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    same(digest(docs, bits_per_line=bits, max_bits=1 << 16), L.SQL, documents=docs)


def test_which_lines_go(spark):
    rows = [(5, "  The Same Line \nonly here, here\nshort\nshort"), (3, "the same line\nthe same line\nshort"), (None, "null id has this line\nTHE SAME LINE"), (7, "null id has this line"), (8, None), (3, "the same line")]
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["lines"]["text"], r["lines"]["n_dropped"]) for r in out.collect()))
    assert got == [(-1, "null id has this line\nTHE SAME LINE", 0), (3, "", 1), (3, "short", 2), (5, "only here, here\nshort\nshort", 1), (7, "", 1), (8, "", 0)]


def test_stage_keeps_rows_and_columns(odd_docs):
    out = L.stage(odd_docs.sparkSession, odd_docs, "")
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert out.where("n_chars <> length(text)").count() == 0


def test_filter_has_no_false_negative(spark):
    import numpy as np
    import xxhash

    docs = spark.createDataFrame([(i, "\n".join(f"line number {k} of all" for k in range(i, i + 30))) for i in range(0, 600, 20)], "doc_id long, text string")
    data, bits = L.repeated_filter(docs)
    twice = [k for k in range(0, 610) if sum(i <= k < i + 30 for i in range(0, 600, 20)) > 1]
    h = np.array([xxhash.xxh3_64_intdigest(f"line number {k} of all".encode()) for k in twice], dtype=np.uint64)
    assert L._in_filter(np.frombuffer(data, dtype=np.uint8), bits, h).all()
    rest = np.array([xxhash.xxh3_64_intdigest(f"absent {k}".encode()) for k in range(5000)], dtype=np.uint64)
    assert L._in_filter(np.frombuffer(data, dtype=np.uint8), bits, rest).mean() < 0.02
