import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from pagesieve.llm import op4_toxicity, op5_mixing

SF = "/root/testdata/sf0.01"


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stages_follow_each_other(spark):
    """Each stage on its predecessor's rows, against what its operator says about them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op4_toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    seen = {}
    for name, stage in P.STAGES:
        before, docs = docs, P.stored(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == before.columns
        if name == "toxicity":
            left = {r["doc_id"] for r in op4_toxicity.score(before, model).where("toxicity.score < 0.5").collect()}
            assert {r["doc_id"] for r in docs.collect()} == left
        if name == "line_dedup":
            assert docs.count() == before.count()
        if name == "near_dedup":
            from test_setsketch import brute

            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == {i for i, _, c in brute(rows) if i == c}
        if name == "mixing":
            want = op5_mixing.replicate(before.drop("copy")).groupBy("doc_id").count().collect()
            assert {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == {r["doc_id"]: r["count"] for r in want}
    assert seen["bpe"].count() == seen["mixing"].count()
    assert P.run(spark, SF).count() == seen["bpe"].count()


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_odd_documents_pass_through(spark, odd_docs, no_docs, kind):
    docs = odd_docs if kind == "odd" else no_docs
    for name, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, SF), name)
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
