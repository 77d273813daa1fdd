import numpy as np
import pytest

from pagesieve.llm import op4_toxicity as T


@pytest.fixture(scope="module")
def model(spark):
    folder = "/root/testdata/sf0.1"
    return T.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


def brute(emit, step, chain):
    """Marginals and log Z by listing all tag sequences."""
    from itertools import product

    n, mass, one = len(chain), 0.0, np.zeros(len(chain))
    for tags in product((0, 1), repeat=n):
        w = np.exp(sum(emit[c, t] for c, t in zip(chain, tags)) + sum(step[a, b] for a, b in zip(tags, tags[1:])))
        mass += w
        one += w * np.array(tags)
    return one / mass, np.log(mass)


def test_forward_backward():
    r = np.random.default_rng(1)
    emit, step = r.normal(size=(4, 2)), r.normal(size=(2, 2))
    chains = [r.integers(0, 4, n) for n in (7, 5, 5, 2, 1)]
    p, log_z, pairs = T._marginals(chains, emit, step)
    for c, got, z in zip(chains, p, log_z):
        want, mass = brute(emit, step, c)
        assert np.allclose(got, want) and np.isclose(z, mass)
    assert np.isclose(pairs.sum(), sum(len(c) - 1 for c in chains))


def test_field_learns_its_tags():
    chains = [np.array([0, 1, 1, 0, 2, 0])] * 30 + [np.array([2, 0, 0])] * 30
    tags = [np.array([0, 1, 1, 0, 0, 0])] * 30 + [np.array([0, 0, 0])] * 30
    of_kind = np.array([[1, 0, 0], [1, 1, 0], [1, 0, 1]])
    emit, step = T._fit_crf(chains, tags, of_kind)
    p = T._marginals([chains[0]], of_kind @ emit, step)[0][0]
    assert (p[1:3] > 0.9).all() and p[[0, 3, 4, 5]].max() < 0.2


def test_held_out_accuracy(spark, model):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = T.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(T.is_held_out()).select("toxicity.score", "toxic").toPandas()
    bad, good = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2 > 0.95
    assert (bad >= 0.5).mean() > 0.85 and (good >= 0.5).mean() < 0.02


def test_spans_and_odd_texts(spark, odd_docs, no_docs, model):
    rows = T.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["toxicity"]["score"] <= 1 for r in rows)
    base = {r["toxicity"]["score"] for r in rows if not (r["text"] or "").strip()}
    assert len(base) == 1 and base.pop() < 0.5
    assert T.score(no_docs, model).count() == 0
    text = "İ A good day. You are an idiot and a clown, a worthless moron. Fine"
    got = T.score(spark.createDataFrame([(text,)], "text string"), model).first()["toxicity"]
    found = " ".join(text[s["start"] : s["end"]] for s in got["spans"])
    assert {"idiot", "moron"} <= set(found.replace(",", " ").split()) and got["score"] > 0.5 and "day" not in found


def test_without_labels_nothing_is_toxic(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = T.train(odd_docs, labels)
    assert {r["toxicity"]["score"] for r in T.score(odd_docs, m).collect()} == {0.0}
    one = spark.createDataFrame([(4, 1, 1), (4, 1, 1), (None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int")
    assert T.train(odd_docs, one).index == {}


def test_fold_never_learnt_from(spark):
    import zlib

    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["h"] for r in ids.select("doc_id", T.is_held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_long_texts_whose_lower_case_is_longer():
    import time

    text = "İ " + "word İx " * 100_000
    start = time.time()
    low = text.lower()
    spans = [(m.start(), m.end(), 1.0) for m in T.TOKEN.finditer(low)][:: 97]
    got = T._offsets(spans, text)
    assert time.time() - start < 20 and len(low) > len(text)
    for (a, b, _), (c, d, _) in zip(spans[:200], got[:200]):
        assert text[c:d].lower().startswith(low[a:b][:1]) and text[c:d].strip() == text[c:d]
    assert T._offsets([(0, 2, 0.9)], "plain") == [(0, 2, 0.9)]


def test_one_chain_however_long(monkeypatch):
    model = T.Crf({"=bad": 1}, np.array([[0.0, -2.0], [0.0, 1.5]]), np.array([[0.3, -0.4], [-0.2, 0.8]]))
    words = (["bad"] + ["fine"] * 3) * 4_000
    whole = T.sentences_of(" ".join(words), model)
    assert len(whole) == 1 and len(whole[0]) == 16_000
    want = model.marginals(whole)[0]
    monkeypatch.setattr(T, "CELLS", 50)
    short = T.sentences_of("bad fine. fine. bad bad fine fine", model)
    got = model.marginals([*short, whole[0], *short])
    assert np.allclose(got[len(short)], want)
    alone = [model.marginals([c])[0] for c in short]
    assert all(np.allclose(a, b) for a, b in zip(got[: len(short)], alone))
