import random

import numpy as np
import pytest

from pagesieve.llm import op7_setsketch as S
from pagesieve.llm.components import components
from pagesieve.llm.shingles import shingle_sets


def brute(rows):
    """Component of every id by comparing all pairs of sets."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = (t or "").translate(low).encode("utf-8").split()
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:]))))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            c = len(a & b)
            if a and b and 100 * c >= 85 * (len(a) + len(b) - c):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def got(docs):
    out = S.near_duplicates(docs.select("doc_id", "text")).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out)


def test_odd_texts(odd_docs, no_docs):
    docs = odd_docs.where("doc_id IS NOT NULL")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(no_docs) == []
    nulls = S.near_duplicates(odd_docs.select("doc_id", "text")).where("doc_id IS NULL").collect()
    assert len(nulls) == 2 and all(r["component_id"] is None and r["kept"] for r in nulls)


def copies(seed, groups, size, edits):
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(30, 120))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, edits)):
                t[r.randrange(len(t))] = f"x{r.randint(0, 9)}"
            out.append(" ".join(t))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("groups, size, edits", [(60, 4, 3), (1, 400, 2), (2, 120, 5)])
def test_copies(spark, groups, size, edits):
    rows = copies(groups, groups, size, edits)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_dealt_out_buckets_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 40)
    monkeypatch.setattr(S, "BLOCK", 16)
    rows = copies(9, 2, 150, 3)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(2)
    for j in (0.2, 0.5, 0.85):
        n, shared = 2000, int(2 * 2000 * j / (1 + j))
        pool = r.integers(0, 2**63, 2 * n - shared, dtype=np.int64).astype(np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n - shared :])
        sk = S.sketches(np.concatenate([a, b]), np.array([n, n]))
        union = S.sketches(np.unique(np.concatenate([a, b])), np.array([2 * n - shared]))
        assert (S.merged(sk[0], sk[1]) == union[0]).all()
        assert abs(S.likely_similarity(sk[:1], np.array([n]), sk[1:], np.array([n]))[0] - j) < 0.15


def test_shared_counts():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 12_000, r.integers(1, 3000))).astype(np.uint64) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert (S.shared_counts(sets[:4], sets[4:]) == want).all()


def test_shingles_are_those_of_the_definition():
    texts = [b"", b"a b c", b"a b c d e f a b c d e", b" x\ty ", b"q w e r t"]
    values, counts = shingle_sets(texts, 5)
    assert counts.tolist() == [0, 1, 6, 1, 1]
    again, _ = shingle_sets([b"q w e r t"], 5)
    assert values[-1] == again[0] and len(set(values.tolist())) == 9


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    out = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == want
