import hashlib
import random

import pytest

from pagesieve.llm import op9_bpe as B


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(B.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return B.Bpe(B.vocabulary())


def check(rows, library):
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts(odd_docs, no_docs, library):
    out = B.encode(odd_docs, B.vocabulary())
    rows = out.select("text", "bpe.*").collect()
    check(rows, library)
    assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in rows)
    back = B.decode(out.select("text", "bpe.ids"), B.vocabulary(), out="again").collect()
    assert all(r["again"] == (r["text"] or "") for r in back)
    assert B.encode(no_docs, B.vocabulary()).count() == 0 and len(rows) == odd_docs.count()


def test_given_table(spark, library):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    check(docs.join(B.op9(spark, folder), "doc_id").collect(), library)


def test_random_texts(own, library):
    r = random.Random(1)
    pool = [*"aaabbbeeet  \n\t\r'stmdlrv0123!?éß漢字 \u0085\x1c\x1f́ 😀|<>", "<|endoftext|>", "  ", "aaaa", " the ", "'ll", "ſ"]
    for _ in range(1500):
        x = "".join(r.choice(pool) for _ in range(r.randint(0, 50)))
        assert ",".join(own.encode([x])[0][0]) == ",".join(map(str, library.encode(x, add_special_tokens=False).ids)), repr(x)


def test_runs_of_one_symbol_merge_from_the_left(own, library):
    for n in range(1, 40):
        for c in "ae -=":
            assert ",".join(own.encode([c * n])[0][0]) == ",".join(map(str, library.encode(c * n, add_special_tokens=False).ids))


def test_small_memory_gives_the_same(own, library, monkeypatch):
    texts = [f"some words {i} and others{i * 7}" for i in range(200)]
    want = own.encode(texts)
    monkeypatch.setattr(B, "REMEMBER", 20)
    monkeypatch.setattr(B, "TOGETHER", 30)
    small = B.Bpe(B.vocabulary())
    assert [x for i in range(0, 200, 7) for x in small.encode(texts[i : i + 7])] == want
    assert len(small.known) <= 40
