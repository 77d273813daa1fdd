import hashlib
import random

from pyspark.sql import functions as F

from pagesieve.llm import op13_runs as R


def brute(words, min_length=6, exponent=4):
    """Every period and start by definition."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, exponent * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences():
    r = random.Random(3)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 4000, ["a", "b"] * 4, (["a", "b"] * 4)[:-1], ["a", "a", "b"] * 9, (["a"] * 7 + ["b"]) * 5, ["x"] * 6 + ["y"] * 6 + ["x"] * 6]
    for _ in range(150):
        words = [r.choice("ab" if r.random() < 0.5 else "abcd") for _ in range(r.randint(0, 60))]
        period = [r.choice("abc") for _ in range(r.randint(1, 9))]
        out.append(words[: r.randint(0, len(words))] + (period * r.randint(2, 9))[: r.randint(1, 60)] + words)
    return out


def test_like_brute_force():
    lists = sequences()
    for min_length, exponent in ((6, 4), (2, 2), (5, 3)):
        _, found = R.text_runs([" ".join(w).encode() for w in lists], min_length, exponent)
        for words, runs in zip(lists, found):
            assert runs == brute(words, min_length, exponent), (words, min_length, exponent)


def test_positions_in_chunks():
    values = list(range(0, 9000, 3))
    random.Random(1).shuffle(values)
    held = R.Positions(values[0])
    for x in values[1:]:
        held.add(x)
    assert list(held) == sorted(values) and held.size == len(values) and len(held.chunks) > 1
    assert held.around(4) == (3, 6) and held.around(-1) == (None, 0) and held.around(9999) == (8997, None)


def test_rows_and_collapsed(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "x " + "a b " * 5 + "c", 3, "k")], "doc_id long, text string, start int, kept string")
    row = R.runs(docs).first()
    assert row["start"] == 3 and row["kept"] == "k"
    assert [tuple(f) for f in row["runs"]["found"]] == [(1, 10, 2)] and row["runs"]["collapsed"] == "x a b c"
    assert R.runs(no_docs).columns == ["doc_id", "lang", "source", "n_chars", "copy", "score", "runs"] and R.runs(no_docs).count() == 0
    for r in R.runs(odd_docs.withColumn("key", F.col("text"))).collect():
        words = (r["key"] or "").encode().split()
        found = brute([w.decode() for w in words]) if len(words) < 2000 else [tuple(f) for f in r["runs"]["found"]]
        assert r["runs"]["n_words"] == len(words) and [tuple(f) for f in r["runs"]["found"]] == found


def test_query_like_definition(spark, tmp_path):
    texts = [None, "", "one", *[" ".join(random.Random(i).choice(["a", "b", "c", "été"]) for _ in range(i * 7)) for i in range(60)]]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a " * 9), (7, texts[7])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    import zlib

    got = R.op13(spark, str(tmp_path))
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, t in [*enumerate(texts), (None, "a " * 9)]:
        words = (t or "").encode().split()
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[x] if x < a else words[a + (x - a) % p] for x in range(n)]
        runs = brute(words)
        gone = {x for s, m, q in runs for x in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = rows[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for x, w in enumerate(words) if x not in gone)).hexdigest()
