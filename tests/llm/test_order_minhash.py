import hashlib
import random

from pyspark.sql import functions as F

from pagesieve.llm import op3_order_minhash as O


def edited(docs):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: r[0])
    for (i, x), (_, y) in zip(rows, rows[1:] + rows[:1]):
        k = len(x) // 4
        yield i, x[: len(x) - k] + y[:k]


def test_edited_texts(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id <> 8")
    got = O.fingerprints(docs).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in edited(docs)}
    assert O.fingerprints(odd_docs).count() == odd_docs.count()
    assert O.fingerprints(no_docs).count() == 0
    one = O.fingerprints(docs.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0


def test_equal_texts_have_equal_fingerprints(odd_docs):
    rows = {}
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in O.fingerprints(odd_docs).where("doc_id IS NOT NULL").collect():
        rows.setdefault(texts[r["doc_id"]] or "", set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in rows.values())


def brute(words, hash_of):
    """Signature from the definition: numbered k-mers, bins, least two, text order."""
    seen, kept = {}, []
    n = len(words)
    for i in range(max(1, n - O.K + 1)) if n else ():
        km = tuple(words[i : i + O.K])
        seen[km] = seen.get(km, -1) + 1
        kept.append((hash_of[km, seen[km]], i))
    return sorted(kept)


def test_signature_by_definition(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcd") for _ in range(n)) for n in (0, 1, 2, 3, 4, 30, 300)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x["i"]: x["s"] for x in frame.select("i", O.signature(F.col("t")).alias("s")).collect()}
    top = 1 << O.HASH_BITS
    for i, t in enumerate(texts):
        words = t.split()
        kms = {}
        for k in range(max(1, len(words) - O.K + 1)) if words else ():
            km = tuple(words[k : k + O.K])
            kms[km] = kms.get(km, 0) + 1
        pairs = [(km, o) for km, c in kms.items() for o in range(c)]
        cols = []
        for km, o in pairs:
            h = F.xxhash64(*[F.xxhash64(F.lit(w)) for w in km], *[F.lit(None).cast("long")] * (O.K - len(km)))
            cols.append(F.shiftrightunsigned(F.xxhash64(F.shiftrightunsigned(h, 64 - O.HASH_BITS), F.lit(o)), 64 - O.HASH_BITS))
        values = spark.range(1).select(F.array(*cols).alias("v")).first()["v"] if cols else []
        least = brute(words, dict(zip(pairs, values)))
        want = [None] * O.BINS
        pick = []
        for b in range(O.BINS):
            own = [x for x in least if x[0] * O.BINS // top == b][: O.TUPLE]
            pick += own
        for b in range(O.BINS):
            at = next((j for j, x in enumerate(pick) if x[0] * O.BINS // top == b), None)
            if at is not None:
                two = sorted({pick[at], pick[(at + 1) % len(pick)]}, key=lambda x: x[1])
                want[b] = tuple(x[0] for x in two)
        flat = [w for w in want if w]
        hashes = spark.range(1).select(F.array(*[F.xxhash64(*[F.lit(v).cast("long") for v in w]) for w in flat]).alias("v")).first()["v"] if flat else []
        it = iter(hashes)
        assert got[i] == [next(it) if w else None for w in want], t


def test_order_counts_and_edits_cost_more_than_nothing(spark):
    r = random.Random(4)
    words = [f"w{r.randint(0, 5000)}" for _ in range(400)]
    half = words[200:] + words[:200]
    few = words[:100] + ["new"] + words[100:]
    frame = spark.createDataFrame([(" ".join(words), " ".join(half), " ".join(few), " ".join(reversed(words)))], "a string, b string, c string, d string")
    sig = {c: O.signature(F.col(c)) for c in "abcd"}
    moved, close, far = frame.select(*[O.likeness(sig["a"], sig[c]) for c in "bcd"]).first()
    assert close > 0.9 and 0.3 < moved < close and far < 0.1


def test_no_python_in_the_plan(spark):
    plan = O.op3(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
