import math

from pyspark.sql import functions as F

from pagesieve.llm import op11_licenses as L

NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"


def brute(text, threshold=L.THRESHOLD):
    """Every block of every notice's step, all sets compared."""
    words, found = L.words_of(text or ""), {}
    for label, notice in L.NOTICES:
        want = L.words_of(notice)
        step = 1 << (len(want) - 1).bit_length()
        for at in range(0, len(words) + 1, step):
            both = len(set(words[at : at + 2 * step]) & set(want))
            if both >= math.ceil(threshold * len(set(want)) - 1e-9):
                found[label] = max(found.get(label, 0), both / len(set(want)))
    return found


def texts(spark):
    prose = [f"word{i % 97} of the text number {i}" for i in range(600)]
    rows = [
        (1, NOTICE), (2, " ".join(prose[:7]) + " " + NOTICE.upper() + " " + " ".join(prose[7:40])), (3, "Released under the MIT License."), (4, "Licensed under CC BY-NC 4.0."),
        (5, " ".join(prose) + "\n" + L.NOTICES[9][1] + "\n" + " ".join(prose)), (6, NOTICE.replace("free", "gratis")), (7, NOTICE.replace("redistribute", "").replace("modify", "").replace("published", "").replace("Foundation", "").replace("program", "")),
        (8, "mit license mit license general public license"), (9, " ".join(w for _, w in L.NOTICES)), (10, None), (11, ""), (None, "Apache-License"), (12, "the license is under the terms of the public " * 300),
        (13, "mit license mit\tlicense, MIT_License"), (13, "mit license mit\tlicense, MIT_License"), (14, "\x00\x1f -/:@[`{\x7f")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_like_brute_force(spark):
    docs = texts(spark)
    got = L.scan(docs.withColumn("key", F.col("text"))).collect()
    assert len(got) == docs.count()
    for r in got:
        want, base = brute(r["key"]), set(r["licenses"]["base"])
        assert r["licenses"]["labels"] == sorted(base | set(want))
        assert abs(r["licenses"]["score"] - (1 if base else max(want.values(), default=0))) < 1e-12
        best = {}
        for b in r["licenses"]["blocks"] or []:
            best[b["label"]] = max(best.get(b["label"], 0), b["containment"])
            assert b["from_word"] % (b["words"] // 2) == 0
        assert {k: round(v, 9) for k, v in best.items()} == {k: round(v, 9) for k, v in want.items()}


def test_like_sql(spark, odd_docs, same):
    for docs in (texts(spark), odd_docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, text string")):
        done = L.scan(docs).select("doc_id", "licenses.n_words", "licenses.n_base", "licenses.first_word", "licenses.last_word", F.array_join("licenses.base", ",").alias("base_labels"),
                                   F.array_join("licenses.labels", ",").alias("labels"), "licenses.score")
        same(done, L._sql(), documents=docs)


def test_other_thresholds(spark):
    docs = texts(spark).withColumn("key", F.col("text"))
    for threshold in (0.5, 1.0):
        for r in L.scan(docs, threshold=threshold).collect():
            assert r["licenses"]["labels"] == sorted(set(r["licenses"]["base"]) | set(brute(r["key"], threshold)))


def test_clashing_columns_and_no_notices(spark):
    docs = spark.createDataFrame([(1, "mit license", 5, 7, "x")], "doc_id long, text string, row int, kept int, blocks string")
    got = L.scan(docs)
    assert got.columns == ["doc_id", "row", "kept", "blocks", "licenses"]
    assert got.first()["row"] == 5 and got.first()["blocks"] == "x" and got.first()["licenses"]["base"] == ["mit"]
    none = L.scan(docs, notices=[], phrases=[]).first()["licenses"]
    assert none["n_words"] == 2 and none["labels"] == [] and none["score"] == 0
    assert L.scan(docs.select("text")).columns == ["licenses"]
