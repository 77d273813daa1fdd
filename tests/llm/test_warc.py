import base64
import gzip
import hashlib
import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from pagesieve.llm import op8_warc as W
from pagesieve.llm.registry import scratch


@pytest.fixture(scope="module")
def pages(spark):
    big = "".join(chr(97 + i * i % 23) for i in range(700_000))
    rows = [(1, "http://a/", "<p>x</p>", 1), (2, "http://b/", "<p>x</p>", 1), (3, None, None, 1), (4, "http://d/", "", 1), (5, "http://e/\r\nWARC-Type: x", "é😀\r\n\r\nWARC/1.1\r\n", 1),
            (6, "http://f/", big, 1), (7, "http://g/", big, 1), (8, "http://h/", "tie", 1), (8, "http://h/", "tie", 1), (None, "http://n/", "no id", 1), (9, "http://i/", "no id", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, chunk int")


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark, pages):
    folder = scratch(spark, "warc")
    archives = W.write_archives(pages, folder, chunk=1000, file_bytes=2000)
    assert archives.count() >= 2
    chunks = W.read_chunks(archives, folder, chunk=4096).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: (r["file"], r["record"], r["chunk"])):
        key = (r["file"], r["record"])
        whole[key] = whole.get(key, b"") + bytes(r["data"])
        assert len(r["data"]) <= 4096 and r["bytes_so_far"] == len(whole[key])
        assert r["digest_so_far"] == base64.b32encode(hashlib.sha1(whole[key]).digest()).decode()
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    last = {(r["file"], r["record"]): r for r in chunks if r["last"]}
    assert len(last) == pages.count()
    for key, r in last.items():
        page = None if r["page_id"] == -(2**63) else r["page_id"]
        assert r["payload_digest"] == sha(html[page])
        assert whole[key] == (html[page].encode() if r["record_type"] == "response" else b"")
    text = b"".join(gzip.open(urlparse(r["path"]).path).read() for r in archives.collect())
    assert text.count(b"WARC/1.1\r\nWARC-Type:") == pages.count() and b"%0D%0AWARC-Type" in text
    assert all(os.path.exists(urlparse(r["path"]).path) for r in archives.collect())


def test_result(spark, pages):
    folder = scratch(spark, "warc")
    got = W.payloads(W.read_chunks(W.write_archives(pages, folder), folder, with_data=False)).collect()
    rows = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))
    html = {r["page_id"] or 0: r["html"] or "" for r in pages.collect()}
    top = {}
    for i, h in html.items():
        top[h] = max(top.get(h, -1), i)
    want = sorted((i, len(h.encode()), sha(h), *(("response", None) if top[h] == i else ("revisit", top[h]))) for i, h in [*html.items(), (8, "tie")])
    assert rows == want


def test_matches_sql(spark, pages, same):
    folder = scratch(spark, "warc")
    some = pages.where("page_id IS NOT NULL AND page_id <> 8")
    same(W.payloads(W.read_chunks(W.write_archives(some, folder), folder)), W.SQL, pages=some)
    none = pages.limit(0)
    assert W.payloads(W.read_chunks(W.write_archives(none, folder), folder)).count() == 0


def test_query_stores_the_bytes(spark, pages, tmp_path, monkeypatch):
    some = pages.where("page_id IS NOT NULL AND page_id <> 8")
    some.write.parquet(f"{tmp_path}/pages.parquet")
    kept, store = {}, W.stored
    monkeypatch.setattr(W, "stored", lambda df, name, **options: kept.setdefault(name, store(df, name, **options)))
    assert W.op8(spark, str(tmp_path)).count() == some.count()
    whole = {}
    for r in sorted(kept["chunks"].collect(), key=lambda r: (r["page_id"], r["chunk"])):
        whole[r["page_id"]] = whole.get(r["page_id"], b"") + bytes(r["data"])
    html = {r["page_id"]: (r["html"] or "").encode() for r in some.collect()}
    top = {h: p for p, h in sorted(html.items())}
    assert whole == {p: h if top[h] == p else b"" for p, h in html.items()}


def test_archives_are_read_side_by_side(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("https://e.com/").alias("url"), F.concat(F.lit("body "), F.col("id")).alias("html")).repartition(8)
    folder = str(tmp_path)
    archives = W.write_archives(pages, folder)
    tasks = W.read_chunks(archives, folder).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 1 and archives.count() > 1
