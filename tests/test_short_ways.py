"""Steps that look first and work only where there is work, with the results of the plain way."""

import re

from pyspark.sql import functions as F

from pagesieve.catalog import audits, load
from pagesieve.functions import html as H
from pagesieve.functions import sql as Q
from pagesieve.functions import urls as U
from pagesieve.functions.core import NOT_SPACE, SPACE, clean
from pagesieve.operators import audit_table as A
from pagesieve.operators import extract as X

_SPACE = "[\\s ﻿  -     　]"
TEXTS = [
    "", " ", "  ", "\t", "a b", " a b ", "a  b", "a\tb", "a \tb", "a\t b", "a b", "a  ", "﻿x", "　 x\n\n y ", "don't  stop-it now’s", "é́  z", "​x", "a\x0b\x0cb\r\nc", "~! !~", "x" * 50000 + "  " + " " * 50000, None,
]


def test_white_space(spark):
    t = F.col("t")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, t string").select(
        "i", clean(t).alias("c"), H.word_count(t).alias("w"), F.regexp_count(t, F.lit(f"{NOT_SPACE}++")).alias("n"), F.regexp_count(t, F.lit(SPACE)).alias("s"))
    for r in rows.collect():
        text = TEXTS[r["i"]]
        want = re.sub(f"(?a:{_SPACE})+", " ", text or "").strip(" ")
        assert r["c"] == want
        assert r["w"] == len(re.findall(r"[^\W_]+(?:['’\-][^\W_]+)*", want))
        if text is not None:
            assert r["n"] == len([w for w in want.split(" ") if w]) and r["s"] == len(re.findall(f"(?a:{_SPACE})", text))


def test_ports(spark):
    ports = {"": "", ":": None, ":443": "", ":0443": "", ":8080": ":8080", ":65535": ":65535", ":65536": None, ":99999": None, ":00001": ":00001", ":9": ":9", ":0": ":0"}
    rows = spark.createDataFrame([(p, f"https://E.com{p}/x") for p in ports], "p string, u string")
    got = {r["p"]: r["s"] for r in rows.select("p", U.split_url(F.col("u")).alias("s")).collect()}
    assert {p: s and s["host"] for p, s in got.items()} == {p: None if h is None else "e.com" + h for p, h in ports.items()}
    # In a lambda a cast of the empty port raises and catches an error for each URL.
    assert "as int" not in U.split_url(F.col("u"))._jc.toString().lower()


LISTS = [
    "<div itemscope itemtype='https://schema.org/Product'><p>a <a href=/x>x</a><a href='/y'>y</a></div><a href=/z>z</a>",
    "<ul><li itemprop=itemListElement><a href=1>1</a><li><a href=2>2</a><li itemprop='itemlistelement'><b><a href=3>3</a></ul>",
    "<script>var item = '<div itemtype=schema.org/product><a href=/s>';</script><!-- item --><p>item</p><a href=/t>t</a>",
    "<div hidden itemprop=itemlistelement><a href=h>h</a><svg><a href=v>v</a></svg></div><br itemprop=itemlistelement><a href=/n>n</a>",
    "<a itemprop=itemlistelement href=own>o</a><DIV ITEMTYPE=schema.org/Product><a href=up>u</a></DIV>", "", None,
]


def test_listing_links_are_those_of_the_walk(spark):
    pages = spark.createDataFrame([(i, "https://e.com/", h) for i, h in enumerate(LISTS)], "page_id long, url string, html string")
    tok = F.col("tok")
    rows = pages.withColumn("tok", H.tokens(F.col("html"))).select(H.tree_walk(tok)["links"].alias("walk"), H.listing_links(tok).alias("listed")).collect()
    assert [r["listed"] for r in rows] == [r["walk"] for r in rows] and sum(len(r["walk"]) for r in rows) >= 5
    alone, both = X.extract_facts(pages, "signals"), X.extract_facts(pages, "signals", "dom")
    assert [r["signals"] for r in alone.collect()] == [r["signals"] for r in both.collect()]
    # Words and hidden roots are not worked out for signals.
    assert "hidden attribute" not in alone._jdf.queryExecution().optimizedPlan().toString()


def test_product_issues_are_computed_once(spark):
    plan = load()[0]["product_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if re.match(r"[\s:|+-]*Filter ", line) and "CASE" in line]


def test_links_in_sql_read_a_page_once(spark):
    plan = load()[0]["sql_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!--(?:.*?-->") == 1
    # The page's own URL is split once, not for each link.
    assert not [line for line in plan.split("\n") if re.match(r"[\s:|+-]*Filter ", line) and "transform(" in line]
    assert "(SELECT" not in Q._links_sql()


def test_duplicate_flags_need_no_reports(spark):
    """Titles, descriptions and headings decide; issues, scores and page types are not worked out for them."""
    rows = A.text_fields(spark.createDataFrame(
        [(1, "https://E.com/a#x", "T", "", []), (2, "https://e.com/a", "u", "", []), (3, "https://e.com/b", " t ", "d", []), (4, "https://e.com/c", "v", "", [])],
        "page_id long, url string, title string, description string, headings array<struct<level:int,text:string>>"))
    flags = {r["page_id"]: r["duplicate_title"] for r in A.annotate_duplicates(rows).collect()}
    # Pages 1 and 2 are one URL, as in the audit rows.
    assert flags == {1: True, 2: True, 3: True, 4: False}
    kept = []
    audits_stored = audits.stored
    audits.stored = lambda df: kept.append(df.columns) or audits_stored(df)
    try:
        for name in ("annotate_duplicates", "duplicate_members"):
            load()[0][name](spark, "/root/testdata/sf0.001")
    finally:
        audits.stored = audits_stored
    assert kept == [["page_id", "url", "available", "title", "description", "h1"]] * 2
