"""SQL functions give what their Column builders give, and are no calls in a plan."""

from pyspark.sql import functions as F

from pagesieve.functions import html as H
from pagesieve.functions import sql as Q
from pagesieve.functions import urls as U
from pagesieve.operators import extract as X

URLS = ["HTTP://Example.COM:80/a/../b?x=1#f", "https://münchen.de/ä", "http://0x7f.1/", "not a url", "", "mailto:a@b", None, "https://e.com/list/page/3?utm_source=x&color='red'\\"]


def test_like_the_builders(spark):
    names = Q.register(spark)
    assert {"normalize_url", "url_host", "classify_param", "word_count", "page_links"} <= set(names)
    spark.createDataFrame([(u, "https://base.example/x/y?z") for u in URLS], "u string, base_url string").createOrReplaceTempView("urls_")
    got = spark.sql("SELECT normalize_url(u) a, http_url(u) b, url_host(u) c, url_origin(u) d, resolve_url(u, base_url) e, classify_param(u) f, pagination_family(u) g, word_count(u) h FROM urls_")
    u = F.col("u")
    want = spark.table("urls_").withColumn("base", U.split_url(F.col("base_url"))).select(
        U.normalize_url(u, browser=True).alias("a"), U.http_url(u, browser=True).alias("b"), U.url_host(u, browser=True).alias("c"), U.url_origin(u, browser=True).alias("d"),
        U.absolute_url(u, F.col("base"), browser=True).alias("e"), U.classify_param(u).alias("f"), U.pagination_family_key(u).alias("g"), H.word_count(u).alias("h"))
    assert got.collect() == want.collect()
    assert got.columns == list("abcdefgh")


def test_links_in_plain_sql(spark):
    Q.register(spark)
    pages = spark.createDataFrame([(1, "https://EX.com/a/", "<a href='b'>x y</a><a href='//münchen.de/?q=1'>z</a><a>no</a><a href='mailto:x'>m</a>"), (2, "https://e.com", ""), (3, None, None)], "page_id long, url string, html string")
    pages.createOrReplaceTempView("pages_")
    df = spark.sql("SELECT page_id, inline(links) FROM (SELECT page_id, page_links(url, html) AS links FROM pages_)")
    want = X.links(pages).select("page_id", "idx", "href", "raw_href", "label", "kind")
    assert sorted(df.collect()) == sorted(want.collect()) and df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Exchange" not in plan and "page_links(" not in plan


def test_text_of_columns_is_sql(spark):
    odd = F.when((F.col("a") + 1 >= 2) & ~F.col("b").isin("it's", "x(y)", "back\\slash"), F.concat(F.lit("a(b"), F.col("b"))).otherwise(F.lit(None).cast("string"))
    df = spark.createDataFrame([(1, "it's"), (1, "q"), (0, "q"), (5, "x(y)"), (5, "z\\")], "a int, b string")
    df.createOrReplaceTempView("odd_")
    assert [r[0] for r in spark.sql(f"SELECT {Q.to_sql(odd)} FROM odd_").collect()] == [r[0] for r in df.select(odd).collect()] == [None, "a(bq", None, None, "a(bz\\"]
