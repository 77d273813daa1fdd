import random

from pyspark.sql import functions as F

from pagesieve.operators import audit_table as A
from pagesieve.operators import canonicals, crawl, links as L, sitemaps, snapshots as SN
from pagesieve.session import bucketed


def nodes(spark, rows):
    full = [(i, u, n, 1, s, False, 0, e) for i, (u, n, s, e) in enumerate(rows)]
    return spark.createDataFrame(
        full, "page_id long, norm_url string, norm_canonical string, canonical_count int, status int, redirected boolean, hops int, error string"
    )


def chain(spark, rows):
    walk = canonicals.canonical_walk(nodes(spark, rows))
    return {r["page_id"]: r.asDict(True) for r in canonicals.canonical_chain(walk).collect()}


def test_chain_outcomes(spark):
    got = chain(
        spark,
        [("a", "b", 200, ""), ("b", "c", 200, ""), ("c", "c", 200, ""), ("x", "y", 200, ""), ("y", "x", 200, ""), ("m", "gone", 200, ""), ("e", "f", 200, ""), ("f", "f", 404, "")],
    )
    assert got[0]["path"] == ["a", "b", "c"] and got[0]["stable"] and got[0]["codes"] == ["multi-hop-canonical"]
    assert got[2]["path"] == ["c"] and got[2]["stable"] and got[2]["codes"] == []
    assert got[3]["loop"] and "canonical-loop" in got[3]["codes"] and not got[3]["stable"]
    assert got[5]["codes"] == ["network-error"]
    assert got[6]["codes"] == ["http-4xx"] and got[6]["final_status"] == 404


def test_chain_cap(spark):
    rows = [(f"u{i}", f"u{i + 1}", 200, "") for i in range(9)]
    got = chain(spark, rows)
    assert got[0]["capped"] and got[0]["levels"] == 5 and "canonical-cap" in got[0]["codes"]


def test_crawl_budget_and_first_source(spark):
    edges = spark.createDataFrame([("s", "a", 1), ("s", "b", 0), ("a", "c", 0), ("b", "c", 5), ("c", "s", 0), ("b", "d", 1)], "source string, url string, idx int")
    seeds = spark.createDataFrame([("s",)], "url string")
    rows = {r["url"]: (r["depth"], r["source"]) for r in crawl.crawl(edges, seeds, depth_limit=3).collect()}
    # b comes before a (link order), so b is the first source of c.
    assert rows == {"s": (0, ""), "a": (1, "s"), "b": (1, "s"), "c": (2, "b"), "d": (2, "b")}
    few = {r["url"] for r in crawl.crawl(edges, seeds, depth_limit=3, url_limit=3).collect()}
    assert few == {"s", "a", "b"}
    assert crawl.crawl(edges, seeds, depth_limit=0).count() == 1


def walked(rows, max_levels):
    """Each page's walk, one step after the other."""
    first, out = {}, {}
    for i, (u, n, s, e) in enumerate(rows):
        first.setdefault(u, (n, s, e))
    for i, (u, n, s, e) in enumerate(rows):
        if not n:
            continue
        at, visited, levels, loop, capped = n, [u], [], False, True
        while max_levels is None or len(levels) < max_levels:
            nxt, status, error = first.get(at, ("", 0, "network"))
            levels.append(at)
            visited.append(at)
            if error or status == 0 or status >= 400 or not nxt or nxt == at:
                capped = False
                break
            if nxt in visited:
                loop, capped = True, False
                break
            at = nxt
        out[i] = (levels, loop, capped)
    return out


def test_walks_like_step_by_step(spark):
    r = random.Random(5)
    for size in (6, 25):
        rows = [(f"u{r.randrange(size)}" if r.random() < 0.2 else f"u{i}", f"u{r.randrange(size + 2)}" if r.random() < 0.9 else "", 404 if r.random() < 0.08 else 200, "x" if r.random() < 0.05 else "") for i in range(size)]
        for limit in (1, 2, 3, 5, None):
            got = {x["page_id"]: ([s["url"] for s in x["levels"]], x["loop"], x["capped"]) for x in canonicals.canonical_walk(nodes(spark, rows), limit).collect()}
            assert got == walked(rows, limit), (rows, limit)


def test_a_page_that_names_itself_keeps_its_response(spark):
    """Two pages share u0 and u1; each names itself but for the first of u0."""
    rows = nodes(spark, [("u0", "u2", 200, ""), ("u0", "u0", 404, ""), ("u1", "u1", 200, ""), ("u1", "u1", 200, "timeout"), ("u2", "u2", 200, ""), ("u3", "u0", 200, ""), ("u4", "", 200, ""), ("u5", "gone", 200, "")])
    walk = canonicals.canonical_walk(rows, own=True)
    got = {r["page_id"]: (r["path"], r["stable"], list(r["codes"])) for r in canonicals.canonical_chain(walk).collect()}
    assert got == {
        0: (["u0", "u2"], True, []), 1: (["u0"], False, ["http-4xx"]), 2: (["u1"], True, []), 3: (["u1"], False, ["network-error"]),
        4: (["u2"], True, []), 5: (["u3", "u0", "u2"], True, ["multi-hop-canonical"]), 7: (["u5", "gone"], False, ["network-error"]),
    }


def test_a_failed_target_adds_nothing_to_the_path(spark):
    got = chain(spark, [("a", "b", 200, ""), ("b", "a", 404, ""), ("c", "d", 200, ""), ("d", "e", 200, "timeout"), ("f", "g", 200, ""), ("g", "h", 0, "")])
    assert [(got[i]["path"], got[i]["codes"], got[i]["loop"]) for i in (0, 2, 4)] == [
        (["a", "b"], ["http-4xx"], False), (["c", "d"], ["network-error"], False), (["f", "g"], ["missing-status"], False)]


def test_long_chains_and_loops_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(canonicals, "stored", lambda df, label, f=canonicals.stored: rounds.append(label) or f(df, label))
    chain_ = [(f"c{i}", f"c{i + 1}", 200, "") for i in range(1000)] + [("c1000", "c1000", 200, "")]
    loop = [(f"l{i}", f"l{(i + 1) % 300}", 200, "") for i in range(300)]
    got = {x["page_id"]: x for x in canonicals.canonical_walk(nodes(spark, chain_ + loop), None).select("page_id", F.size("levels").alias("n"), "loop", "capped").collect()}
    assert len(rounds) <= 12  # the first writing and eleven rounds
    assert [got[i]["n"] for i in (0, 1, 999, 1000)] == [1000, 999, 1, 1] and not got[0]["loop"]
    assert all(got[1001 + i]["loop"] and got[1001 + i]["n"] == 299 for i in range(300)) and not any(x["capped"] for x in got.values())


def test_crawl_like_step_by_step(spark):
    r = random.Random(7)
    links = {(f"p{r.randrange(60)}", f"p{r.randrange(70)}") for _ in range(110)}
    order = {}
    edges = []
    for s, u in sorted(links):
        order[s] = order.get(s, -1) + 1
        edges.append((s, u, order[s]))
    frame = spark.createDataFrame(edges, "source string, url string, idx int")
    seeds = spark.createDataFrame([("p1",), ("p2",)], "url string")
    known = spark.createDataFrame([(f"p{i}",) for i in range(55)], "url string")
    for depth_limit, url_limit, pages in ((None, None, None), (2, None, known), (3, 12, known), (None, 7, None)):
        visited, now, depth = {"p1": ("", 0), "p2": ("", 0)}, ["p1", "p2"], 0
        while now and (depth_limit is None or depth < depth_limit):
            fresh = []
            for s in now:
                for _, u, _ in sorted((e for e in edges if e[0] == s), key=lambda e: e[2]):
                    if u not in visited and (pages is None or int(u[1:]) < 55) and (url_limit is None or len(visited) < url_limit):
                        visited[u] = (s, depth + 1)
                        fresh.append(u)
            now, depth = fresh, depth + 1
        left_out = {s for s, u, _ in edges if s in visited and u not in visited and (pages is None or int(u[1:]) < 55)}
        got = {x["url"]: (x["source"], x["depth"], x["capped"]) for x in crawl.crawl(frame, seeds, depth_limit, url_limit, pages).collect()}
        assert got == {u: (*v, u in left_out) for u, v in visited.items()}


def test_crawl_moves_neither_edges_nor_visited(spark):
    edges = spark.createDataFrame([(f"a{i}", f"a{i + 1}", 0) for i in range(50)], "source string, url string, idx int")
    kept, _ = bucketed(edges, "edges_", "source")
    seen, name = bucketed(spark.createDataFrame([("a1", 0)], "url string, rank long"), "seen_", "url")
    seen, _ = bucketed(spark.createDataFrame([("a2", 1)], "url string, rank long"), "seen_", "url", into=name)
    found = seen.select(F.col("url").alias("source"), "rank").join(kept, "source").select("url", "source", "rank", "idx")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = crawl.next_frontier(found, seen, None)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The links found are dealt out by URL; the tables on both sides are read as they lie.
    assert plan.count("Exchange") == 1 and {r["url"] for r in crawl.next_frontier(found, seen, None).collect()} == {"a3"}


def test_crawl_options(value):
    assert value(crawl.clamp_int(F.lit("2.5"), 9, 0, 3)) == 3
    assert value(crawl.clamp_int(F.lit("x"), 9, 0, 3)) == 9


def test_sitemap_parsing(spark):
    text = "﻿<s:urlset><s:url><loc><![CDATA[ /a?x=1&y=2#f ]]></loc></s:url><url><loc>https://o.com/&#233;&amp;</loc><lastmod>2024</lastmod></url><url></url></s:urlset>"
    docs = spark.createDataFrame([("https://e.com/s.xml", text)], "sitemap_url string, text string")
    rows = sorted((r["pos"], r["loc"], r["lastmod"]) for r in sitemaps.sitemap_entries(docs).collect())
    assert rows == [(0, "https://e.com/a?x=1&y=2", ""), (1, "https://o.com/%C3%A9&", "2024")]
    assert [r["message"] for r in sitemaps.sitemap_warnings(docs).collect()] == ["A URL entry is missing loc."]


def test_results_and_first_occurrence(spark):
    links = spark.createDataFrame(
        [(1, 0, "http", True, "https://e.com/a", "Here"), (1, 1, "http", False, "https://e.com/a", "x"), (1, 2, "http", True, "https://e.com/b", ""), (1, 3, "mailto", False, "", "m")],
        "page_id long, idx int, kind string, internal boolean, norm string, label string",
    )
    results = spark.createDataFrame(
        [("https://e.com/a", 200, False, "", "", 1), ("https://e.com/a#z", 301, False, "", "", 2), ("https://e.com/b", 0, False, "", "timeout", 1)],
        "url string, status int, redirected boolean, final_url string, error string, checked_at int",
    )
    row = L.link_summary(links, results).first().asDict()
    assert row == {"page_id": 1, "checked": 2, "ok": 0, "redirect": 1, "broken": 0, "unknown": 1, "internal_redirect": 1}
    assert L.anchor_summary(links).first().asDict() == {"page_id": 1, "http_links": 3, "generic": 1, "empty": 1}


def test_duplicate_groups_with_a_hot_value(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://e.com/"), F.col("id").cast("string")).alias("url"), F.lit(True).alias("available"),
        F.when(F.col("id") % 3 == 0, " Same  Title ").otherwise(F.col("id").cast("string")).alias("title"), F.lit("").alias("description"), F.lit("").alias("h1"),
    )
    groups = A.duplicate_groups(rows).collect()
    assert [(g["field"], g["key"], g["pages"]) for g in groups] == [("title", "same title", 1000)]
    assert A.annotate_duplicates(rows).where("duplicate_title").count() == 1000


def test_filters_and_sort(spark):
    rows = spark.createDataFrame(
        [("https://e.com/b", 404, True, False, 1, 0.5, "Ä Title"), ("https://e.com/a", 200, True, True, 0, 0.5, "x")],
        "url string, status int, available boolean, redirected boolean, issue_count int, score double, title string",
    )
    for c in ("description", "h1", "canonical", "robots", "page_type", "page_traits"):
        rows = rows.withColumn(c, F.lit(""))
    assert [r["url"] for r in A.filter_audit(rows, errors_only=True).collect()] == ["https://e.com/b"]
    assert A.filter_audit(rows, query="  ä   TITLE ").count() == 1
    assert [r["url"] for r in A.sort_audit(rows, "score", "desc").collect()] == ["https://e.com/a", "https://e.com/b"]


def test_retention_uses_map_side_limit(spark):
    h = spark.range(1000).select((F.col("id") % 2).cast("string").alias("url"), F.col("id").cast("string").alias("id"), F.timestamp_seconds("id").alias("created_at"))
    kept = SN.newest(h, 50)
    assert kept.count() == 100 and kept.agg(F.min(F.unix_timestamp("created_at"))).first()[0] == 900
    assert kept._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
