"""Timing, asset, image, security and render queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import images as IM
from ..operators import security as SEC
from ..operators import timing as T
from ..plans.audit import with_response
from ..sources.fetch import response_meta
from .facts import IMAGES_SQL, RESOURCES_SQL, SCRIPTS_SQL, STYLES_SQL
from ..sources.io import spread
from .registry import keys, query, table
from .seed import SEED_SQL, fetch_log, seeded_pages


def resource_log(spark, sf_dir):
    """Requests per page from the events table: the user is the page, the type the initiator."""
    pages = keys(spark, sf_dir).select(
        "page_id", F.regexp_replace("url", "#.*$", "").alias("page_url"), F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("origin")
    )
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    e, kind = F.col("event_id"), F.col("event_type")
    s = lambda n: (e % n).cast("string")
    # Whichever side is broadcast or however few bytes are shuffled, the URLs are worked on by all cores.
    rows = spread(ev.join(pages, F.col("user_id") == F.col("page_id")))
    url = (
        F.when(kind == "view", F.concat(F.lit("https://cdn"), s(5), F.lit(".example.net/i/"), s(20), F.lit(".png#x")))
        .when((kind == "click") & (e % 3 == 0), F.lit("https://www.google-analytics.com/ga.js"))
        .when(kind == "click", F.concat("origin", F.lit("/js/"), s(7), F.lit(".js")))
        .when(kind == "purchase", F.concat(F.lit("https://api.segment.io/v1/"), s(4)))
        .when(kind == "signup", F.concat("origin", F.lit("/css/site"), s(8), F.lit(".css")))
        .otherwise(F.concat(F.lit("http://fonts.example.org/f"), s(8), F.lit(".woff2")))
    )
    initiator = (
        F.when(kind == "view", "img").when(kind == "click", "script").when(kind == "purchase", "fetch").when(kind == "signup", "link").otherwise("other")
    )
    return rows.select(
        e.alias("resource_id"), "page_id", "page_url", url.alias("url"), initiator.alias("initiator"), e.cast("double").alias("start_ms"),
        F.col("value").alias("duration_ms"),
        F.when(e % 4 == 0, 0).otherwise(F.floor(F.col("value") * 1000)).cast("bigint").alias("transfer_bytes"),
        F.when(e % 8 == 0, F.floor(F.col("value") * 500)).otherwise(0).cast("bigint").alias("encoded_bytes"),
    )


TIMING_SQL = """
rs AS (
  SELECT event_id AS e, s.p, s.u AS page_url, s.origin, event_type AS t,
    CASE WHEN event_type = 'view' THEN 'https://cdn' || (event_id % 5) || '.example.net/i/' || (event_id % 20) || '.png'
      WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'https://www.google-analytics.com/ga.js' WHEN event_type = 'click' THEN origin || '/js/' || (event_id % 7) || '.js'
      WHEN event_type = 'purchase' THEN 'https://api.segment.io/v1/' || (event_id % 4) WHEN event_type = 'signup' THEN origin || '/css/site' || (event_id % 8) || '.css'
      ELSE 'http://fonts.example.org/f' || (event_id % 8) || '.woff2' END AS url,
    CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'javascript' WHEN 'purchase' THEN 'fetch' WHEN 'signup' THEN 'css' ELSE 'font' END AS kind,
    NOT (event_type = 'signup' OR (event_type = 'click' AND event_id % 3 <> 0)) AS third_party,
    floor(greatest(value, 0) * 10 + 0.5) / 10 AS duration,
    CASE WHEN event_id % 4 <> 0 AND floor(value * 1000) > 0 THEN floor(value * 1000)::BIGINT WHEN event_id % 8 = 0 THEN floor(value * 500)::BIGINT ELSE 0 END AS size
  FROM events JOIN s ON s.p = events.user_id
)"""


def _resources(spark, sf_dir):
    return T.serialize_resources(resource_log(spark, sf_dir))


@query(
    "serialize_resources",
    f"WITH {SEED_SQL}, {TIMING_SQL} SELECT e AS resource_id, p AS page_id, url, kind, third_party, duration AS duration_ms, size AS size_bytes FROM rs",
)
def serialize_resources(spark, sf_dir):
    return _resources(spark, sf_dir).select("resource_id", "page_id", "url", "kind", "third_party", "duration_ms", "size_bytes")


@query(
    "resource_summary",
    f"""WITH {SEED_SQL}, {TIMING_SQL} SELECT p AS page_id, count(*) AS requests, sum(size)::BIGINT AS total_bytes, count(*) FILTER (WHERE size > 0) AS known_sizes, count(*) FILTER (WHERE size = 0) AS unknown_sizes,
        count(*) FILTER (WHERE third_party) AS third_party_count, coalesce(sum(size) FILTER (WHERE third_party), 0)::BIGINT AS third_party_bytes, count(*) FILTER (WHERE kind = 'javascript') AS javascript_count,
        coalesce(sum(size) FILTER (WHERE kind = 'image'), 0)::BIGINT AS image_bytes, count(*) FILTER (WHERE kind = 'font') AS font_count FROM rs GROUP BY p""",
)
def resource_summary(spark, sf_dir):
    return T.resource_summary(_resources(spark, sf_dir)).select(
        "page_id", "requests", "total_bytes", "known_sizes", "unknown_sizes", "third_party_count", "third_party_bytes",
        "javascript_count", "image_bytes", "font_count",
    )


@query(
    "first_resources",
    f"WITH {SEED_SQL}, {TIMING_SQL} SELECT p AS page_id, least(count(*), 1000) AS kept FROM rs GROUP BY p",
)
def first_resources(spark, sf_dir):
    return T.first_resources(_resources(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("kept"))


@query(
    "largest_resources",
    f"WITH {SEED_SQL}, {TIMING_SQL} SELECT p AS page_id, e AS resource_id, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY size DESC, duration DESC, e) AS rk FROM rs WHERE size > 0) WHERE rk <= 20",
)
def largest_resources(spark, sf_dir):
    return T.top_resources(_resources(spark, sf_dir), 20).select("page_id", "resource_id", "rank")


@query(
    "slowest_resources",
    f"WITH {SEED_SQL}, {TIMING_SQL} SELECT p AS page_id, e AS resource_id, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY duration DESC, size DESC, e) AS rk FROM rs WHERE duration > 0) WHERE rk <= 20",
)
def slowest_resources(spark, sf_dir):
    return T.top_resources(_resources(spark, sf_dir), 20, "duration_ms").select("page_id", "resource_id", "rank")


def navigation_log(spark, sf_dir):
    """Navigation timings from the orders table: one navigation per order."""
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    start = (c % 50).cast("double")
    return table(spark, sf_dir, "orders").select(
        k.alias("page_id"),
        start.alias("request_start"),
        (price % 300).alias("response_start"),
        (price % 700).alias("response_end"),
        (c % 11).cast("double").alias("domain_lookup_start"),
        (c % 17).cast("double").alias("domain_lookup_end"),
        (c % 13).cast("double").alias("connect_start"),
        (c % 40).cast("double").alias("connect_end"),
        F.when(k % 3 == 0, (c % 19).cast("double")).otherwise(F.lit(0.0)).alias("secure_connection_start"),
        (price % 900).alias("dom_content_loaded_end"),
        F.when(k % 5 == 0, F.lit(0.0)).otherwise(price % 1500).alias("load_event_end"),
        F.when(k % 2 == 0, F.lit(0.0)).otherwise(price % 2000).alias("duration"),
    )


@query(
    "navigation",
    """WITH n AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS t, (o_custkey % 50)::DOUBLE AS rs FROM orders),
       r AS (SELECT *, CASE WHEN k % 3 = 0 THEN (c % 19)::DOUBLE ELSE 0.0 END AS sec, CASE WHEN k % 5 = 0 THEN 0.0 ELSE t % 1500 END AS le, CASE WHEN k % 2 = 0 THEN 0.0 ELSE t % 2000 END AS du FROM n)
       SELECT k AS page_id, CASE WHEN t % 300 >= rs THEN floor((t % 300 - rs) * 10 + 0.5) / 10 ELSE 0.0 END AS ttfb, CASE WHEN t % 700 >= t % 300 THEN floor((t % 700 - t % 300) * 10 + 0.5) / 10 ELSE 0.0 END AS download,
         greatest(c % 17 - c % 11, 0)::DOUBLE AS dns, greatest(c % 40 - c % 13, 0)::DOUBLE AS connect, CASE WHEN sec > 0 THEN greatest(c % 40 - sec, 0)::DOUBLE ELSE 0.0 END AS tls,
         floor(le * 10 + 0.5) / 10 AS load, floor((CASE WHEN du <> 0 THEN du WHEN le <> 0 THEN le ELSE t % 700 END) * 10 + 0.5) / 10 AS total FROM r""",
)
def navigation(spark, sf_dir):
    return T.navigation(navigation_log(spark, sf_dir)).select("page_id", "ttfb", "download", "dns", "connect", "tls", "load", "total")


# --- assets ---


@query(
    "asset_audit",
    f"""WITH {SCRIPTS_SQL}, {TIMING_SQL}, m AS (SELECT p, url, max(size) AS size FROM rs WHERE kind = 'javascript' GROUP BY p, url)
        SELECT sc.p AS page_id, sc.idx, sc.url, coalesce(m.size, 0) AS size_bytes, m.url IS NOT NULL AS timed FROM sc LEFT JOIN m ON m.p = sc.p AND m.url = sc.url WHERE sc.url <> ''""",
)
def asset_audit(spark, sf_dir):
    sized = T.asset_sizes(X.scripts(seeded_pages(spark, sf_dir)), _resources(spark, sf_dir), "javascript")
    return sized.where("external").select("page_id", "idx", "url", "size_bytes", "timed")


@query(
    "asset_duplicates",
    f"WITH {SCRIPTS_SQL} SELECT p AS page_id, url, count(*) AS uses FROM sc WHERE url <> '' GROUP BY p, url HAVING count(*) > 1",
)
def asset_duplicates(spark, sf_dir):
    return T.asset_duplicates(X.scripts(seeded_pages(spark, sf_dir)))


@query(
    "script_summary",
    f"""WITH {SCRIPTS_SQL} SELECT p AS page_id, count(*) AS total, count(*) FILTER (WHERE url <> '') AS external, count(*) FILTER (WHERE url = '') AS inline, count(*) FILTER (WHERE async_) AS async_scripts,
        count(*) FILTER (WHERE defer_) AS defer_scripts, count(*) FILTER (WHERE type = 'module') AS module_scripts, count(*) FILTER (WHERE third_party) AS third_party FROM sc GROUP BY p""",
)
def script_summary(spark, sf_dir):
    return T.script_summary(X.scripts(seeded_pages(spark, sf_dir))).drop("nomodule_scripts")


@query(
    "script_groups",
    f"""WITH {SCRIPTS_SQL}, {TIMING_SQL}, m AS (SELECT p, url, max(size) AS size FROM rs WHERE kind = 'javascript' GROUP BY p, url)
        SELECT sc.p AS page_id, sc.host, count(*) AS scripts, coalesce(sum(m.size), 0)::BIGINT AS known_bytes FROM sc LEFT JOIN m ON m.p = sc.p AND m.url = sc.url WHERE third_party GROUP BY sc.p, sc.host""",
)
def script_groups(spark, sf_dir):
    sized = T.asset_sizes(X.scripts(seeded_pages(spark, sf_dir)), _resources(spark, sf_dir), "javascript")
    return T.script_groups(sized).drop("known_sizes")


@query(
    "asset_issues",
    f"""WITH {SCRIPTS_SQL}, {STYLES_SQL[len(SEED_SQL) + 1:]}, {TIMING_SQL}, mj AS (SELECT p, url, max(size) AS size FROM rs WHERE kind = 'javascript' GROUP BY p, url), mc AS (SELECT p, url, max(size) AS size FROM rs WHERE kind = 'css' GROUP BY p, url)
        SELECT p AS page_id, 'duplicate-js' AS code, count(*) AS assets FROM (SELECT p, url FROM sc WHERE url <> '' GROUP BY p, url HAVING count(*) > 1) GROUP BY p
        UNION ALL SELECT p, 'duplicate-css', count(*) FROM (SELECT p, url FROM st GROUP BY p, url HAVING count(*) > 1) GROUP BY p
        UNION ALL SELECT sc.p, 'large-js', count(*) FROM sc JOIN mj ON mj.p = sc.p AND mj.url = sc.url WHERE size >= 256000 GROUP BY sc.p
        UNION ALL SELECT st.p, 'large-css', count(*) FROM st JOIN mc ON mc.p = st.p AND mc.url = st.url WHERE size >= 102400 GROUP BY st.p""",
)
def asset_issues(spark, sf_dir):
    pages, log = seeded_pages(spark, sf_dir), _resources(spark, sf_dir)
    return T.asset_issues(T.asset_sizes(X.scripts(pages), log, "javascript"), T.asset_sizes(X.stylesheets(pages), log, "css"))


# --- third parties ---

_CLASS = """CASE WHEN host LIKE '%google-analytics.com' OR host LIKE '%.segment.io' THEN 'analytics' WHEN host LIKE 'cdn.%' OR host LIKE '%.cdn.%' THEN 'cdn' ELSE 'other' END"""
GROUPS_SQL = f"""
tp AS (SELECT *, {_CLASS} AS category FROM (SELECT p, regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS requests, sum(size)::BIGINT AS known_bytes, count(*) FILTER (WHERE size > 0) AS known_sizes,
         sum(duration) AS duration FROM rs WHERE third_party GROUP BY 1, 2))"""


@query(
    "third_party",
    f"WITH {SEED_SQL}, {TIMING_SQL}, {GROUPS_SQL} SELECT p AS page_id, host, category, requests, known_bytes, known_sizes, round(duration, 1) AS duration_ms FROM tp",
)
def third_party(spark, sf_dir):
    rows = T.third_party(_resources(spark, sf_dir))
    return rows.select("page_id", "host", "category", "requests", "known_bytes", "known_sizes", F.round("duration_ms", 1).alias("duration_ms"))


@query(
    "third_party_categories",
    f"WITH {SEED_SQL}, {TIMING_SQL}, {GROUPS_SQL} SELECT category, count(DISTINCT host) AS domains, sum(requests)::BIGINT AS requests, sum(known_bytes)::BIGINT AS known_bytes, sum(known_sizes)::BIGINT AS known_sizes FROM tp GROUP BY category",
)
def third_party_categories(spark, sf_dir):
    return T.category_summary(T.third_party(_resources(spark, sf_dir)))


@query(
    "third_party_totals",
    f"WITH {SEED_SQL}, {TIMING_SQL}, {GROUPS_SQL} SELECT count(DISTINCT host) AS domains, sum(requests)::BIGINT AS requests, sum(known_bytes)::BIGINT AS known_bytes, sum(known_sizes)::BIGINT AS known_sizes FROM tp",
)
def third_party_totals(spark, sf_dir):
    return T.third_party_totals(T.third_party(_resources(spark, sf_dir)))


@query(
    "third_party_types",
    f"WITH {SEED_SQL}, {TIMING_SQL} SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, kind, count(*) AS requests FROM rs WHERE third_party GROUP BY ALL",
)
def third_party_types(spark, sf_dir):
    return T.third_party_types(_resources(spark, sf_dir))


@query(
    "third_party_samples",
    f"""WITH {SEED_SQL}, {TIMING_SQL}, f AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url, min(e) AS first FROM rs WHERE third_party GROUP BY ALL)
        SELECT host, url, rk::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY first, url) AS rk FROM f) WHERE rk <= 5""",
)
def third_party_samples(spark, sf_dir):
    return T.third_party_samples(_resources(spark, sf_dir)).select("host", "url", "rank")


# --- render hints from the lineitem table: one box per line, one page per order ---


def element_boxes(spark, sf_dir):
    n = F.col("l_linenumber")
    tags = F.array(*[F.lit(t) for t in ("img", "video", "h1", "h2", "p", "iframe", "img")])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), n.alias("idx"), F.element_at(tags, (n % 7 + 1).cast("int")).alias("tag"),
        (F.col("l_quantity") * 40 - 100).alias("top"), (F.col("l_discount") * 1000 - 20).alias("left"),
        (F.col("l_extendedprice") % 900).alias("width"), (F.col("l_tax") * 5000).alias("height"),
        F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"),
        F.when(F.col("l_returnflag") == "A", "lazy").otherwise("").alias("loading"), (F.col("l_linestatus") == "O").alias("reserved"),
    )


BOXES_SQL = """
bx0 AS (SELECT l_orderkey AS p, l_linenumber AS idx, ['img', 'video', 'h1', 'h2', 'p', 'iframe', 'img'][l_linenumber % 7 + 1] AS tag, l_quantity * 40 - 100 AS top_, l_discount * 1000 - 20 AS left_,
   l_extendedprice % 900 AS w, l_tax * 5000 AS h, l_quantity::INT AS chars, l_returnflag = 'A' AS lazy, l_linestatus = 'O' AS reserved FROM lineitem),
bx AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 THEN 'hidden' WHEN top_ + h <= 0 THEN 'above' WHEN top_ < 720 THEN 'above-fold' WHEN top_ >= 1080 THEN 'below-fold' ELSE 'near-fold' END AS zone FROM bx0),
bv AS (SELECT *, CASE WHEN zone = 'above-fold' THEN greatest(0, least(left_ + w, 1280) - greatest(left_, 0)) * greatest(0, least(top_ + h, 720) - greatest(top_, 0)) ELSE 0.0 END AS area FROM bx)"""


@query(
    "render_hints",
    f"""WITH {BOXES_SQL} SELECT p AS page_id, idx, zone, tag = 'img' AND NOT reserved AS missing_dimensions, tag = 'img' AND zone = 'above-fold' AND lazy AS above_fold_lazy,
        tag = 'img' AND zone = 'below-fold' AND NOT lazy AND w * h >= 10000 AS below_fold_eager, tag IN ('img', 'video', 'iframe') AND w > 0 AND h > 0 AND NOT reserved AS cls_risk, round(area, 2) AS visible_area FROM bv""",
)
def render_hints(spark, sf_dir):
    return T.render_hints(element_boxes(spark, sf_dir)).select(
        "page_id", "idx", "zone", "missing_dimensions", "above_fold_lazy", "below_fold_eager", "cls_risk", F.round("visible_area", 2).alias("visible_area")
    )


@query(
    "lcp_candidates",
    f"""WITH {BOXES_SQL} SELECT p AS page_id, idx, tag FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY area DESC, list_position(['img', 'video', 'h1', 'h2', 'p'], tag), idx) AS rk
        FROM bv WHERE tag <> 'iframe' AND area > 0 AND (tag IN ('img', 'video') OR chars >= 20)) WHERE rk = 1""",
)
def lcp_candidates(spark, sf_dir):
    return T.lcp_candidates(T.render_hints(element_boxes(spark, sf_dir))).select("page_id", "idx", "tag")


@query(
    "render_blocking",
    f"""WITH {SCRIPTS_SQL}, {STYLES_SQL[len(SEED_SQL) + 1:]} SELECT p AS page_id, 'script' AS type, url FROM sc WHERE url <> '' AND NOT async_ AND NOT defer_ AND type <> 'module'
        UNION ALL SELECT p, 'stylesheet', url FROM st WHERE media <> 'print'""",
)
def render_blocking(spark, sf_dir):
    pages = seeded_pages(spark, sf_dir)
    return T.render_blocking(X.scripts(pages), X.stylesheets(pages))


@query(
    "font_hints",
    f"""WITH {SEED_SQL}, {TIMING_SQL} SELECT p AS page_id, count(*) AS fonts, 0::BIGINT AS preloaded FROM rs WHERE kind = 'font' GROUP BY p""",
)
def font_hints(spark, sf_dir):
    rows = T.font_hints(_resources(spark, sf_dir), X.resource_hints(seeded_pages(spark, sf_dir)))
    return rows.groupBy("page_id").agg(F.count("*").alias("fonts"), F.count_if("preloaded").alias("preloaded"))


@query(
    "hint_issues",
    f"""WITH {SCRIPTS_SQL}, {STYLES_SQL[len(SEED_SQL) + 1:]}, {BOXES_SQL}, f AS (
        SELECT p, 'image-dimensions' AS code FROM bv WHERE tag = 'img' AND NOT reserved UNION ALL SELECT p, 'cls-risk' FROM bv WHERE tag IN ('img', 'video', 'iframe') AND w > 0 AND h > 0 AND NOT reserved
        UNION ALL SELECT p, 'above-fold-lazy' FROM bv WHERE tag = 'img' AND zone = 'above-fold' AND lazy UNION ALL SELECT p, 'below-fold-eager' FROM bv WHERE tag = 'img' AND zone = 'below-fold' AND NOT lazy AND w * h >= 10000
        UNION ALL SELECT p, 'render-blocking' FROM sc WHERE url <> '' AND NOT async_ AND NOT defer_ AND type <> 'module' UNION ALL SELECT p, 'render-blocking' FROM st WHERE media <> 'print')
        SELECT p AS page_id, code, count(*) AS elements FROM f GROUP BY ALL""",
)
def hint_issues(spark, sf_dir):
    pages = seeded_pages(spark, sf_dir)
    blocking = T.render_blocking(X.scripts(pages), X.stylesheets(pages))
    return T.hint_issues(T.render_hints(element_boxes(spark, sf_dir)), blocking, X.resource_hints(pages))


# --- images ---


def image_results(spark, sf_dir):
    """Network results for the first image of each page: a stale one and the current one."""
    p = F.col("page_id")
    images = X.images(seeded_pages(spark, sf_dir)).where("idx = 0").select("page_id", F.col("src").alias("url"))
    fresh = images.select(
        "url",
        F.when(p % 10 == 1, 404).when(p % 10 == 2, 0).when(p % 10 == 3, 304).otherwise(200).alias("status"),
        (p % 10 == 4).alias("redirected"), F.col("url").alias("final_url"), F.when(p % 10 == 2, "timeout").otherwise("").alias("error"),
        F.when(p % 2 == 0, "image/WebP; q=1").otherwise("").alias("content_type"), ((p * 9973) % 900000).alias("size_bytes"), F.lit(2).alias("checked_at"),
    )
    stale = fresh.withColumns({"status": F.lit(500), "size_bytes": F.lit(1).cast("bigint"), "checked_at": F.lit(1)})
    return fresh.unionByName(stale)


def rendered_images(spark, sf_dir):
    p = F.col("page_id")
    return X.images(seeded_pages(spark, sf_dir)).withColumns(
        {
            "natural_width": (p % 7) * 400, "natural_height": (p % 5) * 300, "rendered_width": (p % 4) * 100, "rendered_height": (p % 3 + 1) * 60,
        }
    )


WASTE_SQL = (
    IMAGES_SQL
    + """,
ia0 AS (SELECT p, idx, idx = 0 AS checked, CASE WHEN idx = 0 THEN (p * 9973) % 900000 ELSE 0 END AS size,
   CASE WHEN idx > 0 THEN 'unknown' WHEN p % 10 IN (1, 2) THEN 'critical' WHEN p % 10 IN (3, 4) THEN 'warning' ELSE 'ok' END AS level,
   CASE WHEN idx = 0 AND p % 2 = 0 THEN 'WebP' ELSE 'PNG' END AS format, ((p % 7) * 400 * (p % 5) * 300)::DOUBLE AS sp, ((p % 4) * 100 * (p % 3 + 1) * 60)::DOUBLE AS tp FROM img),
ia1 AS (SELECT *, size > 0 AND sp > 0 AND tp > 0 AS known FROM ia0),
ia2 AS (SELECT *, CASE WHEN known THEN floor(size * least(1.0, tp / sp) + 0.5)::BIGINT ELSE size END AS needed FROM ia1),
ia AS (SELECT *, greatest(0, size - needed) AS waste, known AND sp / tp > 1.5 AND size - needed >= 10240 AS oversized FROM ia2)"""
)


def _images(spark, sf_dir):
    return IM.image_audit(rendered_images(spark, sf_dir), image_results(spark, sf_dir))


@query(
    "image_audit",
    f"WITH {WASTE_SQL} SELECT p AS page_id, idx, format, level, size AS size_bytes, needed AS needed_bytes, waste AS waste_bytes, oversized FROM ia",
)
def image_audit(spark, sf_dir):
    return _images(spark, sf_dir).select("page_id", "idx", "format", "level", "size_bytes", "needed_bytes", "waste_bytes", "oversized")


@query(
    "image_counts",
    f"""WITH {WASTE_SQL} SELECT p AS page_id, count(*) AS total, count(*) FILTER (WHERE checked) AS checked, count(*) FILTER (WHERE level = 'critical') AS broken, count(*) FILTER (WHERE level = 'warning') AS redirect,
        count(*) FILTER (WHERE oversized) AS oversized, count(*) FILTER (WHERE size = 0) AS unknown_size, sum(size)::BIGINT AS total_bytes, sum(waste)::BIGINT AS waste_bytes FROM ia GROUP BY p""",
)
def image_counts(spark, sf_dir):
    return IM.image_counts(_images(spark, sf_dir))


@query(
    "image_ranking",
    f"WITH {WASTE_SQL} SELECT p AS page_id, idx, waste AS waste_bytes FROM ia ORDER BY waste DESC, size DESC, p, idx LIMIT 50",
)
def image_ranking(spark, sf_dir):
    return IM.image_ranking(_images(spark, sf_dir), 50).select("page_id", "idx", "waste_bytes")


@query(
    "image_size_issues",
    f"WITH {WASTE_SQL} SELECT p AS page_id, 'images.fileSize' AS id, 'warning' AS severity, count(*) AS images FROM ia WHERE size > 524288 GROUP BY p",
)
def image_size_issues(spark, sf_dir):
    return IM.image_size_issues(_images(spark, sf_dir))


# --- security ---


def _headers(spark, sf_dir):
    pages = keys(spark, sf_dir)
    return SEC.security_headers(with_response(pages, fetch_log(spark, sf_dir)))


_H = """
hd AS (SELECT p, u, scheme = 'https' AS https,
   CASE p % 6 WHEN 0 THEN 'review' WHEN 1 THEN 'present' ELSE 'missing' END AS csp,
   CASE WHEN scheme <> 'https' THEN 'not-applicable' WHEN p % 5 = 0 THEN 'present' WHEN p % 5 = 1 THEN 'review' ELSE 'missing' END AS hsts,
   CASE WHEN p % 7 = 0 THEN 'present' WHEN p % 7 = 1 THEN 'review' WHEN p % 6 = 1 THEN 'covered' ELSE 'missing' END AS xfo,
   CASE p % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'review' ELSE 'missing' END AS referrer,
   CASE WHEN p % 2 = 0 THEN 'present' ELSE 'missing' END AS permissions,
   CASE p % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'review' ELSE 'missing' END AS xcto FROM s),
hr AS (SELECT p, u, https, key, state, CASE
     WHEN key = 'csp' AND state = 'missing' THEN 'missing-csp' WHEN key = 'csp' AND state = 'review' THEN 'csp-broad-script-policy'
     WHEN key = 'hsts' AND state = 'missing' THEN 'missing-hsts' WHEN key = 'hsts' AND state = 'review' THEN 'weak-hsts'
     WHEN key = 'xfo' AND state = 'missing' THEN 'missing-frame-protection' WHEN key = 'xfo' AND state = 'review' THEN 'invalid-x-frame-options'
     WHEN key = 'referrer' AND state = 'missing' THEN 'missing-referrer-policy' WHEN key = 'referrer' AND state = 'review' THEN 'unsafe-referrer-policy'
     WHEN key = 'xcto' AND state = 'missing' THEN 'missing-nosniff' WHEN key = 'xcto' AND state = 'review' THEN 'invalid-nosniff' END AS code
   FROM hd UNPIVOT (state FOR key IN (csp, hsts, xfo, referrer, permissions, xcto)))"""


@query("security_headers", f"WITH {SEED_SQL}, {_H} SELECT p AS page_id, key, state, coalesce(code, '') AS code FROM hr")
def security_headers(spark, sf_dir):
    return SEC.header_rows(_headers(spark, sf_dir), "page_id").select("page_id", "key", "state", F.coalesce("code", F.lit("")).alias("code"))


MIXED_SQL = f"""{TIMING_SQL},
mx AS (SELECT p, url, kind, bool_or(active) AS active FROM (
   SELECT dr.p, dr.url, dr.kind, dr.active FROM dr UNION ALL SELECT p, url, kind, kind NOT IN ('image', 'media') FROM rs) x JOIN (SELECT p FROM s WHERE scheme = 'https') h USING (p) WHERE url LIKE 'http:%' GROUP BY p, url, kind)"""


def _mixed(spark, sf_dir):
    dom = X.dom_resources(seeded_pages(spark, sf_dir), insecure=True).select("page_id", "page_url", "url", "kind", "active")
    return SEC.mixed_content(dom.unionByName(SEC.timing_candidates(_resources(spark, sf_dir))))


@query("mixed_content", f"WITH {RESOURCES_SQL}, {MIXED_SQL} SELECT p AS page_id, url, kind, active FROM mx")
def mixed_content(spark, sf_dir):
    return _mixed(spark, sf_dir)


@query(
    "mixed_sample",
    f"WITH {RESOURCES_SQL}, {MIXED_SQL} SELECT p AS page_id, url, rk::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY active DESC, url, kind) AS rk FROM mx) WHERE rk <= 50",
)
def mixed_sample(spark, sf_dir):
    return SEC.mixed_sample(_mixed(spark, sf_dir)).select("page_id", "url", "rn")


@query(
    "third_party_scripts",
    f"WITH {SCRIPTS_SQL} SELECT p AS page_id, count(*) AS scripts, count(DISTINCT host) AS hosts, min(host) AS first_host FROM sc WHERE third_party GROUP BY p",
)
def third_party_scripts(spark, sf_dir):
    return SEC.third_party_scripts(X.scripts(seeded_pages(spark, sf_dir)))


@query(
    "security_audit",
    f"""WITH {RESOURCES_SQL}, {MIXED_SQL}, {_H} SELECT p AS page_id, code, 'warning' AS severity FROM hr WHERE code IS NOT NULL
        UNION ALL SELECT p, 'page-not-https', 'critical' FROM s WHERE scheme <> 'https' UNION ALL SELECT DISTINCT p, 'active-mixed-content', 'critical' FROM mx WHERE active
        UNION ALL SELECT DISTINCT p, 'passive-mixed-content', 'warning' FROM mx WHERE NOT active""",
)
def security_audit(spark, sf_dir):
    return SEC.security_issues(_headers(spark, sf_dir), _mixed(spark, sf_dir))
