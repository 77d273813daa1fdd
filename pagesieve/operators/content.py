"""Content audits: language, headings, thin text, search-result previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import clean, js_round, keep_true, let, settled
from ..functions.html import word_count

THIN_WORDS = 150
# Preview profiles per device: title px, line px, lines, title font, description font (fixed values).
DEVICES = [("desktop", 580, 600, 2, 20, 14), ("mobile", 560, 360, 3, 18, 13)]
# Character weights in units of the font size; the first class that holds a character counts (fixed values).
WEIGHTS = [
    (r"\s", 32),
    (r"[ilI1|!.,:'`]", 28),
    (r"[mwMW@%&]", 90),
    (r"[A-HJ-LN-VX-ZĄČĘĖĮŠŲŪŽ]", 66),
    (r"[02-9]", 56),
    (r"[\-_/\\()\[\]{}]", 42),
]
DEFAULT_WEIGHT = 54


def normalize_language(value: Column) -> Column:
    return F.lower(F.replace(clean(value), F.lit("_"), F.lit("-")))


def primary_language(value: Column) -> Column:
    return F.substring_index(normalize_language(value), "-", 1)


def valid_language(value: Column) -> Column:
    return normalize_language(value).rlike(r"^[a-z]{2,3}(?:-[a-z0-9]{2,8})*$")


def first_header_language(values: Column) -> Column:
    """First language of a Content-Language header list."""
    first = F.coalesce(F.get(values, F.lit(0)), F.lit(""))
    return normalize_language(F.substring_index(F.substring_index(first, ",", 1), ";", 1))


def language_audit(df: DataFrame) -> DataFrame:
    """HTML language against the header and the self-referencing hreflang tags.

    Needs ``lang``, ``hreflang``, ``base``; uses ``content_language`` when present.
    """
    header = first_header_language(F.col("content_language")) if "content_language" in df.columns else F.lit("")
    page = U.normalize_url(F.col("url"), "raw")
    own = F.filter(
        F.transform(
            F.filter("hreflang", lambda h: U.normalize_url(U.absolute_url(h["ref"], F.col("base")), "raw") == page),
            lambda h: normalize_language(h["lang"]),
        ),
        lambda t: (t != "") & (t != "x-default"),
    )
    out = df.withColumns({"html_lang": normalize_language(F.col("lang")), "header_lang": header, "self_hreflang": own})
    html_lang, head = F.col("html_lang"), F.col("header_lang")
    main = primary_language(html_lang)
    codes = keep_true(
        (html_lang == "", F.lit("missing-html-lang")),
        ((html_lang != "") & ~valid_language(html_lang), F.lit("invalid-html-lang")),
        (
            (html_lang != "") & (head != "") & (main != primary_language(head)),
            F.lit("content-language-mismatch"),
        ),
        (
            (html_lang != "")
            & (F.size("self_hreflang") > 0)
            & ~F.exists("self_hreflang", lambda t: F.substring_index(t, "-", 1) == F.substring_index(F.col("html_lang"), "-", 1)),
            F.lit("self-hreflang-mismatch"),
        ),
    )
    return out.withColumn("language_issues", codes)


def heading_audit(facts: DataFrame) -> DataFrame:
    """Level counts, empty headings, skipped levels and the resulting codes per page."""
    h = F.col("headings")
    level = lambda n: F.size(F.filter(h, lambda x: x["level"] == n))
    jumps = F.filter(
        F.transform(
            h,
            lambda x, i: F.when(
                (i > 0) & (x["level"] > F.get(h, i - 1)["level"] + 1),
                F.struct(F.get(h, i - 1)["level"].alias("from"), x["level"].alias("to"), x["idx"].alias("idx")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    out = facts.select(
        "page_id",
        F.size(h).alias("total"),
        *[level(n).alias(f"h{n}") for n in range(1, 7)],
        F.size(F.filter(h, lambda x: x["text"] == "")).alias("empty"),
        jumps.alias("jumps"),
    )
    codes = keep_true(
        (F.col("h1") == 0, F.lit("missing-h1")),
        (F.col("h1") > 1, F.lit("multiple-h1")),
        (F.col("empty") > 0, F.lit("empty-headings")),
        (F.size("jumps") > 0, F.lit("heading-jumps")),
    )
    return out.withColumn("codes", codes)


def thin_content(df: DataFrame, words: Column, threshold: int = THIN_WORDS) -> DataFrame:
    """Rows whose word count is below the threshold."""
    return df.withColumn("visible_words", words).where(F.col("visible_words") < threshold)


def document_words(documents: DataFrame) -> DataFrame:
    """Word count of plain-text documents."""
    return documents.withColumn("words", word_count(F.col("text")))


def text_width_px(text: Column, font_px: Column | int) -> Column:
    """Estimated width of a text: weighted character counts times the font size."""

    def width(t: Column) -> Column:
        counted = [(F.regexp_count(t, F.lit(rx)), weight) for rx, weight in WEIGHTS]
        rest = F.length(t)
        units = F.lit(0)
        for count, weight in counted:
            rest = rest - count
            units = units + count * weight
        font = font_px if isinstance(font_px, Column) else F.lit(font_px)
        return js_round((units + rest * DEFAULT_WEIGHT) * font / 100.0).cast("int")

    return let(clean(text), width)


def serp(facts: DataFrame) -> DataFrame:
    """Title, description and URL as a result page would show them, per device."""
    device = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(d).alias("device"), F.lit(t).alias("title_max"), F.lit(line).alias("line_px"), F.lit(n).alias("lines"),
                    F.lit(tf).alias("title_font"), F.lit(df).alias("desc_font"),
                )
                for d, t, line, n, tf, df in DEVICES
            ]
        )
    )
    c = F.col
    rows = facts.select(
        "page_id", clean(c("title")).alias("title"), clean(c("description")).alias("description"),
        U.url_breadcrumb(c("url")).alias("breadcrumb"),
    )
    rows = rows.select("*", device.alias("d")).select("page_id", "title", "description", "breadcrumb", "d.*")
    rows = settled(
        rows,
        {"title_px": text_width_px(c("title"), c("title_font")), "description_px": text_width_px(c("description"), c("desc_font"))},
    )
    room = c("line_px") * c("lines")
    return rows.select(
        "page_id",
        "device",
        "breadcrumb",
        "title_px",
        F.greatest(c("title_px") - c("title_max"), F.lit(0)).alias("title_overflow_px"),
        (c("title_px") > c("title_max")).alias("title_truncated"),
        (c("title") == "").alias("title_missing"),
        "description_px",
        F.when(c("description") == "", 0)
        .otherwise(F.greatest(F.lit(1), F.ceil(c("description_px") / c("line_px")).cast("int")))
        .alias("description_lines"),
        F.greatest(c("description_px") - room, F.lit(0)).alias("description_overflow_px"),
        (c("description_px") > room).alias("description_truncated"),
        (c("description") == "").alias("description_missing"),
    )


def word_deltas(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """Raw, rendered and visible word counts per page with their differences."""
    a = raw.select("page_id", F.col("text.all").alias("raw_words"))
    b = rendered.select("page_id", F.col("text.all").alias("rendered_words"), F.col("text.visible").alias("visible_words"))
    return a.join(b, "page_id").withColumns(
        {
            "rendered_delta": F.col("rendered_words") - F.col("raw_words"),
            "hidden_delta": F.col("rendered_words") - F.col("visible_words"),
        }
    )
