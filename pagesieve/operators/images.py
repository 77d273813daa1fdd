"""Image audits: format, network state, waste."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import js_round, let, settled
from ..sources.fetch import latest

# Content types and file endings by format (fixed values).
TYPES = {
    "image/jpeg": "JPEG", "image/jpg": "JPEG", "image/png": "PNG", "image/webp": "WebP", "image/avif": "AVIF", "image/gif": "GIF",
    "image/svg+xml": "SVG", "image/bmp": "BMP", "image/tiff": "TIFF", "image/x-icon": "ICO", "image/vnd.microsoft.icon": "ICO",
}
ENDINGS = {
    r"\.jpe?g$": "JPEG", r"\.png$": "PNG", r"\.webp$": "WebP", r"\.avif$": "AVIF", r"\.gif$": "GIF", r"\.svgz?$": "SVG",
    r"\.bmp$": "BMP", r"\.tiff?$": "TIFF", r"\.ico$": "ICO",
}


def image_format(content_type: Column, url: Column) -> Column:
    """Format from the content type, else from the file ending, else 'Unknown'."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    by_type = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in TYPES.items()])

    def by_path(parts: Column) -> Column:
        path = F.lower(parts["path"])
        return F.coalesce(*[F.when(path.rlike(rx), F.lit(v)) for rx, v in ENDINGS.items()])

    return F.coalesce(by_type, let(U.split_url(url), by_path), F.lit("Unknown"))


def bytes_label(value: Column) -> Column:
    """Readable size; zero or unknown is a dash."""
    kb, mb = value / 1024.0, value / (1024.0 * 1024.0)
    return (
        F.when(F.coalesce(value, F.lit(0)) == 0, F.lit("—"))
        .when(value < 1024, F.concat(value.cast("string"), F.lit(" B")))
        .when(value < 102400, F.concat(fixed(kb, 1), F.lit(" KB")))
        .when(value < 1024 * 1024, F.concat(fixed(kb, 0), F.lit(" KB")))
        .otherwise(F.concat(fixed(mb, 2), F.lit(" MB")))
    )


def fixed(value: Column, digits: int) -> Column:
    """Decimal text with so many digits, halves up; the value counts as stored, not as printed."""
    unit = 10**digits
    return F.format_string(f"%.{digits}f", F.floor(value.cast("double") * unit + 0.5) / unit)


def transfer_label(value: Column) -> Column:
    """Readable size of a transfer; zero or unknown is 0 B."""
    n = F.coalesce(value, F.lit(0)).cast("double")
    return (
        F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(fixed(n / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(fixed(n / (1024 * 1024), 2), F.lit(" MB")))
    )


def ms_label(value: Column) -> Column:
    """Readable duration: one decimal below 100 ms, none below a second, then seconds with two."""
    n = F.coalesce(value, F.lit(0)).cast("double")
    return (
        F.when(n < 100, F.concat(fixed(n, 1), F.lit(" ms")))
        .when(n < 1000, F.concat(fixed(n, 0), F.lit(" ms")))
        .otherwise(F.concat(fixed(n / 1000, 2), F.lit(" s")))
    )


def content_range_total(value: Column) -> Column:
    """Total of a Content-Range header, 0 when unknown."""
    return F.coalesce(F.regexp_extract(F.coalesce(value, F.lit("")), r"/\s*(\d+)\s*$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def size_from_range(status: Column, content_range: Column, content_length: Column) -> Column:
    """``struct(size_bytes, size_source)`` of a range request's answer."""
    total = content_range_total(content_range)
    length = F.coalesce(content_length.try_cast("bigint"), F.lit(0))
    make = lambda n, s: F.struct(n.cast("bigint").alias("size_bytes"), F.lit(s).alias("size_source"))
    return (
        F.when(total > 0, make(total, "content-range"))
        .when((status == 200) & (length > 0), make(length, "content-length"))
        .otherwise(make(F.lit(0), ""))
    )


def should_range_fallback(status: Column, size_bytes: Column, error: Column) -> Column:
    """Whether a HEAD answer needs a range request to learn the size."""
    return (error != "") | status.isin(405, 501) | ((size_bytes == 0) & (status > 0) & (status < 400))


def image_waste(images: DataFrame, dpr: float = 1.0) -> DataFrame:
    """Add needed and wasted bytes; ``oversized`` is more than 1.5 times the pixels and 10 KiB waste.

    Needs natural/rendered width and height and ``size_bytes``.
    """
    c = F.col
    scale = max(1.0, dpr)
    source = (c("natural_width") * c("natural_height")).cast("double")
    target = (c("rendered_width") * c("rendered_height")).cast("double") * scale * scale
    known = (c("size_bytes") > 0) & (source > 0) & (target > 0)
    needed = F.when(known, js_round(c("size_bytes") * F.least(F.lit(1.0), target / source))).otherwise(c("size_bytes")).cast("bigint")
    out = images.withColumns({"waste_known": known, "needed_bytes": needed})
    waste = F.greatest(F.lit(0), c("size_bytes") - c("needed_bytes"))
    ratio = F.when(c("waste_known"), source / target).otherwise(F.lit(0.0))
    out = out.withColumns({"waste_bytes": waste, "pixel_ratio": ratio})
    return out.withColumn("oversized", (c("pixel_ratio") > 1.5) & (c("waste_bytes") >= 10 * 1024))


def network_level(checked: Column, status: Column, redirected: Column, error: Column) -> Column:
    return (
        F.when(~checked, "unknown")
        .when((error != "") | (status == 0) | (status >= 400), "critical")
        .when((status >= 300) | redirected, "warning")
        .otherwise("ok")
    )


def image_audit(images: DataFrame, results: DataFrame, dpr: float = 1.0) -> DataFrame:
    """Images with network state, format, size and waste; the last result per URL counts.

    ``results``: ``url, status, redirected, final_url, error, content_type, size_bytes, checked_at``.
    """
    keyed = settled(results, {"norm": U.normalize_url(F.col("url"), "raw", browser=True)})
    r = latest(
        keyed.select(
            "norm", "status", "redirected", "final_url", "error", "content_type", F.col("size_bytes").alias("net_bytes"), "checked_at"
        ),
        "norm",
        "checked_at",
    ).withColumn("seen", F.lit(True))
    rows = settled(images, {"norm": U.normalize_url(F.col("src"), "raw")}).join(r, "norm", "left")
    own = F.col("transfer_size") if "transfer_size" in images.columns else F.lit(0)
    checked = F.coalesce("seen", F.lit(False))
    rows = rows.withColumns(
        {
            "checked": checked,
            "size_bytes": F.coalesce(F.nullif("net_bytes", F.lit(0)), own, F.lit(0)).cast("bigint"),
            "level": network_level(checked, F.coalesce("status", F.lit(0)), F.coalesce("redirected", F.lit(False)), F.coalesce("error", F.lit(""))),
        }
    )
    fmt = image_format(F.col("content_type"), F.coalesce(F.nullif("final_url", F.lit("")), F.col("norm")))
    return image_waste(settled(rows, {"format": fmt}), dpr)


def image_counts(audited: DataFrame) -> DataFrame:
    c = F.col
    return audited.groupBy("page_id").agg(
        F.count("*").alias("total"),
        F.count_if("checked").alias("checked"),
        F.count_if(c("level") == "critical").alias("broken"),
        F.count_if(c("level") == "warning").alias("redirect"),
        F.count_if("oversized").alias("oversized"),
        F.count_if(c("size_bytes") == 0).alias("unknown_size"),
        F.sum("size_bytes").alias("total_bytes"),
        F.sum("waste_bytes").alias("waste_bytes"),
    )


def image_ranking(audited: DataFrame, k: int) -> DataFrame:
    """Images by waste, then size, first ``k`` (a top-k report)."""
    return audited.orderBy(F.desc("waste_bytes"), F.desc("size_bytes"), "page_id", "idx").limit(k)


def image_size_issues(audited: DataFrame, limit_bytes: int = 512 * 1024) -> DataFrame:
    """Pages with images above the size limit: ``page_id, id, severity, images``."""
    rows = audited.where(F.col("size_bytes") > limit_bytes)
    return rows.groupBy("page_id").agg(F.count("*").alias("images")).select(
        "page_id", F.lit("images.fileSize").alias("id"), F.lit("warning").alias("severity"), "images"
    )
