"""Rule configuration and domain profiles: small dimension tables next to the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.core import clean, keep_true, str_array

# Thresholds: key, default, minimum, maximum, whole number, label (fixed values).
THRESHOLDS = [
    ("title_min", 15, 0, 500, True, "Title minimum"),
    ("title_max", 60, 1, 500, True, "Title maximum"),
    ("description_min", 50, 0, 2000, True, "Description minimum"),
    ("description_max", 160, 1, 2000, True, "Description maximum"),
    ("oversized_image_ratio", 2, 1, 20, False, "Oversized image ratio"),
    ("image_max_bytes", 512 * 1024, 1024, 100 * 1024 * 1024, True, "Image file-size limit"),
]
# Required signals and whether they are on by default (fixed values).
REQUIRED = {
    "title": True, "description": True, "canonical": True, "h1": True, "schema": False, "hreflang": False, "https": False,
}
SEVERITIES = ["critical", "warning", "info"]
RULE_ID = r"^[A-Za-z0-9][A-Za-z0-9._\-]{0,79}$"

DEFAULT_RULES = {
    "thresholds": {key: default for key, default, *_ in THRESHOLDS},
    "required": dict(REQUIRED),
    "disabled_checks": [],
    "severity_overrides": {},
}
_TYPES = {key: "int" if whole else "double" for key, _, _, _, whole, _ in THRESHOLDS}
# Configuration as written: every number a DOUBLE that may be missing.
CONFIG_SCHEMA = (
    "struct<thresholds:struct<" + ",".join(f"{k}:double" for k, *_ in THRESHOLDS) + ">,required:struct<"
    + ",".join(f"{k}:boolean" for k in REQUIRED)
    + ">,disabled_checks:array<string>,severity_overrides:map<string,string>>"
)


def _struct(values: dict) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def rules_literal(rules: dict) -> Column:
    overrides = [F.lit(x) for kv in rules["severity_overrides"].items() for x in kv]
    return _struct(
        {
            "thresholds": _struct({k: F.lit(v).cast(_TYPES[k]) for k, v in rules["thresholds"].items()}),
            "required": _struct({k: F.lit(v) for k, v in rules["required"].items()}),
            "disabled_checks": str_array(rules["disabled_checks"]),
            "severity_overrides": F.create_map(*overrides).cast("map<string,string>"),
        }
    )


def _ordered(low: Column, high: Column) -> tuple[Column, Column]:
    return F.least(low, high), F.greatest(low, high)


def normalize_rules(config: Column) -> Column:
    """Clamp thresholds, swap inverted limits, drop unknown ids and severities."""
    t = {}
    for key, default, low, high, whole, _ in THRESHOLDS:
        given = F.coalesce(config["thresholds"][key], F.lit(float(default)))
        value = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), given))
        t[key] = (F.floor(value + 0.5) if whole else value).cast(_TYPES[key])
    t["title_min"], t["title_max"] = _ordered(t["title_min"], t["title_max"])
    t["description_min"], t["description_max"] = _ordered(t["description_min"], t["description_max"])
    disabled = F.filter(F.coalesce(config["disabled_checks"], str_array([])), lambda x: x.rlike(RULE_ID))
    lowered = F.transform_values(
        F.coalesce(config["severity_overrides"], F.create_map().cast("map<string,string>")), lambda k, v: F.lower(v)
    )
    return _struct(
        {
            "thresholds": _struct(t),
            "required": _struct({k: F.coalesce(config["required"][k], F.lit(v)) for k, v in REQUIRED.items()}),
            "disabled_checks": F.array_sort(F.array_distinct(disabled)),
            "severity_overrides": F.map_filter(lowered, lambda k, v: k.rlike(RULE_ID) & v.isin(SEVERITIES)),
        }
    )


def _range_errors(config: Column, key_as_label: bool, required: bool) -> list[tuple[Column, Column]]:
    out = []
    for key, _, low, high, _, label in THRESHOLDS:
        value = config["thresholds"][key]
        bad = (value < low) | (value > high)
        bad = F.coalesce(bad, F.lit(required))
        out.append((bad, F.lit(f"{key if key_as_label else label} must be between {low} and {high}.")))
    return out


def validate_rules(config: Column) -> Column:
    """Array of error messages; empty when the configuration is valid."""
    t = config["thresholds"]
    return keep_true(
        *_range_errors(config, False, True),
        (t["title_min"] > t["title_max"], F.lit("Title minimum cannot exceed title maximum.")),
        (t["description_min"] > t["description_max"], F.lit("Description minimum cannot exceed description maximum.")),
    )


def normalize_hostname(value: Column) -> Column:
    v = F.trim(value)
    full = F.when(v.rlike(r"^(?i)[a-z][a-z0-9+.\-]*://"), v).otherwise(F.concat(F.lit("https://"), v))
    return F.regexp_replace(F.when(v == "", F.lit("")).otherwise(U.url_host(full)), r"\.$", "")


def normalize_schema_type(value: Column) -> Column:
    v = F.trim(value)
    return F.when((F.length(v) <= 120) & v.rlike(r"^[A-Za-z0-9_:#./\-]+$"), v).otherwise(F.lit(""))


def normalize_hreflang_value(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when((v == "x-default") | v.rlike(r"^[a-z]{2,8}(?:-[a-z0-9]{1,8})*$"), v).otherwise(F.lit(""))


def _unique_sorted(values: Column, normalize) -> Column:
    kept = F.filter(F.transform(F.coalesce(values, str_array([])), normalize), lambda v: v != "")
    lowered = F.transform(kept, lambda v: F.lower(v))
    first = F.filter(kept, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)
    return F.array_sort(first)


def normalize_profiles(profiles: DataFrame) -> DataFrame:
    """Clean profile rows: ``hostname, label, enabled, rules, schema_types, hreflang, ignore_checks``."""
    return profiles.select(
        normalize_hostname(F.col("hostname")).alias("hostname"),
        clean(F.col("label"), 80).alias("label"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        "rules",
        _unique_sorted(F.col("schema_types"), normalize_schema_type).alias("schema_types"),
        _unique_sorted(F.col("hreflang"), normalize_hreflang_value).alias("hreflang"),
        _unique_sorted(
            F.col("ignore_checks"), lambda v: F.when(v.rlike(RULE_ID), v).otherwise(F.lit(""))
        ).alias("ignore_checks"),
    ).where("hostname <> ''")


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """One row per error of a profile."""
    r = F.col("rules")
    fixed = keep_true(
        (normalize_hostname(F.col("hostname")) == "", F.lit("A valid hostname is required.")),
        *_range_errors(r, True, False),
        (
            r["thresholds"]["title_min"] > r["thresholds"]["title_max"],
            F.lit("Profile title minimum cannot exceed profile title maximum."),
        ),
        (
            r["thresholds"]["description_min"] > r["thresholds"]["description_max"],
            F.lit("Profile description minimum cannot exceed profile description maximum."),
        ),
    )
    bad = lambda col, normalize, what: F.transform(
        F.filter(F.coalesce(F.col(col), str_array([])), lambda v: normalize(v) == ""),
        lambda v: F.concat(F.lit(f"Invalid expected {what}: "), F.left(v, F.lit(80))),
    )
    errors = F.concat(
        fixed, bad("schema_types", normalize_schema_type, "schema type"), bad("hreflang", normalize_hreflang_value, "hreflang")
    )
    return profiles.select("hostname", F.explode(errors).alias("error"))


def upsert_profiles(current: DataFrame, incoming: DataFrame, limit: int | None = None) -> DataFrame:
    """Incoming profiles replace those of the same host; with ``limit`` only the first hosts by name are kept."""
    both = normalize_profiles(current).withColumn("turn", F.lit(0)).unionByName(
        normalize_profiles(incoming).withColumn("turn", F.lit(1))
    )
    newest = Window.partitionBy("hostname").orderBy(F.desc("turn"))
    latest = both.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn", "turn")
    return latest if limit is None else latest.orderBy("hostname").limit(limit)


def remove_profiles(current: DataFrame, hosts: DataFrame) -> DataFrame:
    return normalize_profiles(current).join(
        hosts.select(normalize_hostname(F.col("hostname")).alias("hostname")), "hostname", "left_anti"
    )


def profile_summary(profiles: DataFrame) -> DataFrame:
    return normalize_profiles(profiles).select(
        "hostname", "label", "enabled", "schema_types", "hreflang", "ignore_checks"
    )


def resolve_rules(pages: DataFrame, profiles: DataFrame, base: dict | None = None, host: str = "host") -> DataFrame:
    """Add ``profile`` and effective ``rules``: an enabled profile of the exact host overrides what it sets.

    One row a host on the right: Spark broadcasts it while it is small and splits a hot host otherwise.
    """
    b = rules_literal(base or DEFAULT_RULES)
    dim = normalize_profiles(profiles)
    dim = dim.where("enabled").select(F.col("hostname").alias(host), F.struct(*dim.columns).alias("profile"))
    joined = pages.join(dim, host, "left")
    p = F.col("profile")["rules"]
    merged = _struct(
        {
            "thresholds": _struct(
                {k: F.coalesce(p["thresholds"][k], b["thresholds"][k].cast("double")) for k, *_ in THRESHOLDS}
            ),
            "required": _struct({k: F.coalesce(p["required"][k], b["required"][k]) for k in REQUIRED}),
            "disabled_checks": F.array_union(
                b["disabled_checks"], F.coalesce(F.col("profile")["ignore_checks"], str_array([]))
            ),
            "severity_overrides": F.map_from_entries(
                F.concat(
                    F.filter(
                        F.map_entries(b["severity_overrides"]),
                        lambda e: F.coalesce(~F.map_contains_key(p["severity_overrides"], e["key"]), F.lit(True)),
                    ),
                    F.map_entries(F.coalesce(p["severity_overrides"], F.create_map().cast("map<string,string>"))),
                )
            ),
        }
    )
    return joined.withColumn("rules", normalize_rules(merged))
