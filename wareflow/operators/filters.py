"""Catalog predicates: typed filters, roles of components, preferences, keys."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRINGS = ["category", "subcategory", "brand", "stock_status", "gpu_model", "cpu_model", "socket"]
# Bounds and sorts by name.
BOUNDS = {"price_min": ("price_vnd", ">="), "price_max": ("price_vnd", "<="), "ram_min": ("ram_gb", ">="), "ram_max": ("ram_gb", "<="), "storage_min": ("storage_gb", ">="), "storage_max": ("storage_gb", "<="), "screen_min": ("screen_inches", ">="), "refresh_rate_min": ("refresh_rate_hz", ">=")}
ALIASES = {"min_price": "price_min", "max_price": "price_max"}
IGNORED = ["source", "sort", "limit"]
SORTS = {"relevance": None, "price_asc": ("price_vnd", True), "price_desc": ("price_vnd", False), "newest": ("updated_at", False), "name_asc": ("name", True), "ram_desc": ("ram_gb", False), "storage_desc": ("storage_gb", False), "refresh_rate_desc": ("refresh_rate_hz", False)}
MAX_PAGE, DEFAULT_PAGE = 100, 24


def catalog_filter(params: dict, source: str | None = None, on_unknown: str = "error") -> Column:
    """One predicate from checked parameters, joined by AND; a list, or text with commas for brand, means any of it.

    Unknown keys, booleans and numbers that are not finite raise ValueError (on_unknown="drop" drops unknown keys, after
    mapping aliases). Empty strings and None are skipped.
    """
    parts = [] if source is None else [F.col("source") == source]
    for key, value in params.items():
        if on_unknown == "drop":
            key = ALIASES.get(key, key)
            if key in IGNORED or (key not in STRINGS and key not in BOUNDS):
                continue
        if value is None or value == "":
            continue
        if key in STRINGS:
            values = value if isinstance(value, list) else [v.strip() for v in value.split(",")] if key == "brand" else [value]
            parts.append(F.col(key).isin(*[str(v) for v in values if v != ""]))
        elif key in BOUNDS:
            if isinstance(value, bool):
                raise ValueError(f"{key}: not a number")
            number = float(value)
            if not math.isfinite(number):
                raise ValueError(f"{key}: not finite")
            column, op = BOUNDS[key]
            parts.append(F.col(column) >= number if op == ">=" else F.col(column) <= number)
        else:
            raise ValueError(f"unknown filter {key}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def priced(current: Column, base: Column) -> Column:
    """The relational variant also wants an effective price above 1, which drops missing prices."""
    return F.coalesce(current, base) > 1


def active(source: str) -> Column:
    return (F.col("source") == source) & (F.col("status") == "active") & F.col("deleted_at").isNull()


def has(c: str) -> Column:
    """Truthiness: null, zero and empty text count as absent."""
    return F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0") == False  # noqa: E712


# Roles by columns that are null or not, as candidates and edges use them; a product may have several.
ROLES = {
    "cpu": "cpu_cores IS NOT NULL",
    "mobo": "form_factor IS NOT NULL AND cpu_cores IS NULL",
    "ram": "ram_gb IS NOT NULL AND psu_wattage_w IS NULL AND cpu_cores IS NULL",
    "gpu": "gpu_model IS NOT NULL",
    "storage": "storage_gb IS NOT NULL AND cpu_cores IS NULL AND gpu_model IS NULL",
    "psu": "psu_wattage_w IS NOT NULL",
}


def item_role(role: str) -> Column:
    """Roles by truthiness, as the rules for bundles use them."""
    cpu = has("cpu_cores") | has("cpu_model")
    return {
        "cpu": cpu,
        "mobo": has("form_factor") & ~cpu,
        "ram": has("ram_gb") & ~has("form_factor") & ~has("psu_wattage_w"),
        "psu": has("psu_wattage_w"),
        "case": F.size(F.coalesce("supported_mainboard_form_factors", F.array().cast("array<string>"))) > 0,
    }[role]


def preference(role: str, pref: str) -> Column:
    """Vendor by brand, socket or model, in any letter case; other values let everything through."""
    # What tells a vendor.
    likes = {
        ("cpu", "intel"): [("brand", "%intel%"), ("socket", "LGA%"), ("socket", "%1700%"), ("socket", "%1851%")],
        ("cpu", "amd"): [("brand", "%amd%"), ("socket", "AM%")],
        ("gpu", "nvidia"): [("brand", "%nvidia%"), ("gpu_model", "%rtx%"), ("gpu_model", "%gtx%")],
        ("gpu", "amd"): [("brand", "%amd%"), ("gpu_model", "%rx%"), ("gpu_model", "%radeon%")],
    }.get((role, pref), [])
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(p), F.lit(False)) for c, p in likes]) if likes else F.lit(True)


def resolve_keys(keys: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) for ``keys`` (key): a key with a colon is an id, any other a slug; active products only."""
    by_id = keys.where(F.contains("key", F.lit(":"))).join(products.select(F.col("id").alias("key"), "id"), "key")
    by_slug = keys.where(~F.contains("key", F.lit(":"))).join(products.select(F.col("slug").alias("key"), "id"), "key")
    found = by_id.unionByName(by_slug)
    return found, keys.join(found, "key", "left_anti")


def sort_order(name: str, tie: str = "id") -> list[Column]:
    if name not in SORTS:
        raise ValueError(f"unknown sort {name}")
    if SORTS[name] is None:
        return [F.col("score").desc(), F.col(tie)]
    column, up = SORTS[name]
    return [F.col(column).asc_nulls_last() if up else F.col(column).desc_nulls_last(), F.col(tie)]


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = DEFAULT_PAGE) -> DataFrame:
    """One page with the total of hits and of pages on each row; the total is a scalar subquery, not a window."""
    number, limit = max(1, number), max(1, min(MAX_PAGE, limit))
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit).withColumn("total_hits", total).withColumn("total_pages", F.ceil(F.col("total_hits") / limit).cast("long"))
