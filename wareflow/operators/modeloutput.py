"""Stored language-model responses: first JSON object, one fixed schema, checks, final catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a normalised product.
STRINGS = "product_type brand model cpu_model socket ram_type ram_standard storage_type storage_detail gpu_model gpu_vram_type chipset form_factor resolution_label panel_type switch_type layout os".split()
INTEGERS = "cpu_cores cpu_threads ram_gb ram_speed_mhz max_ram_gb ram_slots storage_gb gpu_vram_gb psu_wattage_w recommended_psu_w max_gpu_length_mm max_cpu_cooler_height_mm resolution_width resolution_height refresh_rate_hz mouse_dpi warranty_months".split()
DOUBLES = "cpu_base_clock_ghz cpu_boost_clock_ghz screen_inches weight_kg".split()
LISTS = "upgrade_storage_options supported_mainboard_form_factors connectivity ports warnings".split()
CATEGORIES = "desktop_pc laptop cpu mainboard ram gpu ssd hdd psu case cooler monitor keyboard mouse headset webcam ups other".split()


def json_object(text: Column) -> Column:
    """The JSON text from the first brace to the last one, code fences removed; null unless it is valid JSON."""
    body = F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull(), body)


def normalise(json: Column, fallback_category: Column) -> Column:
    """Struct of all fields with lenient typing; unknown categories fall back, confidence is held within 0 and 1."""
    return F.get(F.transform(F.array(F.from_json(json, "map<string,string>")), lambda m: _typed(m, fallback_category)), F.lit(0))


def _typed(m: Column, fallback_category: Column) -> Column:
    raw = lambda k: F.try_element_at(m, F.lit(k))
    text = lambda k: F.when(~F.lower(F.trim(raw(k))).isin("", "null", "none"), F.trim(raw(k)))
    number = lambda k: F.nullif(F.regexp_extract(F.regexp_replace(raw(k), r"(?<=\d),(?=\d{3}\b)", ""), r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", 0), F.lit("")).try_cast("double")

    def items(k: str) -> Column:
        array = F.when(raw(k).startswith("["), F.from_json(raw(k), "array<string>")).when(text(k).isNotNull(), F.array(text(k)))
        return F.coalesce(F.filter(F.transform(array, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))

    cat = F.lower(text("category"))
    safe = F.when(fallback_category.isin(*CATEGORIES), fallback_category).otherwise("other")
    fields = [F.when(cat.isin(*CATEGORIES), cat).otherwise(safe).alias("category")]
    fields += [text(k).alias(k) for k in STRINGS] + [number(k).cast("int").alias(k) for k in INTEGERS] + [number(k).alias(k) for k in DOUBLES]
    fields += [items(k).alias(k) for k in LISTS]
    fields.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number("confidence"), F.lit(0.0)))).alias("confidence"))
    return F.struct(*fields)


def warnings(spec: Column, n_raw: Column) -> Column:
    """What is missing or out of range in a normalised struct."""
    cat = spec["category"]
    gone = lambda k: spec[k].isNull() | (spec[k].cast("string").isin("", "0", "0.0"))
    pc = cat.isin("desktop_pc", "laptop")
    ram, disk = spec["ram_gb"], spec["storage_gb"]
    rules = [
        (pc & gone("cpu_model"), "missing_cpu_model"),
        (pc & gone("ram_gb"), "missing_ram_gb"),
        (pc & gone("storage_gb"), "missing_storage_gb"),
        ((cat == "cpu") & gone("cpu_model") & gone("model"), "missing_cpu_model"),
        ((cat == "gpu") & gone("gpu_model"), "missing_gpu_model"),
        ((cat == "monitor") & gone("screen_inches"), "missing_screen_inches"),
        (ram <= 0, "ram_invalid"),
        (ram > 512, "ram_too_large"),
        (disk <= 0, "storage_invalid"),
        (disk > 100_000, "storage_too_large"),
        (F.coalesce(spec["confidence"], F.lit(0.0)) < 0.7, "low_confidence"),
        ((n_raw > 0) & spec.isNull(), "llm_empty_specs"),
    ]
    return F.array_compact(F.array(*[F.when(cond, w) for cond, w in rules]))


def final_catalog(products: DataFrame, spec: str = "spec") -> DataFrame:
    """Rows with a normalised struct; the model's category wins, the product's own brand wins."""
    rows = products.where(F.col(spec).isNotNull())
    return rows.withColumn("category", F.coalesce(f"{spec}.category", "category")).withColumn("brand", F.coalesce(F.nullif(F.col("brand"), F.lit("")), F.col(f"{spec}.brand")))


def summary(rows: DataFrame, warn: str = "warnings") -> DataFrame:
    """(category, n, n_failed, n_warned) by category."""
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("spec").isNull()).alias("n_failed"), F.count_if(F.size(warn) > 0).alias("n_warned"))


def audit(products: DataFrame, pairs: str = "raw_specs", order: str = "row_order", samples: int = 5) -> DataFrame:
    """(category, key, n, pct, samples): how many products of a category have a key, with its first distinct values."""
    from pyspark.sql import Window

    totals = products.groupBy("category").agg(F.count("*").alias("total"))
    flat = products.select("category", order, F.explode(pairs).alias("p")).select("category", order, "p.key", "p.value")
    seen = flat.groupBy("category", "key", "value").agg(F.min(order).alias("first"))
    top = seen.withColumn("_n", F.row_number().over(Window.partitionBy("category", "key").orderBy("first", "value"))).where(F.col("_n") <= samples)
    values = top.groupBy("category", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]).alias("samples"))
    counts = flat.groupBy("category", "key").agg(F.countDistinct(order).alias("n"))
    return counts.join(totals, "category").join(values, ["category", "key"]).select("category", "key", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"), "samples")


def histograms(products: DataFrame, normalised: str = "normalized_specs", status: str = "spec_status", warn: str = "parse_warnings") -> DataFrame:
    """(category, kind, name, n, pct): products, spec statuses, warnings and normalised fields of each category, counted in one aggregate.

    pct is of the category's products. A missing status counts as unknown.
    """
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    listed = lambda kind, names: F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: entry(kind, x))
    every = F.concat(F.array(entry("product", F.lit("all")), entry("status", F.coalesce(status, F.lit("unknown")))), listed("warning", F.col(warn)), listed("field", F.map_keys(normalised)))
    n = products.select("category", F.explode(every).alias("e")).groupBy("category", "e.kind", "e.name").agg(F.count("*").alias("n"))
    total = n.where("kind = 'product'").select("category", F.col("n").alias("total"))
    return n.join(total, "category").select("category", "kind", "name", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("pct"))
