"""Import of product dumps: typed rows, long specifications, text chunks, and one run of all stages."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareflow.functions import security, text

from . import merge, prices
from .store import Store

# Specification keys of the text chunk, in order.
CHUNK_KEYS = "product_type model cpu_model cpu_cores cpu_threads cpu_base_clock_ghz cpu_boost_clock_ghz socket ram_gb ram_type ram_speed_mhz max_ram_gb storage_gb storage_type gpu_model gpu_vram_gb screen_inches refresh_rate_hz panel_type os".split()
DUMP_SCHEMA = "source string, source_url string, source_product_id string, sku string, category string, subcategory string, name string, brand string, thumbnail_url string, images array<string>, prices struct<list_price: string, sale_price: string, build_pc_price: string, regional_price: string>, stock struct<status: string, quantity: string>, warranty string, description string, breadcrumbs array<string>, raw_specs map<string,string>, normalized_specs map<string,string>, crawled_at string, normalized_at string"


def valid() -> Column:
    present = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    return present("source_url") & present("name") & present("category")


def parse(dump: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows). ``dump`` follows DUMP_SCHEMA and has ``row_order``."""
    empty = lambda c, kind: F.coalesce(F.col(c), (F.array() if kind.startswith("array") else F.create_map()).cast(kind))
    own = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(source))
    list_price, sale = text.price_digits(F.col("prices.list_price")), text.price_digits(F.col("prices.sale_price"))
    n = F.col("stock.quantity").try_cast("int")
    good = dump.where(valid()).select(
        "row_order",
        text.product_id(own, F.col("source_url")).alias("id"),
        own.alias("source"),
        "source_url", "source_product_id", "sku", "category", "subcategory", "name", "brand", "thumbnail_url", "warranty", "description",
        text.slug(F.col("name"), F.col("source_url")).alias("slug"),
        F.coalesce(sale, list_price).alias("price_vnd"),
        list_price.alias("list_price_vnd"),
        sale.alias("sale_price_vnd"),
        text.price_digits(F.col("prices.build_pc_price")).alias("build_pc_price_vnd"),
        text.price_digits(F.col("prices.regional_price")).alias("regional_price_vnd"),
        F.nullif(F.lower(F.trim("stock.status")), F.lit("")).alias("stock_status"),
        F.when(n >= 0, n).alias("stock_quantity"),
        F.coalesce(F.element_at("normalized_specs", "warranty_months").try_cast("int"), text.warranty_months(F.col("warranty"))).alias("warranty_months"),
        empty("images", "array<string>").alias("images"),
        empty("breadcrumbs", "array<string>").alias("breadcrumbs"),
        empty("raw_specs", "map<string,string>").alias("raw_specs"),
        empty("normalized_specs", "map<string,string>").alias("normalized_specs"),
        text.timestamp(F.col("crawled_at")).alias("crawled_at"),
        text.timestamp(F.col("normalized_at")).alias("normalized_at"),
    )
    return good, dump.where(~valid())


def sorted_json(m: Column) -> Column:
    """Map as a JSON object with sorted keys; null values stay."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))), {"ignoreNullFields": "false"})


# The fields whose change makes a product another version; times, paths, warnings and status are none of them.
BUSINESS_FIELDS = "name brand category subcategory thumbnail_url images price_vnd list_price_vnd sale_price_vnd build_pc_price_vnd regional_price_vnd stock_status stock_quantity warranty warranty_months description breadcrumbs raw_specs normalized_specs".split()


def canonical_hash() -> Column:
    """SHA-256 over the business fields of a parsed row, whatever the order of its maps; nulls count."""
    fields = [(sorted_json(F.col(c)) if c.endswith("_specs") else F.col(c)).alias(c) for c in sorted(BUSINESS_FIELDS)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


# Columns of the wide specifications by type, and the columns in their order.
WIDE_TYPES = {
    "string": "product_type model cpu_model socket ram_type ram_standard storage_type storage_detail gpu_model gpu_vram_type chipset form_factor resolution_label panel_type os switch_type layout".split(),
    "int": "cpu_cores cpu_threads ram_gb ram_speed_mhz max_ram_gb ram_slots storage_gb gpu_vram_gb psu_wattage_w recommended_psu_w max_gpu_length_mm max_cpu_cooler_height_mm resolution_width resolution_height refresh_rate_hz mouse_dpi".split(),
    "double": "cpu_base_clock_ghz cpu_boost_clock_ghz screen_inches weight_kg confidence".split(),
    "array<string>": "upgrade_storage_options supported_mainboard_form_factors ports connectivity warnings".split(),
}
WIDE_SCALARS = WIDE_TYPES["string"] + WIDE_TYPES["int"] + WIDE_TYPES["double"]
WIDE_WHOLE = [*WIDE_TYPES["array<string>"], "specs"]
BUCKETS = 16


def wide_specs(rows: DataFrame) -> DataFrame:
    """The 45 typed columns of each product's normalised map: scalars null where absent or of another type, lists empty, and the map
    itself as JSON with sorted keys."""
    value = lambda k: F.element_at("normalized_specs", k)
    read = {
        "string": lambda k: F.nullif(F.trim(value(k)), F.lit("")),
        "int": lambda k: text.number(value(k)).cast("int"),
        "double": lambda k: text.number(value(k)),
        "array<string>": lambda k: F.coalesce(F.filter(F.from_json(value(k), "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>")),
    }
    cols = [read[kind](k).alias(k) for kind, keys in WIDE_TYPES.items() for k in keys]
    order = [c for c in ("row_order",) if c in rows.columns]
    return rows.select(F.col("id").alias("product_id"), *order, *cols, sorted_json(F.col("normalized_specs")).alias("specs"))


def bucketed(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("product_id"), F.lit(buckets)).cast("int"))


def upsert_wide(store: Store, rows: DataFrame) -> int:
    """Merge wide rows of a batch (``row_order`` tells their order) into the stored ones; the number of products merged.

    Scalars are overwritten by what isn't null, lists and the map always. Only the buckets that the batch touches are read and
    rewritten, as a new version of them.
    """
    new = bucketed(merge.fold_batch(rows, "product_id", "row_order", WIDE_WHOLE, WIDE_SCALARS, []))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    if not touched:
        return 0
    old = store.read(touched).drop("bucket")
    merged = bucketed(merge.upsert(old, new.drop("bucket"), "product_id", WIDE_WHOLE, WIDE_SCALARS, []))
    store.publish(merged, touched)
    return new.count()


def wide_store(spark: SparkSession, root: str) -> Store:
    kinds = {k: kind for kind, keys in WIDE_TYPES.items() for k in keys}
    return Store(spark, root, "bucket", ", ".join(["product_id string", *(f"{k} {kind}" for k, kind in kinds.items()), "specs string", "bucket int"]))


def dry_run(dump: DataFrame, source: str) -> DataFrame:
    """(counter, n) of an import into an empty catalog, without writing: every valid row counts as new in each stage."""
    rows, rejected = parse(dump, source)
    wide = wide_specs(rows)
    some = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in WIDE_SCALARS])
    sums = wide.agg(F.coalesce(F.sum(some), F.lit(0)).alias("n")).select(F.lit("wide_filled").alias("counter"), "n")
    from_crawl = rows.where("crawled_at IS NOT NULL")
    return counters({"parsed": rows, "rejected": rejected, "products": rows, "specs": wide, "spec_values": spec_values(rows), "prices": rows, "prices_from_crawled_at": from_crawl, "chunks": chunks(rows)}).unionByName(sums)


def spec_values(rows: DataFrame) -> DataFrame:
    """(product_id, spec_key, normalized_key, spec_index, value_text, value_num, unit, group_name): one row for each value.

    A list (JSON text) gives key[i] for each element that isn't null; warnings and confidence are left out.
    """
    flat = rows.select(F.col("id").alias("product_id"), F.explode("normalized_specs").alias("k", "v")).where(~F.col("k").isin("warnings", "confidence") & F.col("v").isNotNull())
    is_list = F.col("v").rlike(r"^\s*\[")
    single = flat.where(~is_list).select("product_id", F.col("k").alias("spec_key"), F.col("k").alias("normalized_key"), F.lit(None).cast("int").alias("spec_index"), F.col("v").alias("value_text"))
    many = flat.where(is_list).select("product_id", "k", F.posexplode(F.from_json("v", "array<string>")).alias("i", "v")).where("v IS NOT NULL")
    many = many.select("product_id", F.col("k").alias("spec_key"), F.concat("k", F.lit("["), "i", F.lit("]")).alias("normalized_key"), F.col("i").alias("spec_index"), F.col("v").alias("value_text"))
    both = single.unionByName(many)
    return both.select("*", text.number(F.col("value_text")).alias("value_num"), text.unit(F.col("spec_key")).alias("unit"), text.group_of(F.col("spec_key")).alias("group_name"))


def chunks(rows: DataFrame) -> DataFrame:
    """(product_id, chunk_type, chunk_index, content, content_hash, token_count): five chunks for each product."""
    value = lambda k: F.element_at("normalized_specs", k)
    specs = F.array_join(F.array_compact(F.array(*[F.when(value(k).isNotNull(), F.concat(F.lit(f"{k}: "), value(k))) for k in CHUNK_KEYS])), "; ")
    months = F.coalesce(F.concat(F.lit(" ("), F.col("warranty_months").cast("string"), F.lit(" tháng)")), F.lit(""))
    parts = {
        "title": F.concat("name", F.lit(" | brand="), F.coalesce(F.nullif(F.col("brand"), F.lit("")), F.lit("N/A")), F.lit(" | category="), "category"),
        "description": F.coalesce("description", F.lit("")),
        "specs": specs,
        "raw_specs": sorted_json(F.col("raw_specs")),
        "warranty": F.when(F.coalesce("warranty", F.lit("")) != "", F.concat("warranty", months)).otherwise(""),
    }
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("chunk_type"), F.lit(0).alias("chunk_index"), v.alias("content")) for k, v in parts.items()]))
    out = rows.select(F.col("id").alias("product_id"), each)
    return out.select("*", F.sha2("content", 256).alias("content_hash"), text.tokens_estimate(F.col("content")).alias("token_count"))


def price_rows(rows: DataFrame, captured: Column) -> DataFrame:
    state = [F.col(c) for c in ("price_vnd", "list_price_vnd", "sale_price_vnd", "build_pc_price_vnd", "regional_price_vnd", "stock_status", "stock_quantity")]
    return rows.select(F.col("id").alias("product_id"), F.coalesce("crawled_at", captured).alias("captured_at"), captured.alias("created_at"), "price_vnd", "stock_status", security.price_state_hash(*state).alias("price_hash"))


def run_status(failed: Column, total: Column, parsed: Column) -> Column:
    """done without failures; with some, failed from one percent of them on or below 95 percent parsed, else partial."""
    return F.when(failed == 0, "done").when((failed >= 0.01 * total) | (parsed < 0.95 * total), "failed").otherwise("partial")


OVERWRITE = ["category", "name", "price_vnd", "list_price_vnd", "sale_price_vnd", "stock_status", "stock_quantity", "raw_specs", "normalized_specs", "canonical_hash"]
COALESCE = ["brand", "subcategory", "thumbnail_url", "warranty", "warranty_months", "description", "crawled_at"]
KEEP = ["source", "source_url", "source_product_id", "sku", "slug"]


@dataclass
class Snapshot:
    """Tables of the catalog; None stands for an empty one. ``changed``: ids of products that the import made or gave another content hash."""

    products: DataFrame | None = None
    raw: DataFrame | None = None
    spec_values: DataFrame | None = None
    prices: DataFrame | None = None
    chunks: DataFrame | None = None
    wide: DataFrame | None = None
    changed: DataFrame | None = None
    counts: dict = field(default_factory=dict)


def import_run(dump: DataFrame, old: Snapshot, source: str, captured: Column) -> Snapshot:
    """All stages of one import as set operations; the result's tables are to be written as a new snapshot.

    Running the same dump again changes nothing: payloads, prices and chunks are known, products merge into themselves.
    """
    rows, rejected = parse(dump, source)
    maps = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.MapType)]
    canonical = F.struct(*[(sorted_json(F.col(c)) if c in maps else F.col(c)).alias(c) for c in sorted(rows.columns) if c != "row_order"])
    payload = rows.select("source_url", F.sha2(F.to_json(canonical, {"ignoreNullFields": "false"}), 256).alias("payload_hash"))
    rows = rows.withColumn("canonical_hash", canonical_hash())
    one = merge.fold_batch(rows, "id", "row_order", OVERWRITE, COALESCE, KEEP)
    products = one if old.products is None else merge.upsert(old.products, one, "id", OVERWRITE, COALESCE, KEEP)
    raw_new = payload.dropDuplicates() if old.raw is None else merge.insert_absent(old.raw, payload, ["source_url", "payload_hash"])
    last = prices.first_per_key(rows, ["id"], [F.col("row_order").desc()])
    wide = merge.fold_batch(wide_specs(rows), "product_id", "row_order", WIDE_WHOLE, WIDE_SCALARS, [])
    wide = wide if old.wide is None else merge.upsert(old.wide, wide, "product_id", WIDE_WHOLE, WIDE_SCALARS, [])
    values, price, chunk = spec_values(last), price_rows(last, captured), chunks(last)
    price_new = price if old.prices is None else prices.append_changed(old.prices, price).select(*price.columns)
    keys = ["product_id", "chunk_type", "chunk_index", "content_hash"]
    chunk_new = chunk if old.chunks is None else merge.insert_absent(old.chunks, chunk, keys).select(*chunk.columns)
    join = lambda a, b: b if a is None else a.unionByName(b)
    new_ids = one.select("id") if old.products is None else one.select("id").join(old.products.select("id"), "id", "left_anti")
    changed = one.select("id") if old.products is None else one.join(old.products.select("id", F.col("canonical_hash").alias("_was")), "id", "left").where("NOT canonical_hash <=> _was").select("id")
    counts = {"parsed": rows, "rejected": rejected, "new_products": new_ids, "merged": one, "new_payloads": raw_new, "new_prices": price_new, "new_chunks": chunk_new, "spec_values": values}
    return Snapshot(products, join(old.raw, raw_new), values if old.spec_values is None else merge.replace_children(old.spec_values, values, "product_id"), join(old.prices, price_new), join(old.chunks, chunk_new), wide, changed, counts)


def counters(counts: dict[str, DataFrame]) -> DataFrame:
    """(counter, n) of the stages of a run, one aggregate each, in one plan."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("counter"), "n") for k, df in counts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expected_values(rows: DataFrame) -> DataFrame:
    """(product_id, expected): long rows that a product's specifications stand for, null elements of lists counted too.

    A check against ``spec_values``, which leaves null elements out, so the two differ where a list holds one.
    """
    flat = rows.select(F.col("id").alias("product_id"), F.explode("normalized_specs").alias("k", "v")).where(~F.col("k").isin("warnings", "confidence") & F.col("v").isNotNull())
    n = F.when(F.col("v").rlike(r"^\s*\["), F.size(F.from_json("v", "array<string>"))).otherwise(1)
    return flat.groupBy("product_id").agg(F.sum(n).alias("expected"))
