"""Search documents: their projection from the catalog, a full rebuild by source, and changes from the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wareflow.functions import text

from . import filters, outbox
from .store import Store

# Fields that come from products and from specifications as they are, with their types.
FROM_PRODUCTS = "slug source source_url sku name brand category subcategory thumbnail_url".split()
LATEST = ["price_vnd", "list_price_vnd", "sale_price_vnd"]
PRICES = "build_pc_price_vnd regional_price_vnd".split()
FROM_SPECS = {"product_type": "string", "model": "string", "cpu_model": "string", "socket": "string", "ram_gb": "int", "ram_type": "string", "ram_speed_mhz": "int", "storage_gb": "int", "storage_type": "string", "gpu_model": "string", "gpu_vram_gb": "int", "screen_inches": "double", "resolution_label": "string", "refresh_rate_hz": "int", "panel_type": "string", "form_factor": "string", "psu_wattage_w": "int", "recommended_psu_w": "int"}
#: Fields of a search, first the ones that weigh most.
SEARCHED = "name brand sku category subcategory breadcrumbs model cpu_model gpu_model spec_summary normalized_tokens warranty_text".split()
FACETS = ["brand", "category", "ram_gb"]


def _of(df: DataFrame, column: str, kind: str) -> Column:
    """The column, or null where the table lacks it."""
    return (F.col(column) if column in df.columns else F.lit(None)).cast(kind).alias(column)


def search_documents(products: DataFrame, specs: DataFrame, latest: DataFrame) -> DataFrame:
    """The 42 fields of each product's document. ``products``: the rows to show; ``latest``: a current price row for each product.

    A current price counts before the product's own, and so does a current stock status that isn't empty. ``breadcrumbs`` is JSON
    or an array. All joins are one to one on the product.
    """
    s = specs.select(F.col("product_id").alias("_spec"), *[_of(specs, c, kind) for c, kind in FROM_SPECS.items()])
    p = latest.select(F.col("product_id").alias("_price"), *[_of(latest, c, "long").alias(f"current_{c}") for c in LATEST], F.col("stock_status").alias("current_stock_status"))
    kinds = dict(products.dtypes)
    crumbs = F.lit(None).cast("array<string>")
    if "breadcrumbs" in kinds:
        crumbs = F.filter(F.transform("breadcrumbs", lambda x: F.trim(x)), lambda x: x != "") if kinds["breadcrumbs"].startswith("array") else text.breadcrumbs(F.col("breadcrumbs"))
    own = products.select(
        "id",
        *[_of(products, c, "string") for c in FROM_PRODUCTS],
        F.coalesce(crumbs, F.array().cast("array<string>")).alias("breadcrumbs"),
        *[_of(products, c, "long") for c in (*LATEST, *PRICES)],
        *[_of(products, c, "string") for c in ("stock_status", "warranty_text")],
        *[_of(products, c, "int") for c in ("stock_quantity", "warranty_months")],
        _of(products, "updated_at", "timestamp"),
    )
    both = own.join(s, F.col("id") == F.col("_spec"), "left").join(p, F.col("id") == F.col("_price"), "left")
    parts = [F.col(c) for c in ("cpu_model", "ram_gb", "ram_type", "storage_gb", "storage_type", "gpu_model", "screen_inches", "refresh_rate_hz")]
    cpu, ram, kind, disk, disk_kind, gpu, inches, rate = parts
    return both.select(
        text.index_id(F.col("id")).alias("id"),
        F.col("id").alias("product_id"),
        *FROM_PRODUCTS,
        "breadcrumbs",
        *[F.coalesce(f"current_{c}", c).alias(c) for c in LATEST],
        *PRICES,
        F.coalesce(F.nullif(F.col("current_stock_status"), F.lit("")), F.col("stock_status")).alias("stock_status"),
        "stock_quantity",
        "warranty_months",
        "warranty_text",
        *FROM_SPECS,
        "updated_at",
        text.spec_summary(cpu, ram, kind, disk, disk_kind, gpu, inches, rate).alias("spec_summary"),
        text.alias_tokens(cpu, gpu, ram, kind, disk, disk_kind, inches, rate, *[F.col(c) for c in ("name", "category", "subcategory", "brand")]).alias("normalized_tokens"),
    )


def document_store(spark: SparkSession, root: str, documents: DataFrame) -> Store:
    return Store(spark, root, "source", documents.schema)


def rebuild(store: Store, products: DataFrame, specs: DataFrame, latest: DataFrame, source: str) -> dict[str, int]:
    """Replace all documents of ``source`` by those of its active products; stale ones go with the old version.

    Nothing is published unless as many documents were written as there are active products.
    """
    active = products.where(filters.active(source))
    n = active.count()
    store.publish(search_documents(active, specs, latest), [source], {source: n})
    return {"indexed": n, "active": n, "documents": store.versions()[source][1]}


def parity(store: Store, products: DataFrame, open_events: DataFrame) -> DataFrame:
    """(source, n_products, n_documents, missing, stale, open_events, samples, ok) by source: counts, documents without a product and
    products without one, events that still wait, and the five documents of least hash."""
    docs = store.read().select("source", F.col("product_id").alias("id"), "name")
    both = products.select("source", "id").join(docs.withColumnRenamed("name", "_name").withColumn("_doc", F.lit(True)), ["source", "id"], "full_outer").join(products.select("id", F.lit(True).alias("_product")), "id", "left")
    least = F.struct(F.xxhash64("id").alias("h"), "id", F.col("_name").alias("name"))
    n = both.groupBy("source").agg(
        F.count("_product").alias("n_products"),
        F.count("_doc").alias("n_documents"),
        F.count_if(F.col("_doc").isNull()).alias("missing"),
        F.count_if(F.col("_product").isNull()).alias("stale"),
    )
    sampled = both.where("_doc").select("source", least.alias("s"))
    first = F.row_number().over(Window.partitionBy("source").orderBy("s"))
    samples = sampled.withColumn("_k", first).where("_k <= 5").groupBy("source").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("samples"))
    waits = open_events.where(F.col("status").isin("pending", "processing")).groupBy("source").agg(F.count("*").alias("open_events"))
    out = n.join(samples, "source", "left").join(waits, "source", "left").na.fill(0, ["open_events"])
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("stale") == 0) & (F.col("open_events") == 0))


def apply_batch(store: Store, events: DataFrame, products: DataFrame, specs: DataFrame, latest: DataFrame, token: str) -> bool:
    """Apply change events (id, product_id, event_type, created_at) to the stored documents as one publication.

    Upserts of active products take their present document, deletes and upserts of other products remove theirs, deletes after upserts;
    events of unknown types or products change nothing. Only the sources that the events touch are rewritten. A ``token`` known
    already leaves the store as it is.
    """
    if store.knows(token):
        return False
    actions = outbox.split_events(events, products)
    touched = products.join(actions.where("action <> 'unsupported'").select(F.col("product_id").alias("id")).distinct(), "id", "left_semi")
    sources = [r.source for r in touched.select("source").distinct().collect()]
    fresh = search_documents(products.join(actions.where("action = 'upsert'").select(F.col("product_id").alias("id")), "id", "left_semi"), specs, latest)
    by_product = lambda df: df.withColumn("_index", F.col("id")).withColumn("id", F.col("product_id"))
    done = outbox.apply_events(by_product(store.read(sources)), by_product(fresh), actions).withColumn("id", F.col("_index")).drop("_index")
    return store.publish(done, sources, token=token)
