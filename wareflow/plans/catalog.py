"""Queries over the catalog: prices, filters, serving, imports, outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareflow.functions import security, text
from wareflow.operators import filters, ingest, merge, outbox, prices, serving

from .registry import Tables, query

TIE = ["l_orderkey", "l_linenumber"]
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY captured_at DESC, created_at DESC, l_orderkey DESC, l_linenumber DESC) rn FROM prices) WHERE rn = 1)"
_ACTIVE = "source = 'shop' AND status = 'active' AND deleted_at IS NULL"


def catalog(t: Tables):
    return serving.denormalised(t.products.where(filters.active("shop")).drop("p_size"), t.specs, prices.latest_prices(t.prices, TIE))


@query(f"WITH {_LATEST} SELECT p.id, p.name, p.brand, p.category, COALESCE(l.price_vnd, p.price_vnd) AS price_vnd, COALESCE(l.stock_status, p.stock_status) AS stock_status FROM products p LEFT JOIN latest l ON l.product_id = p.id WHERE {_ACTIVE} ORDER BY 5, 1 LIMIT 100", "products prices")
def current_catalog(t: Tables):
    """Active products at their latest price, cheapest first."""
    rows = catalog(t)
    price = prices.effective(F.col("current_price_vnd"), F.col("price_vnd"))
    rows = rows.select("id", "name", "brand", "category", price.alias("price_vnd"), F.coalesce("current_stock_status", "stock_status").alias("stock_status"))
    return rows.orderBy("price_vnd", "id").limit(100)


@query(f"WITH {_LATEST} SELECT product_id, captured_at, price_vnd, stock_status, l_orderkey FROM latest", "prices")
def latest_price(t: Tables):
    return prices.latest_prices(t.prices, TIE).select("product_id", "captured_at", "price_vnd", "stock_status", "l_orderkey")


@query(f"SELECT category, count(*) AS n FROM products WHERE {_ACTIVE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "products")
def category_counts(t: Tables):
    return serving.category_counts(t.products.where(filters.active("shop")))


@query("SELECT source, count(*) AS n FROM products WHERE status = 'active' AND deleted_at IS NULL GROUP BY 1", "products")
def active_per_source(t: Tables):
    return t.products.where(filters.active("shop")).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH h AS (SELECT id, name, price_vnd FROM products WHERE {_ACTIVE} AND price_vnd > 1), n AS (SELECT count(*) AS total_hits FROM h) SELECT h.*, total_hits, CAST(ceil(total_hits / 24.0) AS BIGINT) AS total_pages FROM h, n ORDER BY price_vnd, id LIMIT 24 OFFSET 24", "products")
def browse_page(t: Tables):
    """Second page of the browse view with totals."""
    hits = t.products.where(filters.active("shop") & filters.priced(F.lit(None).cast("long"), F.col("price_vnd"))).select("id", "name", "price_vnd")
    return filters.page(hits, filters.sort_order("price_asc"), 2)


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 24")
def newest_k(t: Tables):
    return t.orders.select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(24)


@query(f"WITH h AS (SELECT * FROM products p JOIN specs s ON s.product_id = p.id WHERE {_ACTIVE}) SELECT 'brand' AS facet, brand AS value, count(*) AS n FROM h GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM h GROUP BY 2 UNION ALL SELECT 'ram_gb', CAST(ram_gb AS VARCHAR), count(*) FROM h WHERE ram_gb IS NOT NULL GROUP BY 2", "products specs")
def facet_counts(t: Tables):
    return serving.facets(catalog(t), ["brand", "category", "ram_gb"])


@query(f"SELECT id, brand, price_vnd, ram_gb FROM products p JOIN specs s ON s.product_id = p.id WHERE {_ACTIVE} AND brand IN ('Brand#2', 'Brand#7', 'Brand#11') AND price_vnd >= 91000 AND price_vnd <= 99000 AND ram_gb >= 16", "products specs")
def typed_filter(t: Tables):
    keep = filters.catalog_filter({"brand": "Brand#2, Brand#7,Brand#11", "price_min": 91000, "price_max": "99000", "ram_min": 16, "socket": ""}, source="shop")
    return catalog(t).where(keep).select("id", "brand", "price_vnd", "ram_gb")


@query("""SELECT role, count(*) AS n, sum(price_vnd) AS total FROM (
SELECT 'cpu' AS role, price_vnd FROM products JOIN specs ON id = product_id WHERE cpu_cores IS NOT NULL
UNION ALL SELECT 'mobo', price_vnd FROM products JOIN specs ON id = product_id WHERE form_factor IS NOT NULL AND cpu_cores IS NULL
UNION ALL SELECT 'ram', price_vnd FROM products JOIN specs ON id = product_id WHERE ram_gb IS NOT NULL AND psu_wattage_w IS NULL AND cpu_cores IS NULL
UNION ALL SELECT 'gpu', price_vnd FROM products JOIN specs ON id = product_id WHERE gpu_model IS NOT NULL
UNION ALL SELECT 'storage', price_vnd FROM products JOIN specs ON id = product_id WHERE storage_gb IS NOT NULL AND cpu_cores IS NULL AND gpu_model IS NULL
UNION ALL SELECT 'psu', price_vnd FROM products JOIN specs ON id = product_id WHERE psu_wattage_w IS NOT NULL) GROUP BY 1""", "products specs")
def role_members(t: Tables):
    roles = F.explode(F.array_compact(F.array(*[F.when(F.expr(sql), F.lit(r)) for r, sql in filters.ROLES.items()])))
    rows = t.products.drop("p_size").join(t.specs, F.col("id") == F.col("product_id"))
    return rows.select("price_vnd", roles.alias("role")).groupBy("role").agg(F.count("*").alias("n"), F.sum("price_vnd").alias("total"))


@query("SELECT id, socket FROM products JOIN specs ON id = product_id WHERE cpu_cores IS NOT NULL AND (brand ILIKE '%intel%' OR socket ILIKE 'LGA%')", "products specs")
def vendor_preference(t: Tables):
    rows = t.products.drop("p_size").join(t.specs, F.col("id") == F.col("product_id"))
    return rows.where(F.expr(filters.ROLES["cpu"]) & filters.preference("cpu", "intel")).select("id", "socket")


@query(f"WITH {_LATEST} SELECT p.id, COALESCE(l.price_vnd, p.price_vnd) AS price, COALESCE(NULLIF(l.stock_status, ''), p.stock_status) AS stock, CASE WHEN p.price_vnd > l.price_vnd THEN CAST(round((p.price_vnd - l.price_vnd) / p.price_vnd * 100) AS INT) END AS percent_off FROM products p LEFT JOIN latest l ON l.product_id = p.id", "products prices")
def price_tags(t: Tables):
    """Effective price and stock, and the discount against the list price."""
    rows = serving.denormalised(t.products.drop("p_size"), t.specs, prices.latest_prices(t.prices, TIE))
    stock = F.coalesce(F.nullif(F.col("current_stock_status"), F.lit("")), F.col("stock_status"))
    price = prices.effective(F.col("current_price_vnd"), F.col("price_vnd"))
    return rows.select("id", price.alias("price"), stock.alias("stock"), prices.discount_percent(F.col("price_vnd"), F.col("current_price_vnd")).alias("percent_off"))


@query(f"SELECT id, name || '-' || p_partkey AS slug, name AS title, price_vnd AS price, CASE WHEN stock_status <> '' THEN stock_status = 'in_stock' END AS in_stock FROM products WHERE {_ACTIVE}", "products")
def hit_summary(t: Tables):
    return serving.summary(t.products.where(filters.active("shop")).withColumn("slug", F.concat_ws("-", "name", "p_partkey")))


@query("WITH k AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'part-' || (o_custkey * 2) ELSE 'shop:' || substr(sha256('https://shop.example/p/' || (o_custkey * 2) || '.html'), 1, 16) END AS key FROM orders), f AS (SELECT key, id FROM k JOIN products ON key = id UNION ALL SELECT key, id FROM k JOIN products ON key = 'part-' || p_partkey) SELECT 'found' AS state, count(*) AS n FROM f UNION ALL SELECT 'missing', count(*) FROM k WHERE key NOT IN (SELECT key FROM f)", "products")
def key_resolution(t: Tables):
    """Keys by id or slug, with those that name no product."""
    url = F.concat(F.lit("https://shop.example/p/"), (F.col("o_custkey") * 2).cast("string"), F.lit(".html"))
    keys = t.orders.select(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("part-"), (F.col("o_custkey") * 2).cast("string"))).otherwise(text.product_id(F.lit("shop"), url)).alias("key"))
    found, missing = filters.resolve_keys(keys, t.products.select("id", F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("slug")))
    n = lambda df, s: df.agg(F.count("*").alias("n")).select(F.lit(s).alias("state"), "n")
    return n(found, "found").unionByName(n(missing, "missing"))


@query("SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(sha256(source_url), 1, 8) AS slug, replace(id, ':', '_') AS doc_id FROM products", "products")
def product_ids(t: Tables):
    p = t.products
    return p.select(text.product_id(F.col("source"), F.col("source_url")).alias("id"), text.slug(F.col("name"), F.col("source_url")).alias("slug"), text.index_id(F.col("id")).alias("doc_id"))


@query("SELECT id, sha256('{\"build_pc_price_vnd\":null,\"list_price_vnd\":' || price_vnd || ',\"price_vnd\":' || price_vnd || ',\"regional_price_vnd\":null,\"sale_price_vnd\":null,\"stock_quantity\":' || p_size || ',\"stock_status\":' || CASE WHEN stock_status IS NULL THEN 'null' ELSE '\"' || stock_status || '\"' END || '}') AS price_hash FROM products", "products")
def price_state_hashes(t: Tables):
    none = F.lit(None).cast("long")
    return t.products.select("id", security.price_state_hash(F.col("price_vnd"), F.col("price_vnd"), none, none, none, F.col("stock_status"), F.col("p_size")).alias("price_hash"))


@query("SELECT product_id, captured_at, price_vnd, stock_status, l_orderkey, l_linenumber FROM (SELECT *, lag(price_vnd || stock_status) OVER (PARTITION BY product_id ORDER BY captured_at, created_at, l_orderkey, l_linenumber) AS b FROM prices) WHERE b IS NULL OR b <> price_vnd || stock_status", "prices")
def price_changes(t: Tables):
    """Rows of the price history that change a product's state."""
    rows = t.prices.withColumn("state", F.concat(F.col("price_vnd").cast("string"), "stock_status"))
    return prices.price_changes(rows, "state", ["captured_at", "created_at", *TIE]).drop("state", "created_at")


@query("WITH old AS (SELECT * FROM prices WHERE captured_at < TIMESTAMP '1998-01-01'), l AS (SELECT product_id, price_vnd || stock_status AS h FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY captured_at DESC, created_at DESC, l_orderkey DESC, l_linenumber DESC) rn FROM old) WHERE rn = 1), n AS (SELECT product_id, price_vnd || stock_status AS price_hash FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY captured_at DESC, created_at DESC, l_orderkey DESC, l_linenumber DESC) rn FROM prices WHERE captured_at >= TIMESTAMP '1998-01-01') WHERE rn = 1) SELECT n.product_id, n.price_hash FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.product_id = n.product_id AND l.h = n.price_hash)", "prices")
def price_append(t: Tables):
    """What an import appends to the price history: states that differ from the latest stored one."""
    rows = t.prices.withColumn("price_hash", F.concat(F.col("price_vnd").cast("string"), "stock_status"))
    cut = F.lit("1998-01-01").cast("timestamp")
    fresh = prices.latest_prices(rows.where(F.col("captured_at") >= cut), TIE)
    return prices.append_changed(rows.where(F.col("captured_at") < cut), fresh, TIE).select("product_id", "price_hash")


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS ord, o_orderstatus AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS b, o_totalprice AS c, o_orderdate < TIMESTAMP '1998-01-01' AS old FROM orders),
f AS (SELECT k, old, arg_max(a, ord) AS a, arg_max(b, ord) FILTER (WHERE b IS NOT NULL) AS b, arg_min(c, ord) AS c FROM o GROUP BY k, old)
SELECT COALESCE(n.k, p.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.a ELSE p.a END AS a, COALESCE(n.b, p.b) AS b, CASE WHEN p.k IS NOT NULL THEN p.c ELSE n.c END AS c FROM (SELECT * FROM f WHERE old) p FULL JOIN (SELECT * FROM f WHERE NOT old) n ON n.k = p.k""")
def merge_policies(t: Tables):
    """Dump A merged with dump B: overwrite, fill, and keep by column."""
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("b"), F.col("o_totalprice").alias("c"), "o_orderdate")
    cut = F.lit("1998-01-01").cast("timestamp")
    fold = lambda df: merge.fold_batch(df, "k", "ord", ["a"], ["b"], ["c"])
    return merge.upsert(fold(rows.where(F.col("o_orderdate") < cut)), fold(rows.where(F.col("o_orderdate") >= cut)), "k", ["a"], ["b"], ["c"])


@query("SELECT count(*) AS n, count(DISTINCT payload_hash) AS hashes FROM (SELECT DISTINCT sha256(text) AS payload_hash, source FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.source = d.source AND sha256(e.text) = sha256(d.text)))")
def raw_dedupe(t: Tables):
    """Payloads that a second dump (odd ids) adds to the first (even ids)."""
    rows = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("payload_hash"))
    new = merge.insert_absent(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), ["source", "payload_hash"])
    return new.agg(F.count("*").alias("n"), F.countDistinct("payload_hash").alias("hashes"))


_SPECROWS = "v AS (SELECT product_id, k AS spec_key, v AS value_text FROM (SELECT product_id, unnest(['cpu_cores', 'socket', 'ram_gb', 'ram_type', 'storage_gb', 'gpu_model']) AS k, unnest([CAST(cpu_cores AS VARCHAR), socket, CAST(ram_gb AS VARCHAR), ram_type, CAST(storage_gb AS VARCHAR), gpu_model]) AS v FROM specs) WHERE v IS NOT NULL)"
SPEC_KEYS = ["cpu_cores", "socket", "ram_gb", "ram_type", "storage_gb", "gpu_model"]


def spec_rows(t: Tables):
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in SPEC_KEYS]))
    return ingest.spec_values(t.specs.select(F.col("product_id").alias("id"), pairs.alias("normalized_specs")))


@query(f"WITH {_SPECROWS} SELECT product_id, spec_key, value_text, TRY_CAST(value_text AS DOUBLE) AS value_num, CASE WHEN spec_key IN ('ram_gb', 'storage_gb') THEN 'gb' END AS unit, CASE WHEN spec_key IN ('cpu_cores', 'socket') THEN 'cpu' WHEN spec_key IN ('ram_gb', 'ram_type') THEN 'ram' WHEN spec_key = 'storage_gb' THEN 'storage' ELSE 'gpu' END AS group_name FROM v", "specs")
def spec_values(t: Tables):
    """Long form of the specifications."""
    return spec_rows(t).select("product_id", "spec_key", "value_text", "value_num", "unit", "group_name")


@query(f"WITH {_SPECROWS} SELECT spec_key, count(*) AS n, count(DISTINCT product_id) AS products FROM (SELECT * FROM v WHERE product_id NOT IN (SELECT product_id FROM v WHERE spec_key = 'socket') UNION ALL SELECT product_id, spec_key, value_text FROM v WHERE spec_key = 'socket') GROUP BY 1", "specs")
def spec_replace(t: Tables):
    """Long rows after a second import that only has sockets: products with new rows lose their old ones."""
    v = spec_rows(t)
    return merge.replace_children(v, v.where("spec_key = 'socket'"), "product_id").groupBy("spec_key").agg(F.count("*").alias("n"), F.countDistinct("product_id").alias("products"))


@query("SELECT id AS product_id, t AS chunk_type, sha256(c) AS content_hash, CAST(floor(length(c) / 4) AS BIGINT) AS token_count FROM (SELECT id, unnest(['title', 'description', 'specs', 'raw_specs', 'warranty']) AS t, unnest([name || ' | brand=' || brand || ' | category=' || category, '', 'ram_gb: ' || p_size, '{\"k\":\"' || p_size || '\"}', '12 tháng (12 tháng)']) AS c FROM products)", "products")
def text_chunks(t: Tables):
    none = F.lit(None).cast("string")
    rows = t.products.select("id", "name", "brand", "category", none.alias("description"), F.lit("12 tháng").alias("warranty"), text.warranty_months(F.lit("12 tháng")).alias("warranty_months"), F.create_map(F.lit("k"), F.col("p_size").cast("string")).alias("raw_specs"), F.create_map(F.lit("ram_gb"), F.col("p_size").cast("string")).alias("normalized_specs"))
    return ingest.chunks(rows).select("product_id", "chunk_type", "content_hash", "token_count")


@query("SELECT seed, id, rank FROM (SELECT s.id AS seed, p.id, row_number() OVER (PARTITION BY s.id ORDER BY p.price_vnd DESC, p.id) AS rank FROM products s JOIN products p ON p.category = s.category AND p.id <> s.id) WHERE rank <= 4", "products")
def related_products(t: Tables):
    """Four related products of every product."""
    p = t.products.select("id", "category", "price_vnd")
    return serving.related(p, p, 4, "price_vnd")


@query(f"WITH {_SPECROWS} SELECT product_id, string_agg(g || '/' || spec_key || '=' || value_text, ';' ORDER BY g, spec_key) AS specs FROM (SELECT *, CASE WHEN spec_key IN ('cpu_cores', 'socket') THEN 'cpu' WHEN spec_key IN ('ram_gb', 'ram_type') THEN 'ram' WHEN spec_key = 'storage_gb' THEN 'storage' ELSE 'gpu' END AS g FROM v) GROUP BY 1", "specs")
def product_details(t: Tables):
    """Grouped specifications of every product."""
    g = serving.grouped_specs(spec_rows(t))
    line = F.transform("specs", lambda s: F.concat(s["group"], F.lit("/"), s["key"], F.lit("="), s["value"]))
    return g.select("product_id", F.array_join(line, ";").alias("specs"))


@query(f"WITH {_SPECROWS}, k AS (SELECT id FROM products WHERE p_partkey IN (0, 1, 2)) SELECT spec_key, COALESCE(max(value_text) FILTER (WHERE product_id = (SELECT id FROM products WHERE p_partkey = 0)), '—') AS a, COALESCE(max(value_text) FILTER (WHERE product_id = (SELECT id FROM products WHERE p_partkey = 1)), '—') AS b, COALESCE(max(value_text) FILTER (WHERE product_id = (SELECT id FROM products WHERE p_partkey = 2)), '—') AS c FROM v WHERE product_id IN (SELECT id FROM k) GROUP BY 1", "specs products")
def compare_matrix(t: Tables):
    import hashlib

    ids = ["shop:" + hashlib.sha256(f"https://shop.example/p/{k}.html".encode()).hexdigest()[:16] for k in (0, 1, 2)]
    m = serving.compare_matrix(spec_rows(t), ids)
    return m.select("spec_key", *[F.col(f"`{i}`").alias(n) for i, n in zip(ids, "abc", strict=True)])


@query(f"WITH {_SPECROWS}, r AS (SELECT product_id, unnest(['socket', 'ram_gb']) AS spec_key FROM specs) SELECT r.product_id, r.spec_key, COALESCE(v.value_text, '(không có)') AS value FROM r LEFT JOIN v ON v.product_id = r.product_id AND v.spec_key = r.spec_key", "specs")
def requested_specs(t: Tables):
    asked = t.specs.select("product_id", F.explode(F.array(F.lit("socket"), F.lit("ram_gb"))).alias("spec_key"))
    return serving.requested_specs(asked, spec_rows(t))


@query("SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed FROM outbox", "outbox")
def outbox_counts(t: Tables):
    return outbox.status_counts(t.outbox)


@query("SELECT id, created_at FROM outbox WHERE status = 'pending' ORDER BY created_at, id LIMIT 500", "outbox")
def outbox_claim(t: Tables):
    return outbox.claim(t.outbox, 500).select("id", "created_at")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'processing' AND created_at < TIMESTAMP '2024-01-20' - INTERVAL 30 MINUTE THEN 'pending' ELSE status END AS status FROM outbox) GROUP BY 1", "outbox")
def outbox_requeue(t: Tables):
    return outbox.requeue_stale(t.outbox, 30, F.lit("2024-01-20").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT status, attempts, count(*) AS n FROM (SELECT CASE WHEN attempts + 1 < 5 THEN 'pending' ELSE 'failed' END AS status, attempts + 1 AS attempts FROM outbox WHERE status = 'processing') GROUP BY 1, 2", "outbox")
def outbox_retry(t: Tables):
    return outbox.after_failure(t.outbox.where("status = 'processing'"), F.lit("x" * 2000)).groupBy("status", "attempts").agg(F.count("*").alias("n"))


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN event_type = 'delete' THEN 'delete' WHEN event_type = 'upsert' THEN CASE WHEN p.status = 'active' AND deleted_at IS NULL THEN 'upsert' ELSE 'delete' END ELSE 'unsupported' END AS action FROM outbox o JOIN products p ON p.p_partkey = o.part) GROUP BY 1", "outbox products")
def outbox_actions(t: Tables):
    events = t.outbox.join(t.products.select(F.col("p_partkey").alias("part"), F.col("id").alias("product_id")), "part")
    return outbox.split_events(events, t.products).groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM products p WHERE status = 'active' AND deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM outbox o WHERE o.part = p.p_partkey AND event_type = 'upsert' AND o.status IN ('pending', 'processing'))", "products outbox")
def outbox_enqueue(t: Tables):
    events = t.outbox.join(t.products.select(F.col("p_partkey").alias("part"), F.col("id").alias("product_id")), "part")
    return outbox.enqueue_all(t.products.where(filters.active("shop")), events).agg(F.count("*").alias("n"))


@query("WITH up AS (SELECT DISTINCT part FROM outbox JOIN products ON p_partkey = part WHERE event_type = 'upsert' AND products.status = 'active' AND deleted_at IS NULL), de AS (SELECT DISTINCT part FROM outbox JOIN products ON p_partkey = part WHERE event_type = 'delete' OR (event_type = 'upsert' AND NOT (products.status = 'active' AND deleted_at IS NULL))), d AS (SELECT p_partkey, CASE WHEN p_partkey IN (SELECT part FROM up) THEN 2 ELSE 1 END AS version FROM products WHERE p_partkey % 2 = 0 OR p_partkey IN (SELECT part FROM up)) SELECT version, count(*) AS n FROM d WHERE p_partkey NOT IN (SELECT part FROM de) GROUP BY 1", "outbox products")
def outbox_apply(t: Tables):
    """Document snapshot after all events: upserts, then deletes."""
    events = t.outbox.join(t.products.select(F.col("p_partkey").alias("part"), F.col("id").alias("product_id")), "part")
    docs = t.products.select("id", "p_partkey")
    out = outbox.apply_events(docs.where("p_partkey % 2 = 0").withColumn("version", F.lit(1)), docs.withColumn("version", F.lit(2)), outbox.split_events(events, t.products))
    return out.groupBy("version").agg(F.count("*").alias("n"))


@query("SELECT 'shop' AS source, (SELECT count(*) FROM products) AS n_source, (SELECT count(*) FROM products WHERE status = 'active') AS n_documents, (SELECT count(*) FROM products) = (SELECT count(*) FROM products WHERE status = 'active') AS ok", "products")
def reconcile_documents(t: Tables):
    return serving.reconcile(t.products, t.products.where("status = 'active'"))


@query(f"""WITH {_LATEST} SELECT replace(p.id, ':', '_') AS doc_id, COALESCE(l.price_vnd, p.price_vnd) AS price_vnd,
concat_ws(' / ', cpu_model, ram_gb || 'GB ' || ram_type, 'Storage ' || storage_gb || 'GB', gpu_model) AS spec_summary
FROM products p LEFT JOIN specs s ON s.product_id = p.id LEFT JOIN latest l ON l.product_id = p.id WHERE {_ACTIVE}""", "products specs prices")
def search_documents(t: Tables):
    rows = catalog(t)
    none = F.lit(None)
    line = text.spec_summary(F.col("cpu_model"), F.col("ram_gb"), F.col("ram_type"), F.col("storage_gb"), none.cast("string"), F.col("gpu_model"), none.cast("double"), none.cast("int"))
    return rows.select(text.index_id(F.col("id")).alias("doc_id"), F.coalesce("current_price_vnd", "price_vnd").alias("price_vnd"), line.alias("spec_summary"))


@query("SELECT id, replace(replace(printf('%,d', price_vnd), ',', '.'), ' ', '') || ' ₫' AS price_text, CASE stock_status WHEN 'in_stock' THEN 'Còn hàng' WHEN 'out_of_stock' THEN 'Hết hàng' ELSE 'Liên hệ' END AS stock_text FROM products", "products")
def display_texts(t: Tables):
    return t.products.select("id", text.money(F.col("price_vnd")).alias("price_text"), text.stock_text(F.col("stock_status")).alias("stock_text"))


@query(f"WITH {_SPECROWS} SELECT product_id, count(*) + CASE WHEN max(CASE WHEN spec_key = 'ram_gb' THEN 1 ELSE 0 END) = 1 THEN 3 ELSE 0 END AS expected FROM v GROUP BY 1", "specs")
def expected_spec_rows(t: Tables):
    """Expected long rows of each product; memory modules also have a list with a null element."""
    pairs = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))) for k in SPEC_KEYS], F.when(F.col("ram_gb").isNotNull(), F.struct(F.lit("ports").alias("key"), F.lit('["a", null, "b"]').alias("value")))))
    return ingest.expected_values(t.specs.select(F.col("product_id").alias("id"), F.map_from_entries(pairs).alias("normalized_specs")))
