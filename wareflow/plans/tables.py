"""Catalog tables over the benchmark tables: products, specs, price history, outbox, bundles, requests.

``SOURCES`` are SQL select statements that Spark and DuckDB both take; {sha} stands for the SHA-256 function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_URL = "'https://shop.example/p/' || CAST({k} AS STRING) || '.html'"


def _id(key: str) -> str:
    return "'shop:' || substr({sha}(" + _URL.replace("{k}", key) + "{end}), 1, 16)"


SOURCES = {
    "products": f"""SELECT {_id("p_partkey")} AS id, p_partkey, {_URL.replace("{k}", "p_partkey")} AS source_url, 'shop' AS source, p_name AS name, p_brand AS brand,
 lower(p_type) AS category, CAST(round(p_retailprice * 100) AS BIGINT) AS price_vnd, p_size,
 CASE WHEN p_size = 50 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN p_size = 49 THEN 'x' END AS deleted_at,
 CASE p_size % 4 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN '' ELSE NULL END AS stock_status
 FROM part""",
    "specs": f"""SELECT {_id("p_partkey")} AS product_id, p_size,
 CASE WHEN p_type = 'ECONOMY' THEN 4 + p_size % 12 END AS cpu_cores,
 CASE WHEN p_type = 'ECONOMY' THEN 'Core i5-12' || CAST(100 + p_size AS STRING) END AS cpu_model,
 CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN CASE WHEN p_size % 5 = 0 THEN 'AM' || CAST(4 + p_size % 2 AS STRING) ELSE 'LGA' || CAST(1700 + p_size % 8 AS STRING) END END AS socket,
 CASE WHEN p_type = 'STANDARD' THEN CASE p_size % 3 WHEN 0 THEN 'ATX' WHEN 1 THEN 'Micro-ATX' ELSE 'Mini-ITX' END END AS form_factor,
 CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'DDR' || CAST(4 + p_size % 2 AS STRING) END AS ram_type,
 CASE WHEN p_type = 'MEDIUM' THEN 8 * (1 + p_size % 12) END AS ram_gb,
 CASE WHEN p_type = 'STANDARD' THEN 32 * (1 + p_size % 3) END AS max_ram_gb,
 CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_size % 2 = 0 THEN 'RTX ' ELSE 'Radeon RX ' END || CAST(3000 + 10 * (p_size % 10) AS STRING) END AS gpu_model,
 CASE WHEN p_type = 'PROMO' THEN 4 + p_size % 12 END AS gpu_vram_gb,
 CASE WHEN p_type = 'LARGE' THEN 256 * (1 + p_size % 8) END AS storage_gb,
 CASE WHEN p_type = 'SMALL' THEN 350 + 4 * p_size END AS psu_wattage_w,
 CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 80 + 5 * p_size END AS recommended_psu_w
 FROM part""",
    "items": f"""SELECT {_id("p_partkey")} AS id, p_partkey, {_URL.replace("{k}", "p_partkey")} AS source_url, CASE WHEN p_partkey % 7 = 0 THEN 'depot' ELSE 'shop' END AS source,
 'SKU-' || CAST(p_partkey AS STRING) AS sku, replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS STRING) AS slug,
 CASE p_type WHEN 'SMALL' THEN 'Máy tính laptop ' WHEN 'ECONOMY' THEN 'Bộ vi xử lý ' WHEN 'STANDARD' THEN 'Mainboard ' WHEN 'MEDIUM' THEN 'Bộ nhớ RAM ' WHEN 'PROMO' THEN 'Card màn hình ' ELSE 'Ổ cứng SSD ' END || p_name AS name,
 p_brand AS brand, CASE p_type WHEN 'SMALL' THEN 'laptop' WHEN 'ECONOMY' THEN 'cpu' WHEN 'STANDARD' THEN 'mainboard' WHEN 'MEDIUM' THEN 'ram' WHEN 'PROMO' THEN 'gpu' ELSE 'ssd' END AS category,
 CASE WHEN p_size % 3 = 0 THEN 'gaming' END AS subcategory, '["Trang chủ", " ' || lower(p_type) || ' ", ""]' AS breadcrumbs,
 'https://img.example/' || CAST(p_partkey AS STRING) || '.jpg' AS thumbnail_url, CAST(round(p_retailprice * 100) AS BIGINT) AS price_vnd,
 CAST(round(p_retailprice * 110) AS BIGINT) AS list_price_vnd, CASE WHEN p_size % 2 = 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) END AS sale_price_vnd, CAST(round(p_retailprice * 95) AS BIGINT) AS build_pc_price_vnd,
 CASE WHEN p_size = 50 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN p_size = 49 THEN 'x' END AS deleted_at,
 CASE p_size % 4 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN '' ELSE NULL END AS stock_status, p_size AS stock_quantity,
 'Bảo hành ' || CAST(p_size AS STRING) || ' tháng' AS warranty_text, p_size AS warranty_months, CAST('2024-01-' || CAST(10 + p_size % 20 AS STRING) || ' 00:00:00' AS TIMESTAMP) AS updated_at
 FROM part""",
    "item_specs": f"""SELECT {_id("p_partkey")} AS product_id, lower(p_type) AS product_type, CASE WHEN p_size % 5 = 0 THEN upper(p_name) END AS model,
 CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN CASE WHEN p_size % 2 = 0 THEN 'Core i5-12' || CAST(100 + p_size AS STRING) || 'F' ELSE 'Ryzen 7 5' || CAST(700 + p_size AS STRING) || 'X' END END AS cpu_model,
 CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'LGA' || CAST(1700 + p_size % 8 AS STRING) END AS socket,
 CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 8 * (1 + p_size % 12) END AS ram_gb, CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'DDR' || CAST(4 + p_size % 2 AS STRING) END AS ram_type,
 CASE WHEN p_type = 'MEDIUM' THEN 3200 END AS ram_speed_mhz, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 256 * (1 + p_size % 8) END AS storage_gb, CASE WHEN p_type = 'LARGE' THEN 'SSD NVMe' END AS storage_type,
 CASE WHEN p_type IN ('SMALL', 'PROMO') AND p_size % 3 > 0 THEN CASE WHEN p_size % 2 = 0 THEN 'GeForce RTX ' || CAST(3000 + 10 * (p_size % 10) AS STRING) || ' Ti' ELSE 'Radeon RX ' || CAST(6000 + 10 * (p_size % 10) AS STRING) END END AS gpu_model,
 CASE WHEN p_type = 'PROMO' THEN 4 + p_size % 12 END AS gpu_vram_gb, CASE WHEN p_type = 'SMALL' THEN 13.5 + p_size % 4 END AS screen_inches, CASE WHEN p_type = 'SMALL' THEN 'Full HD' END AS resolution_label,
 CASE WHEN p_type = 'SMALL' AND p_size % 2 = 0 THEN 144 END AS refresh_rate_hz, CASE WHEN p_type = 'SMALL' THEN 'IPS' END AS panel_type, CASE WHEN p_type = 'STANDARD' THEN 'ATX' END AS form_factor,
 CASE WHEN p_type = 'PROMO' THEN 550 END AS recommended_psu_w
 FROM part""",
    "questions": """SELECT p_partkey AS query_id, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN 'Máy tính ' || p_name WHEN 2 THEN 'may tinh lapotp' WHEN 3 THEN 'lapotp ' || p_name WHEN 4 THEN 'mainbord ' || p_name || ' atx'
 WHEN 5 THEN 'i5-12' || CAST(100 + p_size AS STRING) || 'f' WHEN 6 THEN 'zzzzz ' || p_name ELSE p_brand || ' card man hinh rtx' END AS text FROM part WHERE p_partkey % 20 = 0""",
    "prices": f"""SELECT {_id("l_partkey")} AS product_id, l_shipdate AS captured_at, l_shipdate AS created_at, l_orderkey, l_linenumber,
 CAST(round(l_extendedprice / l_quantity / 100) AS BIGINT) AS price_vnd, CASE l_linestatus WHEN 'O' THEN 'in_stock' ELSE 'out_of_stock' END AS stock_status
 FROM lineitem""",
    "outbox": """SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'delete' WHEN 'error' THEN 'reindex' ELSE 'upsert' END AS event_type,
 user_id AS part, ts AS created_at, CASE WHEN event_id % 7 < 3 THEN 'pending' WHEN event_id % 7 = 3 THEN 'processing' WHEN event_id % 7 = 4 THEN 'failed' ELSE 'done' END AS status,
 CAST(event_id % 5 AS INT) AS attempts FROM events""",
    "requests": """SELECT c_custkey AS request_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'gaming' WHEN 'MACHINERY' THEN 'office' WHEN 'AUTOMOBILE' THEN 'video_editing' WHEN 'FURNITURE' THEN '3d_render' ELSE 'general' END AS use_case,
 CASE c_nationkey % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'balanced' ELSE 'budget' END AS priority,
 CASE c_nationkey % 4 WHEN 0 THEN 'intel' WHEN 1 THEN 'amd' ELSE 'any' END AS cpu_preference, CASE c_nationkey % 5 WHEN 0 THEN 'nvidia' WHEN 1 THEN 'amd' ELSE 'any' END AS gpu_preference,
 CAST(round((c_acctbal + 1000) * 100) AS BIGINT) + 1 AS budget_vnd FROM customer""",
    "bundle_lines": f"""SELECT l_orderkey AS bundle_id, {_id("l_partkey")} AS product_id FROM lineitem GROUP BY l_orderkey, l_partkey""",
}
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = SOURCES[name].replace("{sha}", "sha2").replace("{end}", ", 256")
    base = sql.split("FROM ")[1].split()[0].rstrip()
    return spark.sql(sql.replace(f"FROM {base}", "FROM {t}"), t=load(spark, sf_dir, base))


def with_tables(sql: str, *names: str) -> str:
    """``sql`` for DuckDB with the named catalog tables in front."""
    parts = [f"{n} AS ({SOURCES[n].replace('{sha}', 'sha256').replace('{end}', '').replace('STRING', 'VARCHAR')})" for n in names]
    more = sql.strip()
    recursive = "RECURSIVE " if more.upper().startswith("WITH RECURSIVE") else ""
    if more.upper().startswith("WITH"):
        more = more[len("WITH RECURSIVE " if recursive else "WITH ") :]
        return f"WITH {recursive}{', '.join(parts)}, {more}"
    return f"WITH {', '.join(parts)} {more}"
