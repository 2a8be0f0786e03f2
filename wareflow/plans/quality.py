"""Queries that check data."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareflow.operators import ingest, quality

from .catalog import spec_rows
from .registry import Tables, query


@query("SELECT 'part' AS check_name, count(*) AS value, 'INFO' AS status FROM part UNION ALL SELECT 'orders', count(*), 'INFO' FROM orders UNION ALL SELECT 'lineitem', count(*), 'INFO' FROM lineitem UNION ALL SELECT 'customer', count(*), 'INFO' FROM customer UNION ALL SELECT 'supplier', count(*), 'INFO' FROM supplier UNION ALL SELECT 'documents', count(*), 'INFO' FROM documents")
def row_counts(t: Tables):
    return quality.union_all([quality.check(getattr(t, n), n, F.count("*")) for n in ("part", "orders", "lineitem", "customer", "supplier", "documents")])


_ORPHANS = "SELECT 'lineitem_part' AS check_name, count(*) AS value, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'lineitem_order', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'label_document', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'order_customer', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"


@query(_ORPHANS)
def referential_integrity(t: Tables):
    return quality.union_all([
        quality.orphans(t.lineitem, "l_partkey", t.part, "p_partkey", "lineitem_part"),
        quality.orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "lineitem_order"),
        quality.orphans(t.labels, "doc_id", t.documents, "doc_id", "label_document"),
        quality.orphans(t.orders, "o_custkey", t.customer, "c_custkey", "order_customer"),
    ])


@query(f"SELECT CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS verdict, count(*) AS n_checks, count(*) FILTER (WHERE status = 'FAIL') AS n_failed FROM ({_ORPHANS})")
def overall_verdict(t: Tables):
    return quality.verdict(referential_integrity(t))


@query("SELECT 'price_not_negative' AS check_name, count(*) FILTER (WHERE c_acctbal < 0) AS value, CASE WHEN count(*) FILTER (WHERE c_acctbal < 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM customer UNION ALL SELECT 'known_segment', count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')), CASE WHEN count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) = 0 THEN 'PASS' ELSE 'FAIL' END FROM customer UNION ALL SELECT 'name_present', 0, 'PASS'")
def constraint_suite(t: Tables):
    return quality.rule_counts(t.customer, {"price_not_negative": F.col("c_acctbal") >= 0, "known_segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "name_present": F.col("c_name") != ""})


@query("SELECT errors, stage, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_nationkey < 5 THEN 'nation' END) AS errors, 'parse' AS stage FROM customer) WHERE errors <> '' GROUP BY 1, 2")
def row_quarantine(t: Tables):
    bad = quality.quarantine(t.customer, {"balance": F.col("c_acctbal") >= 0, "nation": F.col("c_nationkey") >= 5}, "parse")[1]
    return bad.groupBy(F.array_join("errors", ",").alias("errors"), "stage").agg(F.count("*").alias("n"))


@query("SELECT source, sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_chunks(t: Tables):
    return quality.duplicates(t.documents.withColumn("content_hash", F.sha2("text", 256)), ["source", "content_hash"])


@query("SELECT product_id, price_vnd, stock_status, count(*) AS n FROM prices GROUP BY 1, 2, 3 HAVING count(*) > 1", "prices")
def duplicate_prices(t: Tables):
    """The strict form: any price state that occurs twice."""
    return quality.duplicates(t.prices, ["product_id", "price_vnd", "stock_status"])


@query("SELECT product_id, count(*) AS n FROM (SELECT *, lag(price_vnd || stock_status) OVER (PARTITION BY product_id ORDER BY captured_at, l_orderkey, l_linenumber) AS b FROM prices) WHERE b = price_vnd || stock_status GROUP BY 1", "prices")
def repeated_prices(t: Tables):
    """Only repeats that follow each other, since a price may return to an old value."""
    from pyspark.sql import Window

    state = F.concat(F.col("price_vnd").cast("string"), "stock_status")
    before = F.lag(state).over(Window.partitionBy("product_id").orderBy("captured_at", "l_orderkey", "l_linenumber"))
    return t.prices.withColumn("b", before).where(F.col("b") == state).groupBy("product_id").agg(F.count("*").alias("n"))


@query("SELECT column_name, filled, (SELECT count(*) FROM specs) - filled AS missing FROM (SELECT unnest(['cpu_cores', 'socket', 'ram_gb', 'gpu_model', 'storage_gb', 'psu_wattage_w']) AS column_name, unnest([count(cpu_cores), count(socket), count(ram_gb), count(gpu_model), count(storage_gb), count(psu_wattage_w)]) AS filled FROM specs)", "specs")
def wide_fill_counts(t: Tables):
    return quality.fill_counts(t.specs, ["cpu_cores", "socket", "ram_gb", "gpu_model", "storage_gb", "psu_wattage_w"])


@query("SELECT count(*) FILTER (WHERE price_vnd IS NULL) AS missing_price, count(*) FILTER (WHERE stock_status IS NULL) AS missing_stock, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS deleted FROM products", "products")
def coverage(t: Tables):
    return t.products.agg(F.count_if(F.col("price_vnd").isNull()).alias("missing_price"), F.count_if(F.col("stock_status").isNull()).alias("missing_stock"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"))


@query("SELECT max(length(url)) AS max_len, count(*) FILTER (WHERE url IS NULL) AS n_null, count(*) FILTER (WHERE length(url) > 255) AS n_long FROM pages")
def slug_lengths(t: Tables):
    return t.pages.agg(F.max(F.length("url")).alias("max_len"), F.count_if(F.col("url").isNull()).alias("n_null"), F.count_if(F.length("url") > 255).alias("n_long"))


@query("SELECT product_id FROM specs WHERE ram_gb > 90", "specs")
def wide_long_mismatches(t: Tables):
    """Products whose wide RAM differs from the long one (values above 90 are changed in the long form)."""
    long = spec_rows(t).withColumn("value_text", F.when((F.col("spec_key") == "ram_gb") & (F.col("value_num") > 90), "0").otherwise(F.col("value_text")))
    return quality.mismatches(t.specs, long, "product_id", "ram_gb").select("product_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1")
def key_uniqueness(t: Tables):
    return quality.duplicates(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("""WITH g AS (SELECT o_custkey % 40 AS run, count(*) AS total, count(*) FILTER (WHERE o_orderkey % 311 = 0) AS failed, count(*) FILTER (WHERE o_orderstatus <> 'P' OR o_custkey % 4 > 0) AS parsed FROM orders GROUP BY 1)
SELECT *, CASE WHEN failed = 0 THEN 'done' WHEN failed >= 0.01 * total OR parsed < 0.95 * total THEN 'failed' ELSE 'partial' END AS status FROM g""")
def run_status(t: Tables):
    failed, parsed = F.col("o_orderkey") % 311 == 0, (F.col("o_orderstatus") != "P") | (F.col("o_custkey") % 4 > 0)
    g = t.orders.groupBy((F.col("o_custkey") % 40).alias("run")).agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"), F.count_if(parsed).alias("parsed"))
    return g.withColumn("status", ingest.run_status(F.col("failed"), F.col("total"), F.col("parsed")))


_RUNS = "SELECT o_orderkey AS run_id, o_orderpriority AS source, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'partial' END AS status FROM orders"


@query(f"SELECT source, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id DESC) AS k FROM ({_RUNS}) WHERE status IN ('done', 'partial')) WHERE k = 1")
def latest_finished_run(t: Tables):
    runs = t.orders.selectExpr("o_orderkey AS run_id", "o_orderpriority AS source", "o_orderdate AS started_at", "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'partial' END AS status")
    return quality.latest_finished(runs, "source", [F.desc("started_at"), F.desc("run_id")]).select("source", "run_id", "status")


@query("SELECT 'parsed' AS counter, count(*) AS n FROM documents WHERE length(text) > 100 UNION ALL SELECT 'rejected', count(*) FROM documents WHERE length(text) <= 100")
def import_counters(t: Tables):
    d = t.documents
    return ingest.counters({"parsed": d.where(F.length("text") > 100), "rejected": d.where(F.length("text") <= 100)})
