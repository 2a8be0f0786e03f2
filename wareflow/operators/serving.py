"""What a shop front asks for: denormalised documents, counts, facets, related, detail, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def denormalised(products: DataFrame, specs: DataFrame, latest: DataFrame) -> DataFrame:
    """Products with their specs and latest price, one row each (both joins are one to one at most)."""
    price = latest.select("product_id", F.col("price_vnd").alias("current_price_vnd"), F.col("stock_status").alias("current_stock_status"))
    return products.join(specs, products.id == specs.product_id, "left").drop("product_id").join(price, products.id == price.product_id, "left").drop("product_id")


def category_counts(products: DataFrame, limit: int = 20) -> DataFrame:
    return products.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(limit)


def facets(hits: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of each value of ``columns`` over the hits, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return hits.select(pairs.alias("p")).where("p.value IS NOT NULL").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def related(seeds: DataFrame, products: DataFrame, k: int, recency: str) -> DataFrame:
    """(seed, id, rank): the k newest other products of each seed's category, for all seeds at once.

    The k + 1 newest of each category are listed first, in one row that all its seeds take; they are sent to all tasks, so seeds stay where they are.
    """
    newest = Window.partitionBy("category").orderBy(F.col(recency).desc(), "id")
    top = products.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= k + 1).select("category", "id", recency, "_n")
    lists = top.groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"]).alias("ids"))
    others = F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k)
    pairs = seeds.select("id", "category").join(F.broadcast(lists), "category").select(F.col("id").alias("seed"), F.posexplode(others).alias("rank", "id"))
    return pairs.select("seed", "id", (F.col("rank") + 1).alias("rank"))


def grouped_specs(values: DataFrame) -> DataFrame:
    """(product_id, specs): keys and values of each product in order of group (none last, as _) and key."""
    entry = F.struct(F.col("group_name").isNull().alias("_last"), F.coalesce("group_name", F.lit("_")).alias("group"), "spec_key", "value_text")
    ordered = F.sort_array(F.collect_list(entry))
    return values.groupBy("product_id").agg(F.transform(ordered, lambda e: F.struct(e["group"].alias("group"), e["spec_key"].alias("key"), e["value_text"].alias("value"))).alias("specs"))


def requested_specs(requests: DataFrame, values: DataFrame, default: str = "(không có)") -> DataFrame:
    """(product_id, spec_key, value): the last value of each key asked for, or the default."""
    last = values.groupBy("product_id", "spec_key").agg(F.max_by("value_text", F.coalesce("spec_index", F.lit(-1))).alias("value"))
    return requests.join(last, ["product_id", "spec_key"], "left").withColumn("value", F.coalesce("value", F.lit(default)))


def compare_matrix(values: DataFrame, products: list[str], missing: str = "—") -> DataFrame:
    """One row for each key, one column for each of the given 2 to 5 products."""
    if not 2 <= len(products) <= 5:
        raise ValueError("compare takes 2 to 5 products")
    return values.where(F.col("product_id").isin(*products)).groupBy("spec_key").pivot("product_id", products).agg(F.min_by("value_text", F.coalesce("spec_index", F.lit(-1)))).na.fill(missing)


def summary(hits: DataFrame) -> DataFrame:
    """id, slug, title, price and whether in stock (null when the status is empty)."""
    status = F.nullif(F.col("stock_status"), F.lit(""))
    return hits.select("id", "slug", F.col("name").alias("title"), F.col("price_vnd").alias("price"), (status == "in_stock").alias("in_stock"))


def reconcile(source_rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, n_source, n_documents, ok) by source."""
    a = source_rows.groupBy("source").agg(F.count("*").alias("n_source"))
    b = documents.groupBy("source").agg(F.count("*").alias("n_documents"))
    return a.join(b, "source", "full_outer").na.fill(0).withColumn("ok", F.col("n_source") == F.col("n_documents"))
