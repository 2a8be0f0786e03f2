"""Link discovery over a table of fetched documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareflow.functions import urls


def locations(docs: DataFrame) -> DataFrame:
    """(url, pos, loc) of the <loc> entries of sitemap documents (url, xml)."""
    locs = F.transform(F.regexp_extract_all("xml", F.lit(r"<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    return docs.select("url", F.posexplode(locs).alias("pos", "loc")).where("loc <> ''")


def discover(docs: DataFrame, roots: list[str], hosts: list[str], max_depth: int = 4) -> DataFrame:
    """(loc, depth): product pages that are reachable from ``roots`` over sitemap documents, each once at its least depth.

    One equi-join for each level of the index. Only product sitemaps give product pages.
    """
    spark = docs.sparkSession
    links = locations(docs)
    front = spark.createDataFrame([(r,) for r in roots], "url string")
    seen, found = front, None
    for depth in range(1, max_depth + 1):
        out = links.join(front, "url", "left_semi")
        pages = out.where(urls.is_product_sitemap(F.col("url")) & urls.is_candidate(F.col("loc"), hosts)).select("loc", F.lit(depth).alias("depth"))
        found = pages if found is None else found.unionByName(pages)
        front = out.where(urls.is_xml(F.col("loc"))).select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = seen.unionByName(front)
    return found.groupBy("loc").agg(F.min("depth").alias("depth"))


def merge_seeds(found: DataFrame, seeds: DataFrame, known: DataFrame, limit: int | None = None) -> DataFrame:
    """(source_url, origin): discovered and seed URLs in canonical form, the first of each kept, without known ones."""
    both = found.select(urls.canonical(F.col("loc")).alias("source_url"), F.lit(0).alias("o")).unionByName(seeds.select(urls.canonical(F.col("loc")).alias("source_url"), F.lit(1).alias("o")))
    first = both.groupBy("source_url").agg(F.min("o").alias("o"))
    out = first.join(known.select(urls.canonical(F.col("source_url")).alias("source_url")), "source_url", "left_anti")
    out = out.select("source_url", F.when(F.col("o") == 0, "sitemap").otherwise("seed").alias("origin"))
    return out if limit is None else out.orderBy("source_url").limit(limit)


def pages_to_crawl(pages: DataFrame, done: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Pages (source_url, category) in canonical form, each once, not done yet; a category subset keeps "other"."""
    own = pages.withColumn("source_url", urls.canonical(F.col("source_url")))
    if categories is not None:
        own = own.where(F.col("category").isin(*categories, "other"))
    return own.dropDuplicates(["source_url"]).join(done.select("source_url"), "source_url", "left_anti")
