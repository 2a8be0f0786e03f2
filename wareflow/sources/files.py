"""Reading and writing dumps and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_dump(spark: SparkSession, path: str, schema: T.StructType | str, json_lines: bool = False) -> DataFrame:
    """Product dump as a JSON array, or as JSON lines; malformed input fails the job."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", not json_lines).json(path)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (good rows, malformed lines). The file is parsed once into both by the corrupt-record column."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    # Spark wants more than the corrupt column in a plan over the file, hence the length.
    rows = rows.withColumn("_line_chars", F.length("_corrupt_record"))
    return rows.where("_line_chars IS NULL").drop("_corrupt_record", "_line_chars"), rows.where("_line_chars IS NOT NULL").select("_corrupt_record", *schema.names)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def not_done(rows: DataFrame, done: DataFrame, key: str = "source_url") -> DataFrame:
    """Rows whose key isn't in ``done`` yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def in_order(df: DataFrame, order: str = "row_order") -> DataFrame:
    """An order key right after a scan: rising within and across partitions, with gaps."""
    return df.withColumn(order, F.monotonically_increasing_id())


def head_rows(df: DataFrame, n: int, order: str = "row_order") -> DataFrame:
    return df.orderBy(order).limit(n)


def category_subset(df: DataFrame, wanted: list[str], known: list[str]) -> DataFrame:
    unknown = sorted(set(wanted) - set(known))
    if unknown:
        raise ValueError(f"unknown categories: {', '.join(unknown)}")
    return df.where(F.col("category").isin(*wanted))


def lookup(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def dense_index(df: DataFrame, order: Column, parts: int = 64) -> DataFrame:
    """Dense row numbers from 0 without one task for all rows: range parts, their sizes, numbers within."""
    from pyspark.sql import Window

    spread = df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    local = spread.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # ``parts`` rows
    return local.join(F.broadcast(starts), "_part").withColumn("row_index", (F.col("_start") + F.col("_in")).cast("long")).drop("_part", "_in", "_start")
