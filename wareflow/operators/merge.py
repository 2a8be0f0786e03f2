"""Upserts of snapshots without MERGE: policies by column, replace by key, insert if absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_batch(batch: DataFrame, key: str, order: str, overwrite: list[str], coalesce: list[str], keep: list[str]) -> DataFrame:
    """One row for each key, as if its rows had been merged in ``order``: last value, last non-null value, first value."""
    aggs = [F.max_by(c, order).alias(c) for c in overwrite]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in coalesce]
    aggs += [F.min_by(c, order).alias(c) for c in keep]
    return batch.groupBy(key).agg(*aggs)


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], coalesce: list[str], keep: list[str]) -> DataFrame:
    """Merge folded ``new`` into ``old``: overwrite, fill only with non-null values, or never change after insert.

    One full outer join on the key; the result is a new snapshot to be written to a new path.
    """
    was, now = F.col("o._there").isNotNull(), F.col("n._there").isNotNull()
    joined = old.withColumn("_there", F.lit(1)).alias("o").join(new.withColumn("_there", F.lit(1)).alias("n"), key, "full_outer")
    cols = [F.col(key)]
    cols += [F.when(now, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in overwrite]
    cols += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in coalesce]
    cols += [F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in keep]
    return joined.select(*cols)


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of ``incoming`` by ``keys`` that ``stored`` doesn't have."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def replace_children(old: DataFrame, new: DataFrame, key: str, parents: DataFrame | None = None) -> DataFrame:
    """``old`` with all rows of the keys in ``new`` replaced. Keys without new rows keep theirs; pass ``parents`` to clear them."""
    gone = new.select(key) if parents is None else new.select(key).unionByName(parents.select(key))
    return old.join(gone.distinct(), key, "left_anti").unionByName(new)
