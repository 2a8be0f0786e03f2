"""Change events: counts, claims, retries, requeue, and applying a batch to the document snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ATTEMPTS, MESSAGE_CHARS = 5, 1000


def status_counts(outbox: DataFrame) -> DataFrame:
    states = ["pending", "processing", "done", "failed"]
    return outbox.agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])


def claim(outbox: DataFrame, n: int) -> DataFrame:
    """The n oldest pending events."""
    return outbox.where("status = 'pending'").orderBy("created_at", "id").limit(n)


def enqueue_all(products: DataFrame, outbox: DataFrame) -> DataFrame:
    """Ids of products without an open upsert event."""
    busy = outbox.where("event_type = 'upsert' AND status IN ('pending', 'processing')").select(F.col("product_id").alias("id"))
    return products.select("id").join(busy, "id", "left_anti")


def after_failure(events: DataFrame, message: Column) -> DataFrame:
    """One attempt more; pending again while attempts are left, else failed."""
    tries = F.col("attempts") + 1
    return events.withColumns({"attempts": tries, "status": F.when(tries < MAX_ATTEMPTS, "pending").otherwise("failed"), "error_message": F.substring(message, 1, MESSAGE_CHARS)})


def requeue_stale(outbox: DataFrame, minutes: int, as_of: Column) -> DataFrame:
    """Events stuck in processing for more than ``minutes`` (by created_at) become pending."""
    old = (F.col("status") == "processing") & (F.col("created_at") < as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return outbox.withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


def split_events(events: DataFrame, products: DataFrame) -> DataFrame:
    """(id, product_id, action): upsert, delete (also of products that are not active) or unsupported; events of unknown products go."""
    p = products.select(F.col("id").alias("product_id"), "status", "deleted_at").withColumnRenamed("status", "product_status")
    live = (F.col("product_status") == "active") & F.col("deleted_at").isNull()
    action = F.when(F.col("event_type") == "delete", "delete").when(F.col("event_type") == "upsert", F.when(live, "upsert").otherwise("delete")).otherwise("unsupported")
    return events.join(p, "product_id").select("id", "product_id", "created_at", action.alias("action"))


def apply_events(documents: DataFrame, fresh: DataFrame, actions: DataFrame, last_wins: bool = False) -> DataFrame:
    """Snapshot after a batch: upserts take rows of ``fresh``, deletes go. Deletes win within a batch, or the last event."""
    if last_wins:
        actions = actions.groupBy("product_id").agg(F.max_by("action", F.struct("created_at", "id")).alias("action"))
    up = actions.where("action = 'upsert'").select(F.col("product_id").alias("id")).distinct()
    gone = actions.where("action = 'delete'").select(F.col("product_id").alias("id")).distinct()
    kept = documents.join(up, "id", "left_anti").unionByName(fresh.join(up, "id", "left_semi"))
    return kept.join(gone, "id", "left_anti")
