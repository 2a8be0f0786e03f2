"""Structured Streaming forms of the feeds: price changes, outbox drain, usage, steps, first sight of URLs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wareflow.operators import documents
from wareflow.operators.logs import budget_flags
from wareflow.operators.store import Store

CHANGE_SCHEMA = "product_id string, captured_at timestamp, price_vnd long, price_hash string"


class PriceChange(StatefulProcessor):
    """Keeps each product's latest state; passes rows whose hash differs from it. Older rows never become the latest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "captured_at timestamp, price_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.latest.get() if self.latest.exists() else None
        at, known = held if held is not None else (None, None)
        before = (at, known)
        for batch in rows:
            out = []
            for row in batch.sort_values("captured_at", kind="stable").itertuples(index=False):
                if row.price_hash != known:
                    out.append((key[0], row.captured_at, row.price_vnd, row.price_hash))
                    if at is None or row.captured_at >= at:
                        at, known = row.captured_at.to_pydatetime(), row.price_hash
            if out:
                yield pd.DataFrame(out, columns=["product_id", "captured_at", "price_vnd", "price_hash"])
        if (at, known) != before:
            self.latest.update((at, known))

    def close(self) -> None:
        pass


def price_change_stream(captures: DataFrame) -> DataFrame:
    """Changes of a stream of captures (product_id, captured_at, price_vnd, price_hash); needs the RocksDB state store."""
    return captures.groupBy("product_id").transformWithStateInPandas(PriceChange(), outputStructType=CHANGE_SCHEMA, outputMode="Append", timeMode="None")


def daily_usage_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tokens and requests by day with budget flags; a day is final once the watermark has passed it."""
    day = events.where("tokens > 0").withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests"))
    return budget_flags(day.select(F.to_date("w.start").alias("day"), "tokens", "requests"))


def step_pairs(starts: DataFrame, ends: DataFrame, within: str = "1 hour") -> DataFrame:
    """Start and end rows of a step, joined within a time bound so that state is dropped behind the watermark."""
    s = starts.select(F.col("step_id"), "step_type", F.col("ts").alias("t0")).withWatermark("t0", within)
    e = ends.select(F.col("step_id").alias("end_id"), "status", F.col("ts").alias("t1")).withWatermark("t1", within)
    bound = F.expr(f"step_id = end_id AND t1 >= t0 AND t1 <= t0 + INTERVAL {within}")
    return s.join(e, bound).select("step_id", "step_type", "status", (F.unix_millis("t1") - F.unix_millis("t0")).alias("duration_ms"))


def first_seen(urls: DataFrame, known: DataFrame, within: str = "1 day") -> DataFrame:
    """New URLs of a stream: each once within the watermark, without those of the static table ``known``."""
    fresh = urls.withWatermark("ts", within).dropDuplicatesWithinWatermark(["source_url"])
    return fresh.join(known, "source_url", "left_anti")


def drain_documents(events: DataFrame, store: Store, products: DataFrame, specs: DataFrame, latest: DataFrame, checkpoint: str, **trigger):
    """Apply change events (id, product_id, event_type, created_at) to the stored search documents, batch by batch.

    Each batch is one publication under its id, so a batch that comes again after a crash, before or after it was published, leaves the
    same documents. Products, specifications and prices are read anew for each batch.
    """
    name = f"{checkpoint}#"
    return drain(events, lambda batch, k: documents.apply_batch(store, batch, products, specs, latest, f"{name}{k}"), checkpoint, **trigger)


def drain(events: DataFrame, apply, checkpoint: str, **trigger):
    """Feed each micro-batch of change events to ``apply(batch, batch_id)``; offsets replace the claim of rows.

    ``apply`` writes a snapshot under a path that holds the batch id, so that a repeated batch rewrites its own path.
    """
    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
