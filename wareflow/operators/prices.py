"""Price history: the latest state, capture of changes, discounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ``order`` must end in a key that tells rows apart. Spark prunes rows before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_prices(prices: DataFrame, tie: list[str] = ()) -> DataFrame:
    """The latest state of each product by captured_at, created_at and the tie keys."""
    return first_per_key(prices, ["product_id"], [F.col("captured_at").desc(), F.col("created_at").desc(), *[F.col(c).desc() for c in tie]])


def price_changes(prices: DataFrame, state: str, order: list[str]) -> DataFrame:
    """Rows whose ``state`` differs from that of the row before of the same product (for in-order backlogs)."""
    before = F.lag(state).over(Window.partitionBy("product_id").orderBy(*order))
    return prices.withColumn("_before", before).where(~F.col(state).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def append_changed(stored: DataFrame, incoming: DataFrame, tie: list[str] = ()) -> DataFrame:
    """Rows of ``incoming`` (one for each product) whose price_hash isn't the latest stored one."""
    known = latest_prices(stored, tie).select("product_id", "price_hash")
    return incoming.join(known, ["product_id", "price_hash"], "left_anti")


def effective(current: Column, base: Column) -> Column:
    return F.coalesce(current, base)


def discount_percent(list_price: Column, price: Column) -> Column:
    """Whole percent off, only where the list price is higher."""
    return F.when(list_price > price, F.round((list_price - price) / list_price * 100).cast("int"))
