"""Data quality: one row (check, value, status) for each check, quarantine, coverage, key uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, value: Column, ok: Column | None = None) -> DataFrame:
    """Row (check_name, value, status); without ``ok`` it only informs."""
    v = df.agg(value.cast("long").alias("value"))
    status = F.lit("INFO") if ok is None else F.when(ok, "PASS").otherwise("FAIL")
    return v.select(F.lit(name).alias("check_name"), "value", status.alias("status"))


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check_name, value, status) of row rules, all counted in one pass; null results pass, as CHECKs do."""
    row = df.agg(*[F.count_if(~ok).alias(k) for k, ok in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("value")) for k in rules]))
    return row.select(pairs.alias("p")).select("p.*", F.when(F.col("p.value") == 0, "PASS").otherwise("FAIL").alias("status"))


def quarantine(df: DataFrame, rules: dict[str, Column], stage: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with stage and the names of the broken rules)."""
    broken = F.array_compact(F.array(*[F.when(~ok, k) for k, ok in rules.items()]))
    marked = df.withColumn("errors", broken)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0).withColumn("stage", F.lit(stage))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    return check(child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti"), name, F.count("*"), F.col("value") == 0)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (nulls are equal), with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fill_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, filled, missing) of each column, in one pass."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled"), (F.col("_n") - F.col(c)).alias("missing")) for c in columns])).alias("p")).select("p.*")


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").otherwise("PASS").alias("verdict"), F.count("*").alias("n_checks"), F.count_if(F.col("status") == "FAIL").alias("n_failed"))


def mismatches(wide: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose wide value differs from the long one, nulls being equal."""
    long = values.where(F.col("spec_key") == column).select(key, F.col("value_text").alias("_long"))
    return wide.select(key, F.col(column).cast("string").alias("_wide")).join(long, key).where(~F.col("_wide").eqNullSafe(F.col("_long")))


def latest_finished(runs: DataFrame, source: str, order: list[Column], statuses: tuple[str, ...] = ("done", "partial")) -> DataFrame:
    """The first run of each source in ``order`` among those that came to an end."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return runs.where(F.col("status").isin(*statuses)).withColumn("_k", rank).where("_k = 1").drop("_k")


def probes(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, n_hits, status): PASS for each probe query (query_id, ...) that has a row in ``hits`` (query_id, ...)."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    asked = queries.select("query_id").distinct().join(n, "query_id", "left").na.fill(0, ["n_hits"])
    return asked.withColumn("status", F.when(F.col("n_hits") > 0, "PASS").otherwise("FAIL"))


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
