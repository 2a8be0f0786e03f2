"""Registered queries: name, Spark function, and the same result in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import load, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Access to the tables of one directory, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.dir, name)


def query(sql: str | None = None, uses: str = ""):
    """Register a function of Tables under its name; ``uses``: catalog tables that ``sql`` needs in front."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = with_tables(sql, *uses.split()) if uses else sql
        return f

    return add
