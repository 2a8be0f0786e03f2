"""A table of versioned partitions: a new version of some partitions is written beside the old one, counted, then published.

Rows lie under ``data/<by>=.../version=...``, a folder of their own for each attempt; ``published`` has a row for each partition and version that counts. Readers take
each partition's newest published version, so they see all of a publication or nothing of it, and a publication rewrites the
partitions it names and no others. A publication under a ``token`` that is known already does nothing, which makes
a repeated batch of a stream harmless.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG = "value string, version string, n long, token string"


class Store:
    """Partitions by column ``by`` of rows of ``schema`` (without ``by``'s folder and the version) under ``root``."""

    def __init__(self, spark: SparkSession, root: str, by: str, schema: T.StructType | str):
        self.spark, self.root, self.by = spark, root.rstrip("/"), by
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def _log(self) -> DataFrame:
        path = f"{self.root}/published"
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(path)

    def versions(self) -> dict[str, tuple[str, int]]:
        """Newest version and number of rows of each partition; partitions are few by choice of ``by``."""
        newest = self._log().groupBy("value").agg(F.max_by(F.struct("version", "n"), "version").alias("v"))
        return {r["value"]: (r.v.version, r.v.n) for r in newest.collect()}

    def knows(self, token: str) -> bool:
        return not self._log().where(F.col("token") == token).isEmpty()

    def read(self, values: Iterable | None = None) -> DataFrame:
        """The newest rows of all partitions, or of those in ``values``; other folders are pruned."""
        wanted = None if values is None else {str(v) for v in values}
        live = [(v, k) for v, (k, n) in self.versions().items() if n and (wanted is None or v in wanted)]
        if not live:
            return self.spark.createDataFrame([], self.schema)
        full = T.StructType([*(f for f in self.schema.fields if f.name != self.by), self.schema[self.by], T.StructField("version", T.StringType())])
        rows = self.spark.read.schema(full).parquet(f"{self.root}/data")
        here = reduce(lambda a, b: a | b, [(F.col(self.by) == v) & (F.col("version") == k) for v, k in live])
        return rows.where(here).select(*self.schema.names)

    def publish(self, rows: DataFrame, values: Iterable, expected: dict[str, int] | None = None, token: str = "") -> bool:
        """Make ``rows`` the newest content of the partitions ``values``, also of those without a row now.

        Rows of other partitions, or other numbers of rows than ``expected``, raise before anything is published. False if
        ``token`` was published before.
        """
        if token and self.knows(token):
            return False
        number = max((int(k.split("-")[0]) for k, _ in self.versions().values()), default=-1) + 1
        version = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/data"
        rows.select(*self.schema.names).withColumn("version", F.lit(version)).write.partitionBy(self.by, "version").mode("append").parquet(path)
        full = T.StructType([*(f for f in self.schema.fields if f.name != self.by), self.schema[self.by], T.StructField("version", T.StringType())])
        there = self.spark.read.schema(full).parquet(path).where(F.col("version") == version).groupBy(F.col(self.by).cast("string").alias("v")).count()
        counts = {r.v: r["count"] for r in there.collect()}
        names = {str(v) for v in values}
        if set(counts) - names:
            raise ValueError(f"rows of other partitions: {sorted(set(counts) - names)}")
        for value, n in (expected or {}).items():
            if counts.get(value, 0) != n:
                raise ValueError(f"{value}: {counts.get(value, 0)} rows where {n} are expected")
        log = [(v, version, counts.get(v, 0), token) for v in sorted(names)]
        self.spark.createDataFrame(log, _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/published")
        return True

    def vacuum(self) -> int:
        """Delete the folders of older versions and of attempts that were never published; the number of them. No reader or writer may
        be at work."""
        live = {(v, k) for v, (k, _) in self.versions().items()}
        glob = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{self.by}=*/version=*")
        files = glob.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [x.getPath() for x in files.globStatus(glob) if (x.getPath().getParent().getName().split("=", 1)[1], x.getPath().getName().split("=", 1)[1]) not in live]
        for path in gone:
            files.delete(path, True)
        return len(gone)
