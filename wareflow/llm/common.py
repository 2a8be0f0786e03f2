"""Helpers shared by the operators of this folder: scratch tables, batch slicing, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.session import importable

__all__ = ["components", "drop_path", "free_name", "frequent_bound", "ranges", "ready", "release_shuffles", "scratch", "scratch_path", "text_slices", "written"]

#: Bytes of text that one numpy step works on; a longer single text is a step of its own.
CHUNK_BYTES = 4 << 20


#: Rows of an Arrow batch unless the session sets a number of its own: texts are long, and a batch is held several times
#: on its way to a worker and back.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Make the package importable on the workers, and batches small."""
    importable(spark)
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)


def scratch_path(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # Only where the cluster names none, as in local tests.
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


def written(df: DataFrame, path: str | None = None, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared scratch folder and read it again.

    Within ``scratch`` the table goes at its end, unless it is to ``keep``.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark)
    if (own := _OWN.get()) is not None and not keep:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``written`` made inside; a table that is still to be read must be kept."""
    own: list[str] = []
    token = _OWN.set(own)
    try:
        yield
    finally:
        _OWN.reset(token)
        for path in own:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does once the driver has collected their plans."""
    spark._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def frequent_bound(counts: DataFrame, n: str, rows: int) -> int:
    """The least power of two such that at most ``rows`` rows have an ``n`` of that size or more; 1 where all fit.

    One aggregate by the binary length of ``n``: at most 64 rows come to the driver.
    """
    level = F.floor(F.log2(F.greatest(F.col(n), F.lit(1)).cast("double"))).cast("int")
    held = {r.level: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    total = 0
    for k in sorted(held, reverse=True):
        total += held[k]
        if total > rows:
            return 2 ** (k + 1)
    return 1


def text_slices(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into steps of about ``limit`` bytes: (first row, bytes, row offsets).

    Null counts as empty. Texts are never cut.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return
    col = col.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        off = offsets[at : end + 1]
        yield at, data[off[0] : off[-1]], off - off[0]
        at = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i]`` of all i, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected long edges: (node, component), component the least node.

    Alternates two star contractions over written edge tables: every node hands its larger neighbours
    to its least neighbour, then its smaller ones. Each contraction is one min-aggregate and one equi-join, so
    memory per task doesn't depend on the size of a component, and rounds grow with its logarithm. They end once every
    edge points to the centre of a star; edges that are such stars already, as the result of an earlier call is, need none.
    Self edges and nulls are ignored; nodes without another edge are not returned.
    """
    spark = edges.sparkSession
    flat = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    path = scratch_path(spark)
    now = written(flat.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)

    def stars() -> bool:
        """Whether no node points to two others, or points to one and is pointed to."""
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
        )
        return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1 AND out > 0").isEmpty()

    while not stars():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Every edge gives one at most, so equal ones can wait for the end of the round.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Now every edge points from a node to a smaller one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        new_path = scratch_path(spark)
        now = written(small, new_path)
        drop_path(spark, path)
        path = new_path
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
