"""Embedding near-duplicates: exact cosine links by PCA-ordered, tiled comparison.

Vectors are turned into the axes of their second moments, largest first. Tiles of vectors are compared
from the leading axes on: the product of what is left of two vectors is at most the product of their
remaining norms, so a pair ends as soon as its cosine cannot reach the threshold. Whole pairs of tiles
end before they are built where the boxes around their vectors lie too far apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, ready, written

THRESHOLD = 0.9
#: Most vectors in a tile; two tiles meet in a task.
TILE_ROWS = 4096
#: Rows from which the cells are fitted (every row is then put into one).
CELL_SAMPLE = 8192
MAX_CELLS = 512
EPS = 1e-9


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as double rows, padded with zeros to ``dim``, and their lengths."""
    size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == dim).all():
        return flat.reshape(-1, dim), size
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def splits(dim: int) -> list[int]:
    """Axes after which the bound is looked at."""
    out = [min(8, dim)]
    while out[-1] < dim:
        out.append(min(dim, 2 * out[-1]))
    return out


def fit_cells(sample: np.ndarray, cells: int, axes: int) -> list[tuple[int, int, float]]:
    """Splits of a k-d tree over the leading axes: (cell, axis, value); rows above the value move to a new cell.

    Cell numbers count up from 0 in the order of the splits.
    """
    members, out = {0: np.arange(len(sample))}, []
    while len(members) < cells:
        cell = max(members, key=lambda c: (len(members[c]), -c))
        own = sample[members[cell], :axes]
        spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(axes)
        if len(own) < 8 or spread.max() <= 0:
            break
        axis = int(spread.argmax())
        value = float(np.median(own[:, axis]))
        up = own[:, axis] > value
        if not up.any():
            break
        new = len(members)
        out.append((cell, axis, value))
        members[new], members[cell] = members[cell][up], members[cell][~up]
    return out


def assign(x: np.ndarray, tree: list[tuple[int, int, float]]) -> np.ndarray:
    cell = np.zeros(len(x), np.int32)
    for new, (old, axis, value) in enumerate(tree, 1):
        cell[(cell == old) & (x[:, axis] > value)] = new
    return cell


def linked(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (i, j, cosine) of rotated unit rows at ``threshold`` or more, block by block; same: i < j only.

    Values within EPS below the threshold are passed too; the caller settles them.
    """
    dim = a.shape[1]
    cuts = splits(dim)
    rest = lambda x, at: np.sqrt(np.maximum((x[:, at:] ** 2).sum(axis=1), 0))
    left, right = [rest(a, c) for c in cuts], [rest(b, c) for c in cuts]
    for at in range(0, len(a), 512):
        rows = slice(at, min(at + 512, len(a)))
        first = at if same else 0
        part = a[rows, : cuts[0]] @ b[first:, : cuts[0]].T
        open_ = part + np.outer(left[0][rows], right[0][first:]) >= threshold - EPS
        if same:
            open_ &= np.arange(at, rows.stop)[:, None] < np.arange(first, len(b))[None, :]
        k = 1
        while k < len(cuts) and open_.mean() > 0.1:  # many are left: go on with all
            part += a[rows, cuts[k - 1] : cuts[k]] @ b[first:, cuts[k - 1] : cuts[k]].T
            open_ &= part + np.outer(left[k][rows], right[k][first:]) >= threshold - EPS
            k += 1
        i, j = np.nonzero(open_)
        value = part[i, j]
        i, j = i + at, j + first
        while k < len(cuts) and len(i):
            for s in range(0, len(i), 1 << 18):
                t = slice(s, s + (1 << 18))
                value[t] += np.einsum("ij,ij->i", a[i[t], cuts[k - 1] : cuts[k]], b[j[t], cuts[k - 1] : cuts[k]])
            keep = value + left[k][i] * right[k][j] >= threshold - EPS
            i, j, value = i[keep], j[keep], value[keep]
            k += 1
        if len(i):
            yield i, j, value


def union(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the trees of u[k] and v[k] in ``label``, where each entry names its tree's root."""
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label[:] = up


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    All rows are compared with all rows of the same length. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing, and so do rows without an id. Equal vectors are compared once and
    count as often as they occur; repeated ids stay separate rows, with the links of their own vector. Ids are cast to long. Further columns are ignored. A null id has a null component.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # Different vectors get numbers of their own, because an id may have several.
    reps = written(rows.where("good").groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least")).withColumn("rep", F.monotonically_increasing_id()))
    n, dim = reps.agg(F.count("*"), F.max(F.size("embedding"))).first()
    alone = rows.select("good", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone.drop("good")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _unit(_matrix(batch.column("embedding"), dim)[0])
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(dim * dim)), "v": pa.array(total.ravel())})

    cov = np.zeros(dim * dim)
    for r in reps.select("embedding").mapInArrow(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        cov[r.k] = r.v  # dim * dim numbers, whatever the number of rows
    axes = spark.sparkContext.broadcast(np.linalg.eigh(cov.reshape(dim, dim))[1][:, ::-1].copy())

    sample = reps.orderBy(F.xxhash64("embedding"), "rep").limit(CELL_SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    lead = min(dim, 16)
    cells = int(min(MAX_CELLS, max(1, n // tile_rows)))
    turned = _unit(_matrix(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample, dim)[0]) @ axes.value
    tree = fit_cells(turned, cells, lead)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("embedding"), dim)[0]) @ axes.value
            box = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "weight": batch.column("weight"), "embedding": batch.column("embedding"), "cell": pa.array(assign(x, tree)), "turned": box})

    raw = reps.schema["embedding"].dataType
    located = reps.select("rep", "weight", "embedding").mapInArrow(locate, T.StructType([T.StructField("rep", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("embedding", raw), T.StructField("cell", T.IntegerType()), T.StructField("turned", T.ArrayType(T.DoubleType()))]))
    located = written(located)
    sides = [F.min(F.col("turned")[k]).alias(f"lo{k}") for k in range(lead)] + [F.max(F.col("turned")[k]).alias(f"hi{k}") for k in range(lead)]
    boxes = located.groupBy("cell").agg(F.count("*").alias("n"), *sides).orderBy("cell").collect()  # at most MAX_CELLS rows
    lo, hi = (np.array([[r[f"{s}{k}"] for k in range(lead)] for r in boxes]) for s in ("lo", "hi"))
    far = 2 - 2 * threshold + EPS  # squared distance of unit vectors at the threshold
    meet = []
    for i, r in enumerate(boxes):
        gap = np.maximum(0, np.maximum(lo[i] - hi[i:], lo[i:] - hi[i]))
        for j in np.flatnonzero((gap**2).sum(axis=1) <= far):
            meet.append((r.cell, boxes[i + int(j)].cell, -(-r.n // tile_rows), -(-boxes[i + int(j)].n // tile_rows)))
    blocks = F.create_map(*[F.lit(int(x)) for r in boxes for x in (r.cell, -(-r.n // tile_rows))])
    # Blocks of a large cell are filled by hash, to about the size of a tile.
    tiled = located.withColumn("block", F.pmod(F.xxhash64("rep"), blocks[F.col("cell")].cast("long")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        own = table.combine_chunks()
        x, size = _matrix(own.column("embedding").chunk(0), dim)
        cols = [own.column("rep").to_numpy().astype(np.int64), own.column("weight").to_numpy().astype(np.int64), size, x]
        return pa.table({"cell": own.column("cell")[:1], "block": own.column("block")[:1]} | {k: pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for k, c in zip("iwsx", cols, strict=True)})

    tiles = tiled.select("cell", "block", "rep", "weight", "embedding").groupBy("cell", "block").applyInArrow(pack, "cell int, block int, i binary, w binary, s binary, x binary")
    tiles = written(tiles)
    pairs = spark.createDataFrame(meet, "c1 int, c2 int, n1 int, n2 int")
    pairs = pairs.select("c1", "c2", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("b1"), "n2").select("c1", "b1", "c2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("b2"))
    pairs = pairs.where("c1 <> c2 OR b1 <= b2")
    one, two = (tiles.select(*[F.col(c).alias(f"{c}{k}") for c in "iwsx"], F.col("cell").alias(f"c{k}"), F.col("block").alias(f"b{k}")) for k in (1, 2))
    both = pairs.join(one, ["c1", "b1"]).join(two, ["c2", "b2"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = axes.value
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[k].as_buffer(), t)  # noqa: B023, E731
                same = batch.column("c1")[k] == batch.column("c2")[k] and batch.column("b1")[k] == batch.column("b2")[k]
                x, y = get("x1", np.float64).reshape(-1, dim), get("x2", np.float64).reshape(-1, dim)
                sx, sy, wx, wy, ix, iy = get("s1", np.int64), get("s2", np.int64), get("w1", np.int64), get("w2", np.int64), get("i1", np.int64), get("i2", np.int64)
                ux, uy = _unit(x), _unit(y)
                shift = 0 if same else len(x)
                links = np.zeros(shift + len(y), np.int64)
                label = np.arange(len(links))
                for i, j, value in linked(ux @ turn, uy @ turn, threshold, same):
                    edge = np.flatnonzero(np.abs(value - threshold) <= 2 * EPS)
                    value[edge] = np.einsum("ij,ij->i", ux[i[edge]], uy[j[edge]])
                    keep = (value >= threshold) & (sx[i] == sy[j])
                    i, j = i[keep], j[keep]
                    np.add.at(links, i, wy[j])
                    np.add.at(links, j + shift, wx[i])
                    union(label, i, j + shift)
                hit = np.flatnonzero(links)
                ids = ix if same else np.concatenate([ix, iy])
                if len(hit):
                    yield pa.RecordBatch.from_pydict({"rep": pa.array(ids[hit]), "root": pa.array(ids[label[hit]]), "links": pa.array(links[hit])})

    found = written(both.mapInArrow(compare, "rep long, root long, links long"))
    comp = written(components(found.select("rep", "root"), "rep", "root").join(reps.select("rep", "least"), F.col("node") == F.col("rep")).select("node", "component", "least"))
    named = comp.groupBy("component").agg(F.min("least").alias("least"))
    comp = comp.drop("least").join(written(named), "component").select("node", F.col("least").alias("named"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = reps.join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    of_rep = of_rep.select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("named", "least").alias("component"))
    done = rows.where("good").join(of_rep, rows.embedding == of_rep.e).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    return done.unionByName(alone.where(~F.col("good")).drop("good"))
