"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most two bits agree, up to one bit, in one of their two 32-bit halves.
So each half is indexed 32 times, each time without one of its bits; equal keys are joined and the whole
fingerprints compared. Only distinct fingerprints are indexed: copies share one. Keys that many fingerprints
share are not expanded into pairs. Their fingerprints are linked exactly through the values within one bit
of them: two fingerprints differ in at most two bits if and only if they have such a value in common, so
a star around each value finds every link with as many rows as fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, free_name, ranges, ready, release_shuffles, scratch, text_slices, written

SEED = 42
#: Keys with more fingerprints than this are linked through shared neighbours instead of pairs.
PAIR_LIMIT = 16
#: Texts, about so many, that say which shingles are common; results don't depend on it.
ORDER_TEXTS = 4000
#: Texts that share a shingle from which on they are compared with leads first, and the number of rounds of leads.
CROWD_LIMIT, LEADS = 24, 3
#: Pairs of one part of a comparison, and most parts, whose number doesn't grow with the texts.
PART_PAIRS, PARTS = 1 << 13, 8
#: Longs of the bitmap of a text's shingles, which rules out pairs without their shingles.
BITMAP_LONGS = 8
#: Bits for each shingle, at least, of a text's fine bitmap. Pairs that the short one leaves are compared by it before their shingles are read.
FINE_BITS = 4
#: Texts to compare, of 16 bytes each, whose list goes to the texts; beyond it both are shuffled by hash.
BROADCAST_TEXTS = 1_000_000


def shingle_hashes(raw: bytes, words_per_shingle: int) -> np.ndarray:
    """Big-endian XXH64 bytes, one row for each shingle of UTF-8 bytes: words lower-cased in A-Z."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros((0, 8), np.uint8)
    k = min(words_per_shingle, n)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (np.concatenate([[0], ends[: n - k]])).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(text[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)])
    return np.frombuffer(hashes, np.uint8).reshape(-1, 8)


def parity_bitmap(hashes: np.ndarray, longs: int = BITMAP_LONGS) -> np.ndarray:
    """Bitmap whose bit i says whether an odd number of distinct hashes fall on i.

    Shingles of both of two texts cancel, so their bitmaps differ in no more bits than the texts in shingles.
    """
    odd = np.bincount(hashes & (64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap that grows with the number of hashes, by powers of two: its halves, combined by XOR, are the next smaller one."""
    longs = BITMAP_LONGS
    while 64 * longs < FINE_BITS * len(hashes):
        longs *= 2
    return parity_bitmap(hashes, longs)


def fingerprint_of(raw: bytes, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of UTF-8 bytes."""
    return majority(shingle_hashes(raw, words_per_shingle))


def majority(hashes: np.ndarray) -> int:
    ones = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def distinct_shingles(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.view(">i8").ravel().astype(np.int64))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", words_per_shingle: int = 3, marks: bool = False) -> DataFrame:
    """Replace column ``text`` by its SimHash ``out`` (long, the 64 bits as a signed number).

    With ``marks`` also columns n, the number of different shingles, and bits and fine, their short and fine parity bitmaps.

    Null and empty texts get zero; fewer words than a shingle has make one shingle. Whole texts count.
    """
    ready(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes, bits, fine = [], [], [], []
            for _, data, offsets in text_slices(batch.column(text)):
                raw, ends = data.tobytes(), offsets.tolist()
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    hashes = shingle_hashes(raw[a:b], words_per_shingle)
                    values.append(majority(hashes))
                    if marks:
                        own = distinct_shingles(hashes)
                        sizes.append(len(own))
                        fine.append(fine_bitmap(own))
                        bits.append(np.bitwise_xor.reduce(fine[-1].reshape(-1, BITMAP_LONGS)))
            cols = {f.name: batch.column(f.name) for f in fields} | {out: pa.array(np.array(values, np.uint64).view(np.int64))}
            yield pa.RecordBatch.from_pydict(cols | ({"n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.list_(pa.int64())), "fine": pa.array(fine, pa.list_(pa.int64()))} if marks else {}))

    more = [T.StructField("n", T.IntegerType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("bits", "fine")]] if marks else []
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.LongType()), *more]))


def _variants(fp: Column) -> Column:
    """Keys of both halves without one bit: half, place of the bit, and the half with that bit zero."""
    keys = []
    for half in range(2):
        value = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            keys.append(value.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).bitwiseOR(F.lit((half * 32 + bit) << 32)))
    return F.array(*keys)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= 2


def runs_to_links(key: np.ndarray, fp: np.ndarray, pair_limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key: all close pairs (a, b) of keys with up to ``pair_limit`` rows, and the rows of larger keys."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    a, b = [], []
    for step in range(1, pair_limit):  # rows that many places apart in one key
        at = np.flatnonzero((size > step) & (size <= pair_limit))
        if not len(at):
            break
        i = ranges(first[at], size[at] - step)
        near = _close(fp[i], fp[i + step])
        a.append(fp[i][near])
        b.append(fp[i + step][near])
    crowd = size > pair_limit
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none]), np.unique(fp[ranges(first[crowd], size[crowd])])


def links(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints in ``fps.fp`` that connect all at two bits or fewer.

    Every edge is a true link. The keys are shuffled once and meet sorted; rare keys give all their links, the
    fingerprints of frequent keys a spanning star around each shared neighbour.
    """
    ready(fps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        large = None  # a key whose rows already exceed the limit; the rest of it passes by

        def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64())})

        def close(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(key):
                a, b, crowd = runs_to_links(key, fp, pair_limit)
                if len(a):
                    yield out(a, b)
                if len(crowd):
                    yield out(crowd, None)

        for batch in batches:
            key = np.concatenate([held_key, batch.column("key").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
            if large is not None:
                n = int(np.searchsorted(key, large, "right"))
                if n:
                    yield out(fp[:n], None)
                key, fp = key[n:], fp[n:]
                if not len(key):
                    held_key, held_fp = key, fp
                    continue
                large = None
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0  # the last key may go on
            yield from close(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
            if len(held_key) > pair_limit:
                yield out(held_fp, None)
                large, held_key, held_fp = int(held_key[-1]), held_key[:0], held_fp[:0]
        yield from close(held_key, held_fp)

    keyed = fps.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    met = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long"))
    crowd = met.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])
    middle = crowd.select("fp", F.explode(around).alias("mid"))
    hub = middle.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = middle.join(hub, "mid").where("fp <> a").select("a", F.col("fp").alias("b"))
    return met.where("b IS NOT NULL").unionByName(star).distinct()


def similar_texts(docs: DataFrame, words_per_shingle: int = 5, crowd_limit: int = CROWD_LIMIT, marks: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of ``check`` of texts in ``docs`` (doc_id, check, text) with a Jaccard similarity of shingles of 4/5 or more, which
    connect all texts that such pairs connect.

    Exact, up to equal 64-bit hashes: the shingles of every text are put in one order, and of two such texts the first
    fifths (n - ceil(4n/5) + 1 of n shingles) have one in common. Texts that share one meet: where they are few, all pairs whose
    lengths or places don't rule the similarity out are compared. Where they are more than ``crowd_limit``, all are compared
    with a few leads, and then those outside the largest component with all of other components, so that a
    group of near copies costs about as many comparisons as it has members. Bitmaps of their shingles rule most pairs of
    unlike texts out before their shingles are read, which loses no link; ``marks`` (check, n, bits, fine) are those of ``fingerprints``,
    a written table. Short bitmaps go with every shingle, but say little of texts with more shingles than they have bits; fine ones, of the pairs' texts alone, decide
    whose shingles are read. The order puts shingles that a sample of texts shares last; which these are changes the cost only.
    """
    spark = docs.sparkSession
    ready(spark)
    with scratch(spark):
        if marks is None:
            marks = written(fingerprints(docs.select("check", "text"), words_per_shingle=words_per_shingle, marks=True))
        return written(_similar(docs, words_per_shingle, crowd_limit, marks).distinct(), keep=True)


def _similar(texts: DataFrame, words_per_shingle: int, crowd_limit: int, marks: DataFrame) -> DataFrame:
    def table(df: DataFrame) -> DataFrame:
        """``df`` written, and the shuffle files behind it free to go: this search shuffles more than it needs at any time."""
        out = written(df)
        release_shuffles(texts.sparkSession)
        return out

    def shingle_sets(col: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        for at, data, offsets in text_slices(col, 1 << 18):
            raw, ends = data.tobytes(), offsets.tolist()
            yield at, [distinct_shingles(shingle_hashes(raw[a:b], words_per_shingle)) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(batch.column("text")):
                yield pa.RecordBatch.from_pydict({"check": batch.column("check").slice(at, len(sets)), "h": pa.array(sets, pa.list_(pa.int64()))})

    def sets_of(some: DataFrame) -> DataFrame:
        return some.select("check", "text").mapInArrow(run, "check long, h array<long>").where("size(h) > 0")

    share = min(1.0, ORDER_TEXTS / max(1, texts.count()))
    drawn = texts.where(F.pmod("check", F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates(["check"])
    common = sets_of(drawn).select(F.explode("h").alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 2").select("k").toArrow()
    late = np.sort(common.column("k").to_numpy())

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(batch.column("text")):
                own = []
                for h in sets:
                    n = len(h)
                    where = np.searchsorted(late, h)
                    last = late[np.minimum(where, len(late) - 1)] == h if len(late) else np.zeros(n, bool)
                    own.append(np.concatenate([h[~last], h[last]])[: n - (4 * n + 4) // 5 + 1] if n else h)
                m = np.array([len(h) for h in own])
                of = np.repeat(np.arange(len(own)), m)
                check = batch.column("check").slice(at, len(own)).take(pa.array(of))
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.concatenate(own)), "check": check, "n": pa.array(np.array([len(h) for h in sets], np.int32)[of]), "at": pa.array(ranges(np.zeros(len(m), np.int64), m).astype(np.int32))})

    # One shuffle: rows of a shingle lie side by side, so copies and shingles of one text are told by their neighbours.
    short = written(marks.select("check", "n", "bits").dropDuplicates(["check"]))
    every = Window.partitionBy("k")
    new = F.coalesce(F.lag("check").over(every.orderBy("check")) != F.col("check"), F.lit(True))
    keys = texts.mapInArrow(prefixes, "k long, check long, n int, at int").withColumn("new", new)
    shared = table(keys.withColumn("c", F.sum(F.col("new").cast("int")).over(every)).where("new AND c > 1").drop("new"))

    def within(a: str, b: str) -> Column:
        """Whether bitmaps leave a similarity of 4/5 possible: then at most a ninth of all shingles are of one text only."""
        differ = reduce(Column.__add__, [F.bit_count(F.get(f"{a}.bits", F.lit(i)).bitwiseXOR(F.get(f"{b}.bits", F.lit(i)))) for i in range(BITMAP_LONGS)])
        return 9 * differ <= F.col(f"{a}.n") + F.col(f"{b}.n")

    def meet(x: DataFrame, y: DataFrame, apart: Column) -> DataFrame:
        a, b = x.alias("a"), y.alias("b")
        most = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
        met = a.join(b, (F.col("a.k") == F.col("b.k")) & apart & (9 * most >= 4 * (F.col("a.n") + F.col("b.n"))))
        return met.select(F.least("a.check", "b.check").alias("a"), F.greatest("a.check", "b.check").alias("b")).distinct()

    def listed(some: DataFrame) -> DataFrame:
        """``some``, a written table of few longs a row, to be broadcast if it is small, so that the other side stays where it is."""
        return F.broadcast(some) if some.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else some

    def ends(pairs: DataFrame) -> DataFrame:
        return listed(written(pairs.select(F.explode(F.array("a", "b")).alias("check")).distinct()))

    def carried(pairs: DataFrame, some: DataFrame, value: str) -> DataFrame:
        """``pairs`` with x and y, the values of their two texts."""
        x, y = [some.select(F.col("check").alias(c), F.col(value).alias(v)) for c, v in (("a", "x"), ("b", "y"))]
        return pairs.join(x, "a").join(y, "b")

    def finely() -> Column:
        """``within`` by fine bitmaps; of texts that may be similar one's has at most twice the bits of the other's."""
        longs = F.least(F.size("x.fine"), F.size("y.fine"))

        def folded(fine: str) -> Column:
            halves = F.zip_with(F.slice(fine, F.lit(1), longs), F.slice(fine, longs + 1, longs), lambda u, v: u.bitwiseXOR(v))
            return F.when(F.size(fine) > longs, halves).otherwise(F.col(fine))

        differ = F.aggregate(F.zip_with(folded("x.fine"), folded("y.fine"), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, m: n + m)
        return (5 * F.least("x.n", "y.n") >= 4 * F.greatest("x.n", "y.n")) & (9 * differ <= F.col("x.n") + F.col("y.n"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Of written ``pairs`` the similar ones. Many that fine bitmaps leave go in parts, one after the other, as each carries a set of shingles on its way."""
        near = table(carried(pairs, fine.join(ends(pairs), "check", "left_semi"), "m").where(finely()).select("a", "b"))
        parts = min(PARTS, -(-near.count() // PART_PAIRS))
        if not parts:
            return near
        o = listed(written(one.join(ends(near), "check", "left_semi"))).alias("o")
        sets = table(sets_of(texts.alias("t").join(o, (F.col("t.check") == F.col("o.check")) & F.col("t.doc_id").eqNullSafe(F.col("o.doc_id")), "left_semi")))
        if parts == 1:
            return compared(near, sets)
        own = F.pmod(F.xxhash64("a", "b"), F.lit(parts))
        return reduce(DataFrame.unionByName, [table(compared(some, sets.join(ends(some), "check", "left_semi"))) for some in [table(near.where(own == k)) for k in range(parts)]])

    def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return carried(pairs, sets, "h").where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")

    few = shared.where(F.col("c") <= crowd_limit)
    crowds = shared.where(F.col("c") > crowd_limit).drop("c")
    pairs = table(meet(few, few, F.col("a.check") < F.col("b.check")))
    x, y = short.withColumnRenamed("check", "a").alias("x"), short.withColumnRenamed("check", "b").alias("y")
    pairs = table(pairs.join(x, "a").join(y, "b").where(within("x", "y")).select("a", "b"))
    used = table(pairs.select(F.explode(F.array("a", "b")).alias("check")).unionByName(crowds.select("check")).distinct())
    one = table(texts.select("doc_id", "check").join(used, "check", "left_semi").groupBy("check").agg(F.min("doc_id").alias("doc_id")))
    fine = table(marks.join(listed(used), "check", "left_semi").dropDuplicates(["check"]).select("check", F.struct("n", "fine").alias("m")))
    edges = table(alike(pairs))
    if crowds.isEmpty():
        return edges
    crowds = table(crowds.join(short.select("check", "bits"), "check"))

    def labelled(found: DataFrame) -> DataFrame:
        return table(crowds.join(found, F.col("check") == F.col("node"), "left").withColumn("label", F.coalesce("component", "check")).drop("node", "component"))

    found = components(edges)
    now = labelled(found)
    for k in range(LEADS):
        lead = now.groupBy("k").agg(F.min(F.struct(F.xxhash64("check", F.lit(k)).alias("order"), F.col("check").alias("of"), F.col("label").alias("own"), F.col("n"), F.col("bits"))).alias("m")).select("k", "m.*")
        # One lead for each text, the first possible one in the order of all its shingles, so pairs are as many as texts at most.
        first = now.alias("a").join(written(lead).alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("label") != F.col("own")) & within("a", "b")).groupBy("check").agg(F.min(F.struct("order", "of")).alias("m"))
        pairs = first.select(F.least("check", "m.of").alias("a"), F.greatest("check", "m.of").alias("b")).distinct()
        more = table(alike(written(pairs)))
        edges = edges.unionByName(more)
        # The stars found so far stand for all earlier edges.
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        now = labelled(found)
    main = now.groupBy("k", "label").agg(F.count("*").alias("m")).groupBy("k").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    outside = now.join(written(main), "k").where("label <> main")
    return edges.unionByName(alike(written(meet(outside, now, (F.col("a.label") != F.col("b.label")) & within("a", "b")))))


def _grouped(docs: DataFrame, doc_id: str, text: str, words_per_shingle: int, similar: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows (doc_id, check, fp) of all documents, and the group of each fingerprint (fp, component, first_id)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("check"), F.col(text).alias("text"))
    rows = written(fingerprints(rows, words_per_shingle=words_per_shingle, marks=similar))
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    edges = links(fps)
    if similar:
        near = similar_texts(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("check"), F.col(text).alias("text")), words_per_shingle, marks=rows)
        of = written(rows.join(near.select(F.explode(F.array("a", "b")).alias("check")).distinct(), "check", "left_semi").select("check", "fp").distinct())
        near = near.join(of.select(F.col("check").alias("a"), F.col("fp").alias("fa")), "a").join(of.select(F.col("check").alias("b"), F.col("fp").alias("fb")), "b")
        edges = edges.unionByName(near.where("fa <> fb").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b"))).distinct()
    comp = written(components(edges))
    groups = fps.join(comp, fps.fp == comp.node, "left").withColumn("component", F.coalesce("component", "fp"))
    return rows, groups.select("fp", "component", "first_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): per row its SimHash and the least id reachable over links of two bits.

    Null texts count as empty; all empty texts share the fingerprint zero. Rows with the same id or text
    stay separate rows. Null ids get a component but never name one, unless it has no other id (then null).
    An empty table gives an empty result; further columns are ignored.
    """
    rows, groups = _grouped(docs, doc_id, text, words_per_shingle)
    named = groups.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = groups.join(named, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one with the least id.

    Near-duplicates have fingerprints of five-word shingles at two bits or fewer, or a Jaccard similarity of the shingles of
    0.8 or more, directly or over others. Of different texts under one id in a group, one stays, and one
    of rows that are equal. Rows without an id or a word are no copies of anything and all stay.
    """
    words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]") & F.col(doc_id).isNotNull()
    rows, groups = _grouped(docs.where(words), doc_id, text, words_per_shingle, similar=True)
    a, b, order = free_name(docs, "first_id"), free_name(docs, "first_check"), free_name(docs, "row_order")
    first = rows.join(groups.select("fp", "component"), "fp").groupBy("component").agg(F.min(F.struct("doc_id", "check")).alias("m"))
    first = first.select(F.col("m.doc_id").alias(a), F.col("m.check").alias(b)).distinct()
    lead = docs.where(words).join(first, (docs[doc_id] == F.col(a)) & (F.xxhash64(docs[text]) == F.col(b)), "left_semi")
    by = Window.partitionBy(doc_id, F.xxhash64(text)).orderBy(*[F.xxhash64(c) for c in docs.columns])
    lead = lead.withColumn(order, F.row_number().over(by)).where(F.col(order) == 1).drop(order)
    return lead.unionByName(docs.where(~words))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
