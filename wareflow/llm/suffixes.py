"""Exact removal of repeated byte strings with longest-previous-factor arrays over suffix order.

A string of ``min_len`` bytes that occurs twice is found wherever it starts, at a cost that follows the
repeated text rather than all text:

1. Every window of ``min_len`` bytes has one anchor: the place in it whose 128-byte gram has the least
   hash. The anchor depends on the window's bytes alone, so equal windows have equal anchors. Neighbouring
   windows mostly share their anchor, so a text gives one row for about 140 bytes (``anchors``).
2. Anchors whose gram occurs once are dropped. Where all windows around an anchor (its context) are equal
   in several places, they repeat as a whole.
3. Only contexts that share a gram but differ are read again. Those of a gram meet in one task, in which
   the suffix order of all contexts is built by prefix doubling. The previous and the next smaller
   position in suffix order are the candidates for the longest earlier match; their common prefix gives
   the longest-previous-factor (LPF) array.
4. Grams with very many different contexts are compared by the hashes of their windows, one by one,
   with partial aggregation, so that no task gathers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranges, ready, scratch, text_slices, written

MIN_LEN = 400
#: Contexts of one gram that may meet in one task.
GROUP_LIMIT = 512
#: Words of a passage that counts as shared.
PASSAGE_WORDS = 51
#: Rows from which a key's rows are not gathered, the most such keys that are sent to all tasks, and copies of keys beyond that.
HOT_ROWS, HOT_KEYS, SALTS = 2000, 100_000, 16
#: Bytes of context that one task orders, and bytes whose suffixes are ordered at once.
TASK_BYTES = 16 << 20
SORT_BYTES = 1 << 18
MIX, MUL, BASE, BASE2 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gram_size(min_len: int) -> int:
    """The power of two up to 128 that leaves at least half of a window to choose an anchor from."""
    size = 1
    while size * 4 <= min_len and size < 128:
        size *= 2
    return size


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes (a power of two) from each place on, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * MUL
    h ^= h >> np.uint64(31)
    step = 1
    while step < size:
        right = h[step:]
        h = h[: len(right)] * MIX + (right ^ (right >> np.uint64(29))) * MUL
        h ^= h >> np.uint64(32)
        step *= 2
    return h


def sums_of(h: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of h[j] * base**j and powers of 1 / base, modulo 2**64: hashes of any stretch of ``h``."""
    power = np.multiply.accumulate(np.full(len(h), base, np.uint64))
    inverse = np.multiply.accumulate(np.full(len(h) + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)]), inverse


def anchors_of(data: np.ndarray, offsets: np.ndarray, min_len: int) -> tuple[np.ndarray, ...] | None:
    """Anchors of a step's texts: (text, gram hash, context hash, first and last window start)."""
    size = gram_size(min_len)
    if len(data) < min_len:
        return None
    h = gram_hashes(data, size)
    width = min_len - size + 1
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    # Least key of each stretch of ``width`` places: from blocks' running minima to either side.
    blocks = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(h) - width + 1
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    start = np.flatnonzero(np.arange(n) + min_len <= offsets[1:][text])
    if not len(start):
        return None
    at = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = text[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    lo, hi = start[first], start[np.concatenate([first[1:] - 1, [len(start) - 1]])]
    sums, inverse = sums_of(h, BASE)
    context = (sums[hi + width] - sums[lo]) * inverse[lo]
    text = text[first]
    return text, h[at[first]].view(np.int64), context.view(np.int64), lo - offsets[text], hi - offsets[text]


def suffix_ranks(data: np.ndarray, ends: np.ndarray, min_len: int, short: bool = True) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks of the suffixes by their first 8, 16, 32 ... bytes, and by their first ``min_len`` bytes.

    ``ends``: for each place, where its text ends. With ``short``, a suffix that ends early sorts first. Without, a level ranks
    the places that have all its bytes before their end, fewer than the level before, and the others hold -1.
    """
    n = len(data)
    left = ends - np.arange(n)
    every = np.arange(n)

    def dense(where: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        key = key[order]
        out = np.full(n, -1, np.int64)
        out[where[order]] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        return out

    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray(n, ">u8", padded, 0, (1,)).astype(np.uint64)
    if short:  # what follows a text's end counts as zero bytes, which the number of bytes left tells apart from real ones
        cut = (np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64)) % np.uint64(64)
        rank = dense(every, (word >> cut) << cut) * 9 + np.minimum(left, 8)
        rank = dense(every, rank)
    else:
        where = np.flatnonzero(left >= 8)
        rank = dense(where, word[where])
    levels, size = [(8, rank)], 8
    while size < min_len:
        size, shift = (2 * size, size) if 2 * size <= min_len else (min_len, min_len - size)
        where = every if short else np.flatnonzero(left >= size)
        second = np.where(left[where] > shift, rank[np.minimum(where + shift, n - 1)] + 1, 0) if short else rank[where + shift]
        rank = dense(where, rank[where] * np.int64(n + 1) + second)
        levels.append((size, rank))
    return [x for x in levels if x[0] < min_len or x[0] == 8], rank


def smaller_neighbours(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the previous and of the next smaller value of each element; -1 where there is none."""

    def previous(x: np.ndarray) -> np.ndarray:
        p = np.arange(len(x)) - 1
        at = np.flatnonzero(p >= 0)
        while len(at := at[(p[at] >= 0) & (x[p[at]] > x[at])]):
            p[at] = p[p[at]]
        return p

    after = previous(pos[::-1])[::-1]
    return previous(pos), np.where(after >= 0, len(pos) - 1 - after, -1)


def common_prefix(a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]], ends: np.ndarray, min_len: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, counted in steps of eight, up to ``min_len``."""
    done = np.zeros(len(a), np.int64)
    n = len(ends)
    again = True
    while again:
        again = False
        for size, rank in reversed(levels):
            x, y = np.minimum(a + done, n - 1), np.minimum(b + done, n - 1)
            same = (done + size <= min_len) & (a + done + size <= ends[a]) & (b + done + size <= ends[b]) & (rank[x] == rank[y])
            done[same] += size
            again |= bool(same.any()) and size == levels[-1][0]
    return done


def longest_previous_factors(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, min_len: int, lengths: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LPF of the suffixes at ``starts`` (ascending), cut at ``min_len``, with the two places it comes from.

    Returns (lpf, previous, next): previous and next are the earlier starts next to each suffix in
    suffix order if the match has the full length, else -1. Without ``lengths`` shorter matches count as 0, and each
    suffix must have ``min_len`` bytes.
    """
    ends = np.repeat(offsets[1:], np.diff(offsets))
    levels, rank = suffix_ranks(data, ends, min_len, short=lengths)
    order = np.argsort(rank[starts], kind="stable")
    in_order = starts[order]
    lpf = np.zeros(len(starts), np.int64)
    found = []
    for side in smaller_neighbours(in_order):
        has = np.flatnonzero(side >= 0)
        x, y = in_order[has], in_order[side[has]]
        full = rank[x] == rank[y]
        size = np.where(full, min_len, 0)
        if lengths:
            size[~full] = np.minimum(common_prefix(x[~full], y[~full], levels, ends, min_len), min_len - 1)
        lpf[order[has]] = np.maximum(lpf[order[has]], size)
        source = np.full(len(starts), -1)
        source[order[has[full]]] = order[side[has[full]]]
        found.append(source)
    return lpf, *found


def repeated_starts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, min_len: int, keep_first: bool) -> np.ndarray:
    """Which of ``starts`` begin a string of ``min_len`` bytes that also begins at another (an earlier) one."""
    lpf, before, after = longest_previous_factors(data, offsets, starts, min_len, lengths=False)
    out = lpf >= min_len
    if not keep_first:
        for source in (before, after):
            out[source[source >= 0]] = True
    return out


def merge_spans(first: list[int], end: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(first, end, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _runs(flag: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true flags within one group."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    cut = np.concatenate([[True], (np.diff(at) != 1) | (group[at[1:]] != group[at[:-1]])])
    first = np.flatnonzero(cut)
    return at[first], at[np.concatenate([first[1:] - 1, [len(at) - 1]])]


SPAN = "doc_id {id}, check long, first int, end int"


def repeated_spans(docs: DataFrame, min_len: int = MIN_LEN, keep: str = "first", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, check, first, end): stretches of bytes to remove from the rows of ``docs`` (doc_id, text, check).

    ``check`` is a hash of the text that tells rows of one id apart. keep="first" keeps the first copy in the
    order of (doc_id, check, place); keep="none" removes every copy. Spans may overlap.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep: first or none")
    if min_len < 16:
        raise ValueError("min_len: 16 or more")
    spark = docs.sparkSession
    ready(spark)
    id_type = docs.schema["doc_id"].dataType
    span_schema = SPAN.format(id=id_type.simpleString())
    first_only = keep == "first"

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column("text"), 2 << 20):
                if (found := anchors_of(data, offsets, min_len)) is None:
                    continue
                row, gram, context, lo, hi = found
                own = pa.array(row + at)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(own), "check": batch.column("check").take(own), "gram": pa.array(gram), "context": pa.array(context), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))})

    place = F.struct("doc_id", "check", "lo", "hi")
    stats = [F.count("*").alias("n"), F.min("context").alias("c1"), F.max("context").alias("c2")] + ([F.min(place).alias("lead")] if first_only else [])
    with scratch(spark):
        occ = written(docs.mapInArrow(anchor_rows, f"doc_id {id_type.simpleString()}, check long, gram long, context long, lo int, hi int"))
        grams = occ.groupBy("gram").agg(*stats).where("n > 1").withColumn("mixed", F.col("c1") != F.col("c2")).drop("c1", "c2")
        shared = written(with_key(occ, grams, ["gram"]), keep=True)
    whole = shared.where(~F.col("mixed"))
    mixed = shared.where("mixed").drop("lead") if first_only else shared.where("mixed")
    contexts = written(mixed.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(place).alias("lead")))
    again = with_key(mixed, contexts.where("n > 1").select("gram", "context", "lead", "n"), ["gram", "context"])
    if first_only:
        whole, again = (x.where(~place.eqNullSafe(F.col("lead"))) for x in (whole, again))
    span = ["doc_id", "check", F.col("lo").alias("first"), (F.col("hi") + min_len).alias("end")]
    out = whole.select(*span).unionByName(again.select(*span))

    # Contexts that differ around a shared gram: one of each is read again from its text.
    sizes = written(contexts.groupBy("gram").agg(F.count("*").alias("n_contexts")))
    wanted = contexts.join(sizes, "gram").select("lead.*", "gram", (F.col("n_contexts") > group_limit).alias("crowd"))
    by_doc = wanted.groupBy("doc_id", "check").agg(F.collect_list(F.struct("lo", "hi", "gram", "crowd")).alias("parts"))
    texts = docs.alias("d").join(by_doc.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.check") == F.col("w.check"))).select("d.doc_id", "d.check", "d.text", "w.parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (gram, h1, h2, doc_id, check, lo, windows, bytes): a context, or one window of a crowded gram."""
        for batch in batches:
            ids, checks, parts = batch.column("doc_id").to_pylist(), batch.column("check").to_pylist(), batch.column("parts")
            for at, data, offsets in text_slices(batch.column("text")):
                raw = data.tobytes()
                rows, crowd = [], []
                for k in range(len(offsets) - 1):
                    for p in parts[at + k].as_py():
                        a, b = int(offsets[k]) + p["lo"], int(offsets[k]) + p["hi"] + min_len
                        if not p["crowd"]:
                            rows.append((p["gram"], None, None, ids[at + k], checks[at + k], p["lo"], p["hi"] - p["lo"] + 1, raw[a:b]))
                            continue
                        h = gram_hashes(data[a:b], gram_size(min_len))
                        width = min_len - gram_size(min_len) + 1
                        n = p["hi"] - p["lo"] + 1
                        codes = []
                        for base in (BASE, BASE2):
                            s, inverse = sums_of(h, base)
                            codes.append(((s[width : width + n] - s[:n]) * inverse[:n]).view(np.int64).tolist())
                        crowd += [(p["gram"], x, y, ids[at + k], checks[at + k], p["lo"] + j, 1, None) for j, (x, y) in enumerate(zip(*codes, strict=True))]
                        if len(crowd) > 50_000:
                            yield from _batch(crowd)
                            crowd = []
                yield from _batch(rows + crowd)

    names = ["gram", "h1", "h2", "doc_id", "check", "lo", "windows", "bytes"]
    arrow_id = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}.get(id_type)
    if arrow_id is None:
        raise TypeError(f"doc_id: {id_type.simpleString()} is not supported")
    kinds = [pa.int64(), pa.int64(), pa.int64(), arrow_id, pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    pieces = written(texts.mapInArrow(cut, f"gram long, h1 long, h2 long, doc_id {id_type.simpleString()}, check long, lo int, windows int, bytes binary"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(tables).combine_chunks()
            for _, data, offsets in text_slices(t.column("bytes"), 1 << 62):
                n = t.column("windows").to_numpy().astype(np.int64)
                starts = ranges(offsets[:-1], n)
                owner = np.repeat(np.arange(len(n)), n)
                a, b = _runs(repeated_starts(data, offsets, starts, min_len, first_only), owner)
                lo = t.column("lo").to_numpy()[owner[a]] - offsets[owner[a]]
                own = pa.array(owner[a])
                cols = {c: t.column(c).take(own).combine_chunks() for c in ("doc_id", "check")}
                cols |= {"first": pa.array((lo + starts[a]).astype(np.int32)), "end": pa.array((lo + starts[b] + min_len).astype(np.int32))}
                yield pa.RecordBatch.from_pydict({k: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for k, v in cols.items()})

        for batch in batches:
            grams_ = batch.column("gram").to_numpy()
            cut_at = np.flatnonzero(np.concatenate([[last is None or grams_[0] != last], grams_[1:] != grams_[:-1]])) if len(grams_) else []
            sizes_ = np.cumsum(np.concatenate([[0], pa.compute.binary_length(batch.column("bytes")).to_numpy()])) if len(grams_) else [0]
            begin = 0
            for c in cut_at:
                grown = size + int(sizes_[c] - sizes_[begin])
                if grown >= SORT_BYTES:
                    if c > begin:
                        held.append(batch.slice(begin, c - begin))
                    if held:
                        yield from flush(held)
                    held, size, begin = [], 0, int(c)
            if len(grams_) > begin:
                held.append(batch.slice(begin))
                size += int(sizes_[-1] - sizes_[begin])
                last = grams_[-1]
        if held:
            yield from flush(held)

    near = pieces.where("h1 IS NULL").drop("h1", "h2")
    size = near.agg(F.sum(F.col("windows") + min_len - 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    near = near.repartition(parts, "gram").sortWithinPartitions("gram", "doc_id", "check", "lo").mapInArrow(match, span_schema)
    crowd = pieces.where("h1 IS NOT NULL").select("h1", "h2", "doc_id", "check", "lo")
    same = crowd.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "check", "lo")).alias("lead")).where("n > 1")
    hit = with_key(crowd, same, ["h1", "h2"])
    if first_only:
        hit = hit.where(~F.struct("doc_id", "check", "lo").eqNullSafe(F.col("lead")))
    hit = hit.select("doc_id", "check", F.col("lo").alias("first"), (F.col("lo") + min_len).alias("end"))
    return out.unionByName(near).unionByName(hit)


def with_key(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``keys`` (on, n, ...) on ``on``, without n; ``n``: how often a key occurs in ``rows``.

    Rows of frequent keys stay where they are: those keys are sent to all tasks if they are few by count, else
    all keys are copied and the rows of one key are dealt over the copies.
    """
    keys = written(keys)
    often = keys.where(F.col("n") > HOT_ROWS)
    n_often = often.count()
    if not n_often:
        return rows.join(keys.drop("n"), on)
    if n_often <= HOT_KEYS:
        rare = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(keys.where(F.col("n") <= HOT_ROWS).drop("n"), on)
        return rare.unionByName(rows.join(F.broadcast(often.drop("n")), on))
    salt = F.pmod(F.xxhash64("doc_id", "check", "lo"), F.lit(SALTS)).cast("int")
    copied = keys.drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(copied, [*on, "salt"]).drop("salt")


#: True for the bytes between words.
GAP = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): 64-bit hashes of the words of all texts, and where each text's words begin."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gap = GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~gap
    first = np.flatnonzero(inside & np.concatenate([[True], gap[:-1] | edge[1:-1]]))
    end = np.flatnonzero(inside & np.concatenate([gap[1:] | edge[1:-1], [True]])) + 1
    sums, inverse = sums_of((data.astype(np.uint64) + np.uint64(1)) * MUL, BASE)
    h = (sums[end] - sums[first]) * inverse[first]
    h = (h ^ (h >> np.uint64(29))) * MIX + (end - first).astype(np.uint64)
    return h ^ (h >> np.uint64(32)), np.searchsorted(first, offsets)


def shared_passages(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, check, n_shared_words) of the rows of ``docs`` (doc_id, text, check) that have any: the words that lie in
    runs of ``words`` words or more which another document has too, whatever white space parts them.

    The same anchors as for bytes, over word hashes: windows of ``words`` words around a gram that two documents
    share are compared by hash, those of one context at once. Rows that repeat id and text are one document.
    """
    spark = docs.sparkSession
    ready(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    doc = F.xxhash64("doc_id", "check")
    sides = [F.min(doc).alias("a"), F.max(doc).alias("b")]

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch.column("text"), 1 << 20):
                if (found := anchors_of(*word_hashes(data, offsets), words)) is None:
                    continue
                row, gram, context, lo, hi = found
                own = pa.array(row + at)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(own), "check": batch.column("check").take(own), "gram": pa.array(gram), "context": pa.array(context), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))})

    with scratch(spark):
        occ = written(docs.mapInArrow(anchor_rows, f"doc_id {id_type}, check long, gram long, context long, lo int, hi int"))
        grams = occ.groupBy("gram").agg(*sides, F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where("a <> b").drop("a", "b")
        shared = written(with_key(occ, grams, ["gram"]), keep=True)
    with scratch(spark):
        return written(_shared_words(docs, shared, words), keep=True)


def _shared_words(docs: DataFrame, shared: DataFrame, words: int) -> DataFrame:
    """The shared words by document; ``shared``: the places (doc_id, check, gram, context, lo, hi, mixed) of grams of two documents."""
    size = gram_size(words)
    width = words - size + 1
    doc = F.xxhash64("doc_id", "check")
    mixed = shared.where("mixed")
    contexts = written(mixed.groupBy("gram", "context").agg(F.min(doc).alias("a"), F.max(doc).alias("b"), F.count("*").alias("n"), F.min(F.struct("doc_id", "check", "lo", "hi")).alias("lead")))
    again = with_key(mixed, contexts.where("a <> b").select("gram", "context", "n"), ["gram", "context"])
    span = ["doc_id", "check", F.col("lo").alias("first"), (F.col("hi") + words).alias("end")]
    out = shared.where(~F.col("mixed")).select(*span).unionByName(again.select(*span))

    # One text of each context that differs from others around its gram is read again for the hashes of its windows.
    wanted = contexts.select("lead.*", "gram", "context", "a", "b").groupBy("doc_id", "check").agg(F.collect_list(F.struct("lo", "hi", "gram", "context", "a", "b")).alias("parts"))
    one = docs.dropDuplicates(["doc_id", "check"])
    texts = one.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.check") == F.col("w.check"))).select("d.text", "w.parts")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")
            for at, data, offsets in text_slices(batch.column("text"), 1 << 20):
                h, first = word_hashes(data, offsets)
                sums, inverse = sums_of(gram_hashes(h, size), BASE2)
                code = ((sums[width:] - sums[:-width]) * inverse[: len(sums) - width]).view(np.int64)
                own = lists.slice(at, len(offsets) - 1)
                part = dict(zip(("lo", "hi", "gram", "context", "a", "b"), own.flatten().flatten(), strict=True))
                lo, hi = (part[c].to_numpy().astype(np.int64) for c in ("lo", "hi"))
                begin = np.repeat(first[:-1], own.value_lengths().to_numpy()) + lo
                n = hi - lo + 1
                of = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_pydict({c: part[c].take(of) for c in ("gram", "context", "a", "b")} | {"w": pa.array(code[ranges(begin, n)]), "j": pa.array(ranges(np.zeros(len(n), np.int64), n).astype(np.int32))})

    pieces = written(texts.mapInArrow(windows, "gram long, context long, a long, b long, w long, j int"))
    met = pieces.groupBy("gram", "w").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n")).where("a <> b AND n > 1").select("gram", "w", "n")
    lone = pieces.where("a = b").withColumnsRenamed({"context": "doc_id", "j": "lo"}).withColumn("check", F.col("w"))
    hit = with_key(lone.select("gram", "w", "doc_id", "check", "lo"), met, ["gram", "w"]).select("gram", F.col("doc_id").alias("context"), F.col("lo").alias("j"))
    hit = hit.groupBy("gram", "context").agg(F.sort_array(F.collect_list("j")).alias("js"))  # at most a window's anchors: bounded by ``words``
    # Nearly all contexts of one document occur once, at their lead.
    once = contexts.where("a = b AND n = 1").join(hit, ["gram", "context"]).select("lead.doc_id", "lead.check", "lead.lo", "js")
    more = with_key(mixed, contexts.where("a = b AND n > 1").join(hit, ["gram", "context"]).select("gram", "context", "js", "n"), ["gram", "context"]).select("doc_id", "check", "lo", "js")
    few = once.unionByName(more).select("doc_id", "check", "lo", F.explode("js").alias("j"))
    out = out.unionByName(few.select("doc_id", "check", (F.col("lo") + F.col("j")).alias("first"), (F.col("lo") + F.col("j") + words).alias("end")))
    spans = out.groupBy("doc_id", "check").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate("spans", start, lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["first"]))).alias("n")))["n"]
    return spans.select("doc_id", "check", total.alias("n_shared_words"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_len: int = MIN_LEN, keep: str = "first", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): per row the removed byte spans, merged and in order, and the bytes left.

    Texts are UTF-8 bytes, null counts as empty; matches never cross rows. Rows that repeat an id or a whole
    text are rows of their own, so each is a copy of the other; of equal rows keep="first" keeps one. Texts under ``min_len`` bytes stay whole. Null
    ids are allowed. Further columns are ignored; an empty table gives an empty result. ``kept`` is binary,
    because a removed span may end inside a character.
    """
    return _removed(_rows(docs, doc_id, text), min_len, keep, group_limit).drop("check")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("check", F.xxhash64("text"))


def _removed(rows: DataFrame, min_len: int, keep: str, group_limit: int) -> DataFrame:
    if keep == "first":  # all of an equal row is a copy of the first one, so only that one takes part
        same = Window.partitionBy("doc_id", "check", "text").orderBy(F.lit(1))
        rows = written(rows.withColumn("copy", F.row_number().over(same)))
    else:
        rows = rows.withColumn("copy", F.lit(1))
    spans = repeated_spans(rows.where("copy = 1").drop("copy"), min_len, keep, group_limit).groupBy("doc_id", "check").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    joined = rows.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.check") == F.col("s.check")), "left")
    whole = F.when(F.octet_length("d.text") >= min_len, F.array(F.struct(F.lit(0).alias("first"), F.octet_length("d.text").alias("end"))))
    joined = joined.select("d.doc_id", "d.check", "d.text", F.when(F.col("d.copy") == 1, F.col("s.spans")).otherwise(whole).alias("spans"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans_ = batch.column("spans")
            for at, data, offsets in text_slices(batch.column("text")):
                raw, ends = data.tobytes(), offsets.tolist()
                removed, kept = [], []
                for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    s = spans_[at + k]
                    own = s.values.flatten() if s.is_valid else None
                    gone = merge_spans(own[0].to_pylist(), own[1].to_pylist()) if own else []
                    edge = [0, *[x for g in gone for x in g], b - a]
                    removed.append([{"first": x, "end": y} for x, y in gone])
                    kept.append(raw[a:b] if not gone else b"".join(raw[a + x : a + y] for x, y in zip(edge[::2], edge[1::2], strict=True)))
                n = pa.array(np.diff(offsets))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(n)), "check": batch.column("check").slice(at, len(n)), "n_bytes": n, "removed": pa.array(removed, kind), "kept": pa.array(kept, pa.binary())})

    return joined.mapInArrow(apply, f"doc_id {id_type}, check long, n_bytes long, removed array<struct<first: int, end: int>>, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 with every copy removed, and n_shared_words (``shared_passages``).

    Passages of just over 50 words often have under 400 bytes, so that their copies stay; n_shared_words tells where they are.
    """
    rows = _rows(docs, "doc_id", "text")
    found = shared_passages(rows)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]).cast("long"))
    done = _removed(rows, MIN_LEN, "none", GROUP_LIMIT).select("doc_id", "check", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    joined = done.alias("d").join(found.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.check") == F.col("s.check")), "left")
    return joined.select("d.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_shared_words", F.lit(0).cast("long")).alias("n_shared_words"))
