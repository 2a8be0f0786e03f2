"""Importance resampling towards a target: documents whose hashed n-grams look like the target's are drawn first.

The texts of a step are joined with separator bytes and one pass of a pattern finds all their words. The word
starts' places among the text starts say which n-grams would cross into another text; those are masked. What
remains is hashed into buckets and counted with ``bincount``. Gains of the buckets weigh the documents, and Gumbel
noise keyed by the document makes the draw without replacement a sort by score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, ready, text_slices, written

BUCKETS = 10_000
#: Words, after A-Z are lowered: 0-9, a-z and all bytes of non-ASCII characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Distinct words whose hash a task remembers before it starts anew.
REMEMBERED = 1 << 18


class _Hashes(dict):
    """CRC-32 of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = zlib.crc32(word)
        return value


class Featurizer:
    """Buckets of the n-grams of ``low`` to ``high`` words, over many texts at once."""

    def __init__(self, low: int = 1, high: int = 1, buckets: int = BUCKETS):
        if not 1 <= low <= high or buckets < 1:
            raise ValueError("n-gram sizes must be 1 <= low <= high, buckets positive")
        self.low, self.high, self.buckets = low, high, buckets
        self.known = _Hashes()

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket) of every n-gram and the number of words of every text, for texts at ``offsets`` of ``data``."""
        n = len(offsets) - 1
        # Text k starts at offsets[k] + k: a separator follows each text.
        joined = np.insert(data, offsets[1:], 0).tobytes().translate(LOWER)
        begins = offsets[:-1] + np.arange(n)
        starts, words = [], []
        for m in WORD.finditer(joined):
            starts.append(m.start())
            words.append(m[0])
        text = np.searchsorted(begins, np.array(starts, np.int64), "right") - 1
        count = np.bincount(text, minlength=n)
        known, parts, owners = self.known, [], []
        first = np.fromiter(map(known.__getitem__, words), np.uint32, len(words)).astype(np.int64) if words else np.zeros(0, np.int64)
        if self.low == 1:
            parts.append(first % self.buckets)
            owners.append(text)
        ends = first.tolist() if self.high > 1 else []
        for size in range(2, self.high + 1):
            # ends[i]: hash of the size - 1 words from word i on, continued by a space and the next word.
            ends = [zlib.crc32(b" " + w, h) for h, w in zip(ends, words[size - 1 :], strict=False)]
            whole = text[: len(ends)] == text[size - 1 :]
            if size >= self.low:
                parts.append(np.array(ends, np.int64)[whole] % self.buckets)
                owners.append(text[: len(ends)][whole])
        return np.concatenate(owners), np.concatenate(parts), count


def bucket_counts(docs: DataFrame, text: str = "text", low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket; buckets without any are left out.

    Each task adds up its own texts, so at most ``buckets`` rows a task are shuffled. Null texts have no words.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Featurizer(low, high, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                total += np.bincount(features.features(data, offsets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some), "n": pa.array(total[some])})

    return docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln of target share over source share), each count plus one; ``buckets`` numbers on the driver."""
    counts = []
    for side in (source, target):
        one = np.zeros(buckets, np.int64)
        for r in side.collect():  # at most one row a bucket
            one[r.bucket] = r.n
        counts.append(one)
    s, t = counts
    total_s, total_t = int(s.sum()), int(t.sum())
    return np.floor(1000 * np.log((t + 1.0) * (total_s + buckets) / ((s + 1.0) * (total_t + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", low: int = 1, high: int = 1, out: str = "features") -> DataFrame:
    """Add struct ``out`` (n_words, n_features, weight): the sum of ``gain`` over the n-grams of each text.

    Null and empty texts have zeros. All rows and columns stay; a column named ``out`` in any letter case is refused. No shuffle.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} exists")
    spark = docs.sparkSession
    ready(spark)
    sent, at = spark.sparkContext.broadcast(gain), docs.columns.index(text)
    names = docs.columns
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        features = Featurizer(low, high, len(gain))
        for batch in batches:
            words, size, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for row, data, offsets in text_slices(batch.column(at)):
                owner, bucket, count = features.features(data, offsets)
                place = slice(row, row + len(count))
                words[place], size[place] = count, np.bincount(owner, minlength=len(count))
                # Sums of whole numbers, exact in doubles below 2 ** 53.
                weight[place] = np.bincount(owner, weights=gain[bucket], minlength=len(count))
            column = pa.StructArray.from_arrays([pa.array(words), pa.array(size), pa.array(weight)], ["n_words", "n_features", "weight"])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, kind)]))


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u in (0, 1) from the first 32 bits of SHA-256 of ``seed:key``; a null key counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, eligible: Column, score: str = "score", key: str = "doc_id", percent: int = 10, out: str = "rank") -> DataFrame:
    """Add ``out``: 1, 2, 3 ... for the floor(percent N / 100) best of the N eligible rows, ties to the smaller key; null for others.

    Rows are dealt by ranges of score and key, written, and counted by part; a row's rank is its place in its part after the
    rows of the parts before. No step sees more than one part; the parts' counts are all that is sent around.
    """
    if out.lower() in {c.lower() for c in scored.columns}:
        raise ValueError(f"column {out} exists")
    late, part, tie = (free_name(scored, n) for n in ("late", "part", "tie"))
    # Ranges come from a sample of the rows, which aren't to be made twice for it.
    rows = written(scored).withColumn(late, ~F.coalesce(eligible, F.lit(False))).withColumn(tie, F.monotonically_increasing_id())
    order = [F.col(late).asc(), F.col(score).desc_nulls_last(), F.col(key).asc_nulls_last(), F.col(tie).asc()]
    # The parts have to stay what was counted.
    dealt = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = {r[part]: (r["n"], r["ok"]) for r in dealt.groupBy(part).agg(F.count("*").alias("n"), F.count_if(~F.col(late)).alias("ok")).collect()}
    best, before, ahead = sum(ok for _, ok in sizes.values()) * percent // 100, {}, 0
    for k in sorted(sizes):
        before[k] = ahead
        ahead += sizes[k][0]
    # Parts that begin behind the last drawn row need no order.
    drawn = [k for k in before if before[k] < best]
    spark = scored.sparkSession
    starts = spark.createDataFrame([(k, before[k]) for k in drawn], f"{part} int, ahead long")
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order)) + F.col("ahead")
    first = dealt.where(F.col(part) <= max(drawn, default=-1))
    ranked = first.join(F.broadcast(starts), part).withColumn(out, F.when((place <= best) & ~F.col(late), place.cast("long")))
    rest = dealt.where(F.col(part) > max(drawn, default=-1)).withColumn(out, F.lit(None).cast("long"))
    return ranked.select(*scored.columns, out).unionByName(rest.select(*scored.columns, out))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", key: str = "doc_id", low: int = 1, high: int = 1, buckets: int = BUCKETS, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """All rows of ``docs`` with n_features, weight, score and rank (null where not drawn).

    Repeated rows count and are drawn each on their own. Null and empty texts weigh 0 and are never drawn with ``min_words``
    over 0. Empty tables give an empty result; an empty target leaves each bucket at its plus one. Texts are whole,
    whatever their length. Columns of the result's names, in any letter case, are refused.
    """
    taken = {c.lower() for c in docs.columns} & {"n_features", "weight", "score", "rank"}
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist")
    gain = gains(bucket_counts(docs, text, low, high, buckets), bucket_counts(target, target_text, low, high, buckets), buckets)
    name, words = free_name(docs, "features"), free_name(docs, "n_words")
    weighed = weigh(docs, gain, text, low, high, name)
    scored = weighed.select(*docs.columns, F.col(f"{name}.n_words").alias(words), F.col(f"{name}.n_features").alias("n_features"), F.col(f"{name}.weight").alias("weight"), (F.col(f"{name}.weight") + gumbel(F.col(key), seed)).alias("score"))
    return draw(scored, F.col(words) >= min_words, "score", key, percent).drop(words)


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text) against all texts of ``target``."""
    # The draw carries no texts.
    gain = gains(bucket_counts(docs), bucket_counts(target))
    weighed = weigh(docs.select("doc_id", "text"), gain).select("doc_id", "features.*")
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), 2024))
    return draw(scored, F.col("n_words") >= 20).select("doc_id", "n_features", "weight", "score", "rank")


__all__ = ["Featurizer", "bucket_counts", "draw", "gains", "gumbel", "report", "resample", "weigh"]
