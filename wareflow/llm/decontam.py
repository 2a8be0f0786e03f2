"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

Texts are scanned once. Matches are found on the normalised words and mapped back to words and to byte
offsets of the original text.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, ready, text_slices, written

WINDOW = 13
#: Benchmark text that one automaton may hold. A larger benchmark is scanned for in several passes.
MAX_PATTERN_BYTES = 8 << 20

#: Bytes that belong to words: 0-9, a-z, and all bytes of non-ASCII characters; A-Z are lowered, others split.
NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


def windows(raw: bytes, size: int = WINDOW) -> list[bytes]:
    """The windows of ``size`` consecutive words; fewer words, but not none, are one window."""
    words = words_of(raw)
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Matcher:
    """Automaton over the windows of (item_id, text) rows. Bytes are held as Latin-1 characters."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        of: dict[bytes, set[str]] = {}
        for item, raw in items:
            for w in windows(raw, size):
                of.setdefault(w, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w, ids in of.items():
            # Spaces around a pattern keep matches to whole words.
            self.automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(ids))))
        if of:
            self.automaton.make_automaton()
        self.any = bool(of)

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, spans of hit words as [first, end), ids of the items found)."""
        words = words_of(raw)
        if not self.any or not words:
            return len(words), [], set()
        line = f" {b' '.join(words).decode('latin-1')} "
        hits, items, ends = [], set(), None
        for at, (n, ids) in self.automaton.iter(line):
            if ends is None:  # place of the space after each word
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
            last = bisect.bisect_left(ends, at) + 1
            hits.append((last - n, last))
            items.update(ids)
        spans: list[tuple[int, int]] = []
        for a, b in sorted(hits):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        return len(words), spans, items


def word_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets [start, end) of each word in the original text."""
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 0x20
    step = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _groups(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's rows in groups of at most about ``limit`` bytes of text, each fetched on its own."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // limit))
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield [(r.i, r.t.encode()) for r in part.collect()]


HIT = "n_words long, word_spans array<struct<first: int, end: int>>, byte_spans array<struct<first: int, end: int>>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES, out: str = "hit") -> DataFrame:
    """Add struct ``out`` (n_words, word_spans, byte_spans, items) to ``docs``: what of the benchmark each text holds.

    Null and empty texts have no words; items without a word match nothing; repeated items count once by
    id, and a null id counts as the empty id. All rows and columns stay; a column named ``out`` is refused.
    One pass without shuffle while the benchmark has at most ``max_pattern_bytes`` (measured first);
    a larger one takes one pass for each part, each adding to the spans found before.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    spark = docs.sparkSession
    ready(spark)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(HIT))])
    found, names = None, docs.columns
    for items in _groups(benchmark, item_id, item_text, max_pattern_bytes):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, again=found is not None) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, window)
            kind = pa.struct([("n_words", pa.int64()), ("word_spans", span := pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), ("byte_spans", span), ("items", pa.list_(pa.string()))])
            for batch in batches:
                old = batch.column(out).to_pylist() if again else None
                hits = []
                for at, data, offsets in text_slices(batch.column(text)):
                    whole, ends = data.tobytes(), offsets.tolist()
                    for k in range(len(ends) - 1):
                        raw = whole[ends[k] : ends[k + 1]]
                        n, spans, ids = matcher.scan(raw)
                        if old and (was := old[at + k])["word_spans"]:
                            ids |= set(was["items"])
                            spans = _merged(spans + [(s["first"], s["end"]) for s in was["word_spans"]])
                        places = []
                        if spans:
                            first, end = word_bytes(raw)
                            places = [{"first": int(first[a]), "end": int(end[b - 1])} for a, b in spans]
                        hits.append({"n_words": n, "word_spans": [{"first": a, "end": b} for a, b in spans], "byte_spans": places, "items": sorted(ids)})
                cols = {n: batch.column(n) for n in names}
                yield pa.RecordBatch.from_pydict(cols | {out: pa.array(hits, kind)})

        found = (docs if found is None else written(found)).mapInArrow(run, schema)
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit(out: str = "hit"):
    return F.aggregate(f"{out}.word_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]).cast("long"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs`` (doc_id, text)."""
    h = scan(docs.select("doc_id", "text"), benchmark).select("doc_id", "hit.n_words", n_hit().alias("n_hit"), F.col("hit.items").alias("items"))
    return h.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which less than a twentieth of the words lie in benchmark windows."""
    name = free_name(docs, "hit")
    h = scan(docs, benchmark, text, out=name)
    return h.where((n_hit(name) == 0) | (20 * n_hit(name) < F.col(f"{name}.n_words"))).drop(name)


__all__ = ["Matcher", "drop_contaminated", "report", "scan", "windows", "words_of"]
