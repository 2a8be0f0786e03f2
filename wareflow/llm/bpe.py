"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of a step lie in one flat symbol array. Each round looks up the rank of every changed pair by
binary search over the sorted pair keys, takes the least rank of each word, and merges all places of
that pair. Words that have no pair left leave the arrays. A merge only makes pairs of a higher rank, so
merging all places of a word's least pair at once gives what merging them one by one gives.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, ranges, ready, text_slices

#: Bytes of text that one round of numpy steps holds.
STEP_BYTES = 3 << 19
NO_PAIR = np.int32(2**31 - 1)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def char_classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    out[WHITE_SPACE] = SPACE
    return out


class Tables:
    """What encoding and decoding need of a tokenizer file; its size is fixed by the vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab, to_byte = spec["model"]["vocab"], byte_symbols()
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        text = [b""] * size
        for token, i in vocab.items():
            text[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            text[i] = token
        self.token_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.token_len = np.array([len(x) for x in text], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.byte_id = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = size
        key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.classes = char_classes()
        self.prefix_space = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        if self.prefix_space or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: prefix spaces and stripping special tokens are not supported")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NO_PAIR)


def word_starts(data: np.ndarray, cuts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which the words of UTF-8 ``data`` start; ``cuts``: offsets where a text starts.

    The splitting rule of the byte-level vocabularies: short forms after an apostrophe, then runs of
    letters, of numbers, of other signs, each with one space before it, then white space.
    """
    n_bytes = len(data)
    if not n_bytes:
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    kind = classes[cp]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(lead, cuts)] = True
    edge[0] = edge[n] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run.copy()
    # The last white space before a word starts a token; a plain space belongs to that word's token.
    before = np.flatnonzero(run[1:n] & ~edge[1:n] & (kind[: n - 1] == SPACE))
    start[before] = True
    start[before[cp[before] == 0x20] + 1] = False
    # Short forms: a lone apostrophe that doesn't follow a plain space.
    quote = np.flatnonzero((cp == 0x27) & run[:n] & run[1:] & ~edge[1:] & start[:n])
    if len(quote):
        wide = np.concatenate([cp, np.zeros(3, np.uint32)])
        one, two = wide[quote + 1], wide[quote + 2]
        two[edge[np.minimum(quote + 2, n)]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    return lead[np.flatnonzero(start[:n])]


def merge_words(data: np.ndarray, offsets: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """BPE of each word of ``data``: all ids one after the other, and each word's number of ids."""
    sym = t.byte_id[data]
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rank = np.full(len(sym), NO_PAIR, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = t.ranks(sym[inner], sym[inner + 1])
    done_sym, done_word = [], []
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.concatenate([first, [len(sym)]]))
        best = np.repeat(np.minimum.reduceat(rank, first), size)
        open_ = best < NO_PAIR
        if not open_.all():
            done_sym.append(sym[~open_])
            done_word.append(word[~open_])
            sym, word, rank, best = sym[open_], word[open_], rank[open_], best[open_]
            if not len(sym):
                break
        at = np.flatnonzero(rank == best)
        # Of overlapping places (a a a), take every second one from the left.
        k = np.arange(len(at))
        fresh = np.concatenate([[True], np.diff(at) != 1])
        at = at[(k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0]
        sym[at] = t.merged[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new = at - np.arange(len(at))  # a place moves left by the merges before it
        sym, word, rank = sym[keep], word[keep], rank[keep]
        fix = np.concatenate([new, new[new > 0] - 1])
        last = np.concatenate([word[1:] != word[:-1], [True]])[fix]
        rank[fix[last]] = NO_PAIR
        fix = fix[~last]
        rank[fix] = t.ranks(sym[fix], sym[fix + 1])
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(offsets) - 1)


def encode_slice(data: np.ndarray, offsets: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of one step, and each text's number of ids."""
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        raw = data.tobytes()
        parts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    raw, found = data.tobytes(), []
    for token, i in t.special.items():
        at = raw.find(token)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(token) <= offsets[row + 1]:
                found.append((at, len(token), i))
                at = raw.find(token, at + len(token))
            else:  # across two texts
                at = raw.find(token, at + 1)
    cuts = [offsets[:-1][offsets[:-1] < len(data)], *[np.array([at, min(at + size, len(data) - 1)]) for at, size, _ in found]]
    starts = word_starts(data, np.unique(np.concatenate(cuts)).astype(np.int64), t.classes)
    for at, size, _ in found:
        starts = starts[(starts <= at) | (starts >= at + size)]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    ends = np.concatenate([starts, [len(data)]]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    unique = words.dictionary
    n = len(unique)
    off = np.frombuffer(unique.buffers()[1], np.int32, n + 1, unique.offset * 4).astype(np.int64)
    ids, count = merge_words(np.frombuffer(unique.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0], t)
    first = np.cumsum(count) - count
    size = count[which]
    flat = ids[ranges(first[which], size)]
    if found:
        flat_at = np.cumsum(size) - size
        drop = np.zeros(len(flat), bool)
        for at, _, i in found:
            w = int(np.searchsorted(starts, at))
            drop[flat_at[w] + 1 : flat_at[w] + size[w]] = True
            flat[flat_at[w]] = i
            size[w] = 1
        flat = flat[~drop]
    row = np.searchsorted(offsets, starts, "right") - 1
    return flat, np.bincount(row, weights=size, minlength=len(offsets) - 1).astype(np.int64)


def decode_slice(ids: np.ndarray, counts: np.ndarray, t: Tables) -> list[str]:
    """Texts of id lists that lie one after the other; bytes that are not UTF-8 become U+FFFD."""
    size = t.token_len[ids]
    data = t.token_bytes[ranges(t.token_at[ids], size)].tobytes()
    per_token = np.concatenate([[0], np.cumsum(size)])
    ends = per_token[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _columns(batch: pa.RecordBatch, drop: str | None = None) -> dict:
    return {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != drop}


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out`` (array<int>): the BPE ids of column ``text`` under the tokenizer file ``path``.

    Null and empty texts give an empty list. Whole texts are encoded, whatever their length; a special
    token's string in a text becomes that token. All rows and other columns stay (repeated rows too);
    a column of the name ``out`` is refused. No shuffle.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    spark = docs.sparkSession
    ready(spark)
    tables = spark.sparkContext.broadcast(Tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(text), STEP_BYTES):
                ids, counts = encode_slice(data, offsets, t)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                col = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(_columns(batch.slice(at, len(counts))) | {out: col})

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), True))])
    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (string): the text of the id list in column ``ids``; null gives an empty text.

    Special tokens are kept. Ids outside the vocabulary fail the job.
    """
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    spark = docs.sparkSession
    ready(spark)
    tables = spark.sparkContext.broadcast(Tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        for batch in batches:
            col = batch.column(ids)
            ends = np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            step = 0
            while step < len(col):
                end = min(len(col), max(step + 1, int(np.searchsorted(ends, ends[step] + STEP_BYTES // 4, "right")) - 1))
                texts = decode_slice(flat[ends[step] : ends[end]], np.diff(ends[step : end + 1]), t)
                yield pa.RecordBatch.from_pydict(_columns(batch.slice(step, end - step)) | {out: pa.array(texts, pa.string())})
                step = end

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])
    return docs.mapInArrow(run, schema)


def ids_digest(docs: DataFrame, ids: str = "ids", out: str = "ids_sha256") -> DataFrame:
    """Replace the id list by its length ``n_tokens`` and the SHA-256 of its 32-bit little-endian form."""
    ready(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.names.index(ids))
            n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n)]).tolist()
            raw = memoryview(col.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(_columns(batch, ids) | {"n_tokens": pa.array(n), out: pa.array(digests)})

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField(out, T.StringType())]))


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text)."""
    coded = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return ids_digest(coded.select("doc_id", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


__all__ = ["Tables", "decode", "decode_slice", "encode", "encode_slice", "free_name", "ids_digest", "round_trip_digests"]
