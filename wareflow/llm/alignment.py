"""Cross-tokenizer alignment: which tokens of a byte-level BPE and of a piece model cover the same bytes of a text.

The tokens of both sides, of all texts of a step, are sorted by the byte at which they start; the running maximum of
their ends says how far the text is covered, and a token that starts where everything before has ended opens a new
group. Tokens of a group are linked with each other. How many texts hold a pair of ids linked is counted over the
whole corpus, and tells the usual partner of an id from chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import frequent_bound, ranges, ready, text_slices, written

#: Bytes of text in one numpy step.
STEP_BYTES = 1 << 19
#: Most pairs of ids whose counts are sent to all tasks, 20 bytes each; the others' counts come by a join.
SENT_PAIRS = 1 << 20
#: A ids of the rows whose links one numpy step holds.
STEP_TOKENS = 1 << 16
#: Pairs that a task collects before it adds them up.
HELD_PAIRS = 1 << 19
#: Chunks of text whose pieces a task remembers before it starts anew.
REMEMBERED = 1 << 17
#: Links of a group that are written out one by one; in a larger group equal ids are put together first.
WIDE = 4096
SPACE_MARK = "▁"


class Pieces:
    """A piece model that encodes each distinct chunk of a step once.

    A chunk starts with the spaces before a word. No piece has a space mark behind another character, so no merge
    crosses from one chunk into the next, and the chunks' pieces are the text's pieces.
    """

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("pieces that reach over a space are not supported")
        text = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        #: Pieces of a space alone; without such a piece no tokens have its byte.
        self.space = [pieces.index(SPACE_MARK)] if SPACE_MARK in pieces else []
        self.size = len(pieces)
        self.token_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.token_len = np.array([len(x) for x in text], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.forget()

    def forget(self) -> None:
        """Chunks met so far by number, and the ids of all of them one after the other."""
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, chunks: list[bytes]) -> None:
        # The model puts the first space itself.
        made = self.model.encode([c[1:] for c in chunks], num_threads=1)
        # ... but not where nothing follows: the chunk of a text's single last space.
        made = [self.space if c == b" " else m for c, m in zip(chunks, made, strict=True)]
        count = np.fromiter(map(len, made), np.int64, len(made))
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), np.int32, int(count.sum()))])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that start with a space each, and each text's number of ids; the bytes have to be UTF-8."""
        space = data == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1]] = True
        starts = np.flatnonzero(start)
        ends = np.concatenate([starts, [len(data)]]).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which = chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = chunks.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = distinct
        if new:
            self.learn(new)
        which = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[which]
        size = self.count[which]
        flat = self.ids[ranges(self.first[which], size)].astype(np.int64)
        row = np.searchsorted(offsets, starts, "right") - 1
        return flat, np.bincount(row, weights=size, minlength=len(offsets) - 1).astype(np.int64)


def groups(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token; both sides cover the same bytes, tokens have at least one byte."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    start, end = np.concatenate([a_end - a_len, b_end - b_len]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.repeat([0, 1], [len(a_len), len(b_len)]), start))
    reach = np.maximum.accumulate(end[order])
    opens = np.ones(len(order), np.int64)
    opens[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    return group[: len(a_len)], group[len(a_len) :]


def links(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id, times) of all links; within a wide group equal ids come once, with their number."""
    a_times, b_times = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    a_size, b_size = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
    if len(a) and (a_size * b_size).max() > WIDE:
        a_group, a, a_times = _tally(a_group, a)
        b_group, b, b_times = _tally(b_group, b)
        b_size = np.bincount(b_group, minlength=n_groups)
    b_first = np.cumsum(b_size) - b_size
    partners = b_size[a_group]
    left, right = np.repeat(np.arange(len(a)), partners), ranges(b_first[a_group], partners)
    return a_group[left], a[left], b[right], a_times[left] * b_times[right]


def _tally(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, times = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times


def _rows(size: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(size)), size)


ALIGNED = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", out: str = "aligned") -> DataFrame:
    """Add struct ``out`` (a_ids, b_ids, a_sizes, b_sizes): tokens of both sides, and how many of each make up every group.

    A encodes a space and the text by the byte-level BPE file ``a_path``, B the text by the piece model ``b_path``, which
    puts that space itself. Special tokens' strings are plain text. Where the bytes of either side's tokens differ from the
    space and the text (bytes that are not UTF-8, a space mark in the text), and for null and empty texts, the lists are empty.
    Whole texts, whatever their length; all rows and other columns stay. A column named ``out`` in any letter case is refused.
    No shuffle.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} exists")
    spark = docs.sparkSession
    ready(spark)
    tables = bpe.Tables(a_path)
    tables.special = {}
    with open(b_path, "rb") as f:
        sent = spark.sparkContext.broadcast((tables, f.read()))
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_model, b_model = sent.value[0], Pieces(sent.value[1])
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(at), STEP_BYTES):
                lists = align_slice(data, offsets, a_model, b_model)
                column = pa.StructArray.from_arrays([_list(flat, size) for flat, size in lists], ["a_ids", "b_ids", "a_sizes", "b_sizes"])
                yield pa.RecordBatch.from_arrays([*batch.slice(row, len(offsets) - 1).columns, column], [*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(ALIGNED))]))


def _list(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def align_slice(data: np.ndarray, offsets: np.ndarray, a_model: bpe.Tables, b_model: Pieces) -> list[tuple[np.ndarray, np.ndarray]]:
    """A ids, B ids, A and B tokens of each group, each flat with its number a text, for the texts of one step."""
    n = len(offsets) - 1
    some = np.flatnonzero(np.diff(offsets))
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        raw = data.tobytes()
        some = np.array([k for k in some.tolist() if _is_text(raw[offsets[k] : offsets[k + 1]])], np.int64)
    size = np.diff(offsets)[some]
    data = np.insert(data[ranges(offsets[some], size)], np.cumsum(size) - size, 0x20)
    size = size + 1
    edge = np.concatenate([[0], np.cumsum(size)])
    if not len(some):
        return [(np.zeros(0, np.int64), np.zeros(n, np.int64))] * 4
    sides = []
    for model, (ids, count) in ((a_model, bpe.encode_slice(data, edge, a_model)), (b_model, b_model.encode(data, edge))):
        length = model.token_len[ids]
        made = np.bincount(_rows(count), weights=length, minlength=len(some)).astype(np.int64)
        sides.append((ids, count, length, made, model.token_bytes[ranges(model.token_at[ids], length)]))
    good = np.ones(len(some), bool)
    raw = data.tobytes()
    for _, _, _, made, out in sides:
        good &= made == size
        if not good.all() or not np.array_equal(out, data):
            out, first = out.tobytes(), np.cumsum(made) - made
            for k in np.flatnonzero(good).tolist():
                good[k] = out[first[k] : first[k] + made[k]] == raw[edge[k] : edge[k + 1]]
    picked = []
    for ids, count, length, _, _ in sides:
        keep = np.repeat(good, count)
        picked.append((ids[keep], np.where(good, count, 0), length[keep]))
    (a, a_count, a_len), (b, b_count, b_len) = picked
    a_group, b_group = groups(a_len, b_len)
    n_groups = int(a_group[-1]) + 1 if len(a_group) else 0
    a_first = np.flatnonzero(np.diff(a_group, prepend=-1))
    group_count = np.bincount(_rows(a_count)[a_first], minlength=len(some)) if n_groups else np.zeros(len(some), np.int64)

    def all_rows(count: np.ndarray) -> np.ndarray:
        full = np.zeros(n, np.int64)
        full[some] = count
        return full

    return [
        (a, all_rows(a_count)),
        (b, all_rows(b_count)),
        (np.bincount(a_group, minlength=n_groups), all_rows(group_count)),
        (np.bincount(b_group, minlength=n_groups), all_rows(group_count)),
    ]


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _steps(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Cut batches where column ``at`` has more than STEP_TOKENS A ids; a longer single row is a step of its own."""
    for batch in batches:
        ends = np.cumsum(batch.column(at).field("a_ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        row = 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + STEP_TOKENS, "right")))
            yield batch.slice(row, end - row)
            row = end


class _Batch:
    """The aligned rows of an Arrow batch as flat arrays, with their links."""

    def __init__(self, column: pa.StructArray):
        flat, size = {}, {}
        for name in ("a_ids", "b_ids", "a_sizes", "b_sizes"):
            part = column.field(name)
            size[name] = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat[name] = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = len(column)
        self.a, self.b = flat["a_ids"], flat["b_ids"]
        self.n_a, self.n_b, self.n_groups = size["a_ids"], size["b_ids"], size["a_sizes"]
        self.a_group, self.b_group = _rows(flat["a_sizes"]), _rows(flat["b_sizes"])
        self.group_row = _rows(self.n_groups)
        group, a, b, times = links(self.a, self.b, self.a_group, self.b_group, len(self.group_row))
        # Links of the same row and ids together.
        size = int(max(self.a.max(), self.b.max())) + 1 if len(self.a) else 1
        key = (self.group_row[group] * size + a) * size + b
        if len(times) and times.max() > 1:
            order = np.argsort(key)
            key, times = key[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, self.times = key[first], np.add.reduceat(times, first)
        else:
            key, self.times = np.unique(key, return_counts=True)
        self.row, pair = np.divmod(key, size * size)
        self.key = (pair // size) << 32 | pair % size

    def total(self, weight: np.ndarray) -> np.ndarray:
        """Per row the sum of whole numbers given per pair."""
        ends = np.concatenate([[0], np.cumsum(weight)])
        edge = np.searchsorted(self.row, np.arange(self.rows + 1))
        return ends[edge[1:]] - ends[edge[:-1]]

    def notation(self, names: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each row. names: decimal numbers followed by each sign, four a number."""
        a_size, b_size = np.bincount(self.a_group, minlength=len(self.group_row)), np.bincount(self.b_group, minlength=len(self.group_row))
        b_before, a_before = np.cumsum(b_size) - b_size, np.cumsum(a_size)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        a_last, b_last = np.diff(self.a_group, append=-1) != 0, np.diff(self.b_group, append=-1) != 0
        row_end = np.zeros(len(self.group_row), bool)
        row_end[np.cumsum(self.n_groups)[self.n_groups > 0] - 1] = True
        out[np.arange(len(self.a)) + b_before[self.a_group]] = self.a * 4 + a_last
        out[np.arange(len(self.b)) + a_before[self.b_group]] = self.b * 4 + np.where(b_last, np.where(row_end[self.b_group], 3, 2), 0)
        signs, ends = names[out].tolist(), np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return ["".join(signs[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]


def pair_counts(aligned: DataFrame, column: str = "aligned") -> DataFrame:
    """(pair, n): in how many rows the ids ``pair`` (A id times 2 ** 32 plus B id) are linked. Tasks add up before the shuffle."""
    ready(aligned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _steps(batches, 0):
            one = np.unique(_Batch(batch.column(0)).key, return_counts=True)
            held.append(one)
            size += len(one[0])
            if size > HELD_PAIRS:
                held = [_added(held)]
                if (size := len(held[0][0])) > HELD_PAIRS // 2:
                    yield _pairs(held.pop())
                    size = 0
        if held:
            yield _pairs(_added(held))

    return aligned.select(column).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _pairs(counts: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"pair": pa.array(counts[0]), "n": pa.array(counts[1])})


def _columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size."""
    return [c.to_numpy().astype(np.int64) for c in df.toArrow().columns]


#: Rows of a batch when aligned texts are read back: a row holds lists as long as its text.
READ_ROWS = 256
_BATCHES = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Read and send READ_ROWS rows at once in the jobs run inside; the session's own numbers come back."""
    own = {k: spark.conf.get(k) for k in _BATCHES}
    try:
        for k, n in own.items():
            spark.conf.set(k, min(int(n), READ_ROWS) if int(n) > 0 else READ_ROWS)
        yield
    finally:
        for k, n in own.items():
            spark.conf.set(k, n)


def score_links(aligned: DataFrame, column: str = "aligned", sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """Replace ``column`` by n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best: links whose count over all rows is the highest of their A id, ties included; count_sum: the links' counts added up.
    ``aligned`` is read twice, so it should be a table. Counts of at most ``sent_pairs`` most frequent pairs, and the highest
    count of each A id (as many as the vocabulary has), go to all tasks; occurrences of rarer pairs, each in fewer rows than any
    frequent one, meet their counts by a join.
    """
    spark = aligned.sparkSession
    ready(spark)
    with _small_batches(spark):
        return _scored(spark, aligned, column, sent_pairs)


def _scored(spark: SparkSession, aligned: DataFrame, column: str, sent_pairs: int) -> DataFrame:
    counts = written(pair_counts(aligned, column))
    bound = frequent_bound(counts, "n", sent_pairs)
    best = counts.groupBy(F.shiftright("pair", 32).cast("int").alias("a")).agg(F.max("n").alias("n"))
    ids, most = _columns(best)
    pairs, number = _columns(counts.where(F.col("n") >= bound))
    order = np.argsort(pairs)
    top = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    top[ids] = most
    sent = spark.sparkContext.broadcast((pairs[order], number[order], top))
    others = [f for f in aligned.schema.fields if f.name != column]
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    rare = T._parse_datatype_string("rare array<struct<pair: bigint, times: bigint>>").fields
    schema = T.StructType([*others, *(T.StructField(n, T.LongType()) for n in made), T.StructField("groups_sha256", T.StringType()), *rare])
    at = aligned.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, number, top = sent.value
        names = np.zeros(0, object)
        for batch in _steps(batches, at):
            one = _Batch(batch.column(at))
            if len(one.a) and (largest := int(max(one.a.max(), one.b.max()))) * 4 >= len(names):
                names = np.array([f"{i}{sign}" for i in range(1 << largest.bit_length()) for sign in (",", "|", ";", "")], object)
            place = np.minimum(np.searchsorted(pairs, one.key), max(len(pairs) - 1, 0))
            known = pairs[place] == one.key if len(pairs) else np.zeros(len(one.key), bool)
            n = number[place] if len(pairs) else np.zeros(len(one.key), np.int64)
            n[~known] = 0
            sums = [one.n_a, one.n_b, one.n_groups, one.total(one.times), one.total(one.times * (known & (n == top[one.key >> 32]))), one.total(one.times * n)]
            digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in one.notation(names)]
            cold = np.flatnonzero(~known)
            ends = np.searchsorted(one.row[cold], np.arange(one.rows + 1)).astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(one.key[cold]), pa.array(one.times[cold])], ["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), *map(pa.array, sums), pa.array(digests, pa.string()), left], schema.names)

    found = aligned.mapInArrow(run, schema)
    if bound <= 1:  # every pair was sent
        return written(found.drop("rare"))
    found = written(found.withColumn("_row", F.monotonically_increasing_id()))
    rare = found.select("_row", F.explode("rare").alias("r")).select("_row", "r.*").join(counts.where(F.col("n") < bound), "pair")
    usual = rare.join(best.select("a", F.col("n").alias("top")), F.shiftright("pair", 32).cast("int") == F.col("a"))
    more = usual.groupBy("_row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    both = found.join(more, "_row", "left")
    return both.select(
        *[f.name for f in others],
        *made[:4],
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text)."""
    aligned = written(align(docs.select("doc_id", "text"), a_path, b_path).drop("text"))
    return score_links(aligned)


__all__ = ["Pieces", "align", "align_slice", "groups", "links", "pair_counts", "report", "score_links"]
