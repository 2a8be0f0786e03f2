import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wareflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'s", "'re", "'", "ll", " ", "  ", "\n", "\t", "a", "é", "9", "!!", "<|endoftext|>", "<|endof", "ve", "　", "漢字", "😀", "\x00", "\xa0", "\x85", "²", "aaaa", "The cat"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tables():
    return bpe.Tables(PATH)


def texts():
    rng = random.Random(1)
    out = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(800)]
    out += ["x " + "".join(chr(c) for c in range(b, b + 40) if not 0xD800 <= c < 0xE000) for b in range(0, 0x3000, 40)]
    return out + ["", "a" * 3000, "ab" * 1000, "don't  stop", " 'tis", "''s"]


def test_slices_equal_the_library(library, tables):
    rows = texts()
    raw = [t.encode() for t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, counts = bpe.encode_slice(np.frombuffer(b"".join(raw), np.uint8), offsets, tables)
    ends = np.cumsum(counts)
    want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == want
    assert bpe.decode_slice(ids, counts, tables) == [library.decode(w, skip_special_tokens=False) for w in want]


def test_bytes_that_are_not_utf8(tables):
    raw = b"ok \xff\xfe end"
    ids, counts = bpe.encode_slice(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), tables)
    assert bpe.decode_slice(ids, counts, tables) == [raw.decode("utf-8", "replace")]
    assert bpe.decode_slice(np.array([tables.byte_id[0xC3]]), np.array([1]), tables) == ["�"]


def test_frame(spark, library):
    rows = [(1, "Hello world's", "k"), (1, "Hello world's", "k"), (2, None, None), (None, "", "x"), (3, "long " * 20000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT_hash string")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(out) == 5 and all(r.decoded == (r.text or "") for r in out)
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in out)
    got = {r.doc_id: r for r in bpe.round_trip_digests(df, PATH).collect()}
    ids = library.encode(rows[4][1], add_special_tokens=False).ids
    assert got[3].n_tokens == len(ids) and got[3].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[2].n_tokens == 0 and got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(df.where(F.lit(False)), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("ids", F.lit(1)), PATH)
