"""Cross-tokenizer alignment, suffix-tree scoring and importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wareflow.llm import alignment, bpe, queries, resample, suffixtree

DIR = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(-1, "a▁b"), (-2, ""), (-3, None), (-4, "aaaa" * 3000), (-5, " " * 500 + "\n\n  x<|endoftext|></s>"), (-6, "漢字😀é́ \x00 \xa0 \x85"), (-6, "漢字😀é́ \x00 \xa0 \x85"), (None, "null id")]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    return own.unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))


def same(got, want):
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def aligned_by_hand(rows):
    to_byte = bpe.byte_symbols()
    a_model = Tokenizer.from_file(A)
    a_model.encode_special_tokens = True
    a_bytes = {i: bytes(to_byte[c] for c in t) for t, i in a_model.get_vocab().items() if t != "<|endoftext|>"}
    b_model = sentencepiece.SentencePieceProcessor(model_file=B)

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    texts = []
    for _, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(map(a_bytes.get, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            texts.append(([], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(a_bytes[i]) for i in a]), np.cumsum([len(b_bytes(i)) for i in b])
        cuts, groups, i, j = sorted(set(a_ends) & set(b_ends)), [], 0, 0
        for cut in cuts:
            k, m = np.searchsorted(a_ends, cut) + 1, np.searchsorted(b_ends, cut) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        texts.append((a, b, groups))
    count = Counter()
    for _, _, groups in texts:
        count.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), (a, b, groups) in zip(rows, texts, strict=True):
        found = [(x, y) for ga, gb in groups for x in ga for y in gb]
        sign = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc, len(a), len(b), len(groups), len(found), sum(count[p] == best[p[0]] for p in found), sum(count[p] for p in found), hashlib.sha256(sign.encode()).hexdigest() if sign else ""))
    return out


@pytest.mark.parametrize("sent", [alignment.SENT_PAIRS, 500, 0])
def test_alignment_equals_by_hand(docs, sent):
    want = aligned_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    table = alignment.written(alignment.align(docs, A, B).drop("text"))
    same(alignment.score_links(table, sent_pairs=sent).collect(), want)


def test_alignment_keeps_texts_that_end_in_one_space(spark):
    rows = [(1, "word "), (2, " "), (3, "two  "), (4, "line\n "), (5, "漢 "), (6, "the word the ")]
    got = alignment.report(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert all(r.n_a and r.n_b for r in got)
    same(got, aligned_by_hand(rows))


def test_alignment_groups_cover_the_text(spark):
    df = spark.createDataFrame([(1, "Hello wörld", "k"), (2, None, "k")], "doc_id long, text string, A_IDS string")
    one, none = alignment.align(df, A, B).orderBy("doc_id").collect()
    assert sum(one.aligned.a_sizes) == len(one.aligned.a_ids) and sum(one.aligned.b_sizes) == len(one.aligned.b_ids)
    assert none.aligned.a_ids == none.aligned.b_sizes == [] and one.A_IDS == "k"
    assert alignment.report(df.where("false"), A, B).count() == 0
    with pytest.raises(ValueError):
        alignment.align(df.withColumn("Aligned", F.lit(1)), A, B)


def test_wide_groups_tally_equal_ids():
    a, b = np.array([7] * 300 + [8]), np.array([5] * 200 + [6])
    zero = lambda x: np.zeros(len(x), np.int64)
    _, x, y, times = alignment.links(a, b, zero(a), zero(b), 1)
    assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), times.tolist(), strict=True)) == {(7, 5): 60000, (7, 6): 300, (8, 5): 200, (8, 6): 1}


class Tree:
    """The suffix tree in dictionaries; contexts are tuples of words, None before the first word."""

    def __init__(self, texts, depth, least, discount, cost):
        self.depth, self.d, self.least = depth, discount, least
        self.count = [defaultdict(Counter) for _ in range(depth + 1)]
        for text in texts:
            for context, word in self.places(text):
                for k in range(depth + 1):
                    self.count[k][context[depth - k :]][word] += 1
        root = self.count[0][()]
        self.n, self.v, self.root, self.states = sum(root.values()), len(root), root, {}
        for k in range(1, depth + 1):
            new = {}
            for context, after in self.count[k].items():
                size, counted = sum(after.values()), {w: c for w, c in after.items() if c >= least}
                if size < least or k > 1 and context[1] is None:  # two places before a text are one context
                    continue
                rest, other, gain = size - sum(c - discount for c in counted.values()), size - sum(counted.values()), 0.0
                for word, c in counted.items():
                    q = self.p(context[1:], word)
                    left = c - 1 - discount + rest * q if c > least else (rest + least - 1 - discount) * q
                    gain += c * math.log(left / (size - 1) / q)
                gain += other * math.log((rest - 1) / (size - 1)) if other else 0.0
                if counted and gain >= cost:
                    new[context] = (size, rest)
            self.states |= new

    def words(self, text):
        return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))

    def places(self, text):
        seq = [None] * self.depth + [*self.words(text), "\n"]
        for i in range(self.depth, len(seq)):
            yield tuple(seq[i - self.depth : i]), seq[i]

    def p(self, context, word):
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return (self.root[word] + 1) / (self.n + self.v + 1)
        (size, rest), c = self.states[context], self.count[len(context)][context][word]
        return ((c - self.d if c >= self.least else 0) + rest * self.p(context[1:], word)) / size


@pytest.mark.parametrize(("depth", "least", "sent"), [(2, 3, 1 << 20), (3, 2, 200), (1, 2, 0)])
def test_suffix_tree_equals_dictionaries(spark, docs, depth, least, sent):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + k, "The cat sat on the mat again\nand the CAT sat on the mat") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where(~suffixtree.held_out(F.col("doc_id")))
    tree = Tree([r.text for r in train.collect()], depth, least, suffixtree.DISCOUNT, 1.0)
    model = suffixtree.fit(train, depth, least, min_gain=1.0)
    assert (model.train_tokens, model.train_types) == (tree.n, tree.v) and sum(len(x.states) for x in model.levels) == len(tree.states) > 3
    by_id = defaultdict(list)
    for r in suffixtree.score(df, model, sent_words=sent).collect():
        by_id[r.doc_id].append(r.lm)
    for doc, text in rows:
        words = [*tree.words(text), "\n"]
        want = sum(math.log10(tree.p(c, w)) for c, w in tree.places(text))
        base = sum(math.log10((tree.root[w] + 1) / (tree.n + tree.v + 1)) for w in words)
        lm = by_id[doc][0]
        assert (lm.n_tokens, lm.n_known) == (len(words), sum(tree.root[w] > 0 for w in words))
        assert math.isclose(lm.base_score, base, rel_tol=1e-9) and math.isclose(lm.score, want, rel_tol=1e-9)


def test_state_distributions_add_up(spark):
    texts = ["a b a b a c b a b d"] * 5
    tree = Tree(texts, 2, 2, 0.75, 1.0)
    assert tree.states
    for context in [(), *tree.states]:
        assert math.isclose(sum(tree.p(context, w) for w in tree.root) + tree.p(context, "unseen"), 1.0)
    model = suffixtree.fit(spark.createDataFrame([(t,) for t in texts], "text string"), 2, 2, min_gain=1.0)
    assert sum(len(x.states) for x in model.levels) == len(tree.states)


def test_least_probability_bounds_a_level(spark, docs):
    model = suffixtree.fit(docs, 2, 2, max_grams=50, min_gain=0.0)
    assert all(len(x.states) <= 50 and len(x.grams) <= 50 for x in model.levels)


def test_keys_equal_sparks_hash(spark):
    a, b = np.array([0, -5, 2**62, 77]), np.array([1, 2**63 - 1, -(2**63), 0])
    got = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()
    assert suffixtree.joined(a, b).tolist() == [r.h for r in got]


def test_scoring_of_nothing(spark):
    df = spark.createDataFrame([(2, None), (3, "")], "doc_id long, text string")
    rows = suffixtree.report(df).collect()
    assert all(r.n_tokens == 1 for r in rows) and suffixtree.report(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        suffixtree.score(df.withColumn("LM", F.lit(1)), suffixtree.fit(df))


def test_held_out_scores_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in suffixtree.report(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def drawn_by_hand(rows, target, low, high):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(resample.LOWER))
    grams = lambda w: [zlib.crc32(b" ".join(w[i : i + n])) % 500 for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(g for _, x in rows for g in grams(words(x))), Counter(g for x in target for g in grams(words(x)))
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + 500) / ((s[k] + 1) * (t.total() + 500)))) for k in range(500)]
    out = []
    for doc, text in rows:
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        w = words(text)
        weight = sum(gain[g] for g in grams(w))
        out.append([doc, len(grams(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= 20])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: len(order) * 10 // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 3), (2, 2)])
def test_resampling_equals_by_hand(spark, docs, low, high):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = spark.read.parquet(f"{DIR}/benchmark.parquet")
    got = resample.resample(docs.withColumn("N_Words", F.lit("x")), target, low=low, high=high, buckets=500)
    assert got.columns == ["doc_id", "text", "N_Words", "n_features", "weight", "score", "rank"]
    same(got.drop("text", "N_Words").collect(), drawn_by_hand(rows, [r.text for r in target.collect()], low, high))


def test_resampling_of_nothing(spark, docs):
    target = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert resample.report(docs.where("false"), target).count() == 0
    rows = resample.report(docs, target.where("false")).collect()
    assert sum(r.rank is not None for r in rows) == sum(r.n_features >= 20 for r in rows) // 10 > 0
    with pytest.raises(ValueError):
        resample.resample(docs.withColumn("RANK", F.lit(1)), target)


def test_resampling_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.op13_importance_resampling(spark, DIR)
    want = con.sql(queries.oracle_sql()["op13_importance_resampling"])
    assert want.columns == df.columns
    same(df.collect(), want.fetchall())


def test_key_search_is_binary_search():
    rng = np.random.default_rng(3)
    far = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    for keys in (np.unique(far), np.arange(3000), np.array([-(1 << 63), -1, 0, (1 << 63) - 1]), np.array([5]), far[:0]):
        asked = np.concatenate([keys, keys - 1, far, np.arange(-5, 3005), np.array([-(1 << 63), (1 << 63) - 1])])
        place, there = suffixtree.Keys(keys).found(asked)
        want = np.isin(asked, keys)
        assert (there == want).all() and (keys[place[there]] == asked[there]).all()
