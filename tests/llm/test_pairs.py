"""Near-duplicates, suffixes, decontamination and components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wareflow.llm import common, decontam, embeddings, simhash, suffixes


def closure(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == closure({x for e in real for x in e}, real)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode()
    words = [w for w in words.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams):
            out |= 1 << bit
    return out


def test_fingerprints_and_groups(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 60, 200]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(120):
        t = base[k % 40].split(" ")
        if len(t) > 3:
            t[rng.randrange(len(t))] = "Zz"
        rows.append((100 + k, " ".join(t)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, base[5]), (903, base[5].upper()), (7, base[7]), (904, "É é x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("FP", F.lit("x"))
    got = simhash.near_duplicates(df).collect()
    fps = [brute_fingerprint(t or "") for _, t in rows]
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == Counter((i, f) for (i, _), f in zip(rows, fps, strict=True))
    near = [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 2]
    label = closure(set(fps), near)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    assert all(r.component_id == least[label[r.fp & (2**64 - 1)]] for r in got)


def test_links_of_crowded_fingerprints(spark):
    rng = random.Random(4)
    center = rng.getrandbits(64)
    values = {center} | {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), pair_limit=4).collect()
    mask = 2**64 - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 2 for r in edges)
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2]
    assert closure(signed, [(r.a, r.b) for r in edges]) == closure(signed, near)


def test_keep_first(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(3, t, "a"), (1, t, "b"), (1, t, "c"), (2, "other words entirely here now", "d"), (5, None, "e"), (6, "", "f"), (None, t, "g"), (2, "quite another text under the same id", "h"), (2, "quite another text under the same id", "h")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert got.columns == ["doc_id", "text", "component_id"]
    kept = Counter(r.doc_id for r in got.collect())
    assert kept == Counter([1, 2, 2, 5, 6, None])


def test_keep_first_of_edited_copies(spark, monkeypatch):
    rng = random.Random(11)
    words, tail = [f"w{i}" for i in range(2000)], "this common line is in every one of the texts here".split()
    base = [rng.choices(words, k=rng.choice([3, 12, 60, 300])) for _ in range(30)]
    rows = [(i, " ".join(t + tail)) for i, t in enumerate(base)]
    for k in range(150):
        t = list(base[k % 30])
        for _ in range(rng.choice([1, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((100 + k, " ".join(t + tail[: rng.choice([0, 11])])))

    def shingles(t):
        w = t.split(" ")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    bits = {i: simhash.fingerprint_of(t.encode(), 5) for i, t in rows}
    close = [(a, b) for a in sets for b in sets if a < b and (bits[a] ^ bits[b]).bit_count() <= 2]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    label = closure(sets, near + close)
    assert len(set(label.values())) < len(set(closure(sets, close).values()))
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == sorted(set(label.values()))
    checks = {r.check: r.doc_id for r in df.select("doc_id", F.xxhash64("text").alias("check")).collect()}
    found = simhash.similar_texts(df.select("doc_id", F.xxhash64("text").alias("check"), "text")).collect()
    want = {tuple(sorted((rows_of, other))) for rows_of, other in near if rows_of in checks.values() and other in checks.values()}
    assert {tuple(sorted((checks[r.a], checks[r.b]))) for r in found} == want and len(want) > 20
    # Crowds are connected by fewer pairs, all of them true ones.
    some = simhash.similar_texts(df.select("doc_id", F.xxhash64("text").alias("check"), "text"), crowd_limit=2).collect()
    some = {tuple(sorted((checks[r.a], checks[r.b]))) for r in some}
    assert some < want and closure(sets, some) == closure(sets, want)
    # The same pairs, compared in parts.
    monkeypatch.setattr(simhash, "PART_PAIRS", 20)
    found = simhash.similar_texts(df.select("doc_id", F.xxhash64("text").alias("check"), "text")).collect()
    assert {tuple(sorted((checks[r.a], checks[r.b]))) for r in found} == want


def brute_removed(texts, length, first):
    seen, out = Counter(), []
    every = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if (seen[w] > 0) if first else every[w] > 1:
                gone[i : i + length] = b"\1" * length
            seen[w] += 1
        out.append(gone)
    return out


@pytest.mark.parametrize("length", [16, 50, 400])
@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("limit", [2, 500])
def test_repeats(spark, length, keep, limit):
    rng = random.Random(length)
    base = ["".join(rng.choices("abcé ", k=700)) for _ in range(5)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 300) : rng.randint(300, 700)] for _ in range(rng.randint(0, 3))) + "".join(rng.choices("xyz", k=5)) for _ in range(25)]
    texts += ["a" * 900, "", texts[3], "ab" * 300]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit(1))
    got = {r.doc_id: r for r in suffixes.remove_repeats(df, min_len=length, keep=keep, group_limit=limit).collect()}
    want = brute_removed([t.encode() for t in texts] + [b""], length, keep == "first")
    for (i, t), gone in zip(rows, want, strict=True):
        raw = (t or "").encode()
        assert bytes(got[i].kept) == bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert got[i].n_bytes == len(raw) and sum(s.end - s.first for s in got[i].removed) == sum(gone)


def test_repeated_rows_and_null_ids(spark):
    t = "".join(random.Random(9).choices("abcdef", k=600))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "short")], "doc_id long, text string")
    got = suffixes.remove_repeats(df, keep="none").collect()
    assert sorted(len(r.kept) for r in got) == [0, 0, 0, 5]
    assert suffixes.remove_repeats(df.where(F.lit(False))).count() == 0
    rep = {r.doc_id: r for r in suffixes.report(df).collect()}
    assert rep[2].kept_sha256 == hashlib.sha256(b"short").hexdigest() and rep[1].n_spans == 1


@pytest.mark.parametrize("limit", [2, 500])
def test_first_of_repeated_rows_stays(spark, limit):
    rng = random.Random(12)
    t, u = ("".join(rng.choices("abcdef", k=600)) for _ in range(2))
    texts = [(1, t), (1, t), (2, u), (2, u), (2, u), (3, u[:300] + "xyz" + t[100:500]), (4, "short"), (4, "short"), (5, t[:200] + "q" + u[50:400])]
    df = spark.createDataFrame([*texts, (None, "n" + t), (None, "n" + t)], "doc_id long, text string")
    order = [(None, "n" + t), (None, "n" + t), *texts]
    want = Counter()
    for (i, x), gone in zip(order, brute_removed([x.encode() for _, x in order], 50, True), strict=True):
        want[(i, bytes(b for b, g in zip(x.encode(), gone, strict=True) if not g))] += 1
    got = Counter((r.doc_id, bytes(r.kept)) for r in suffixes.remove_repeats(df, min_len=50, keep="first", group_limit=limit).collect())
    assert got == want


@pytest.mark.parametrize("hot_keys", [0, 100])
def test_rows_of_frequent_keys(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(suffixes, "HOT_ROWS", 3)
    monkeypatch.setattr(suffixes, "HOT_KEYS", hot_keys)
    for keep in ("first", "none"):
        test_repeats(spark, 50, keep, 2)
    test_shared_passages(spark, 12)


@pytest.mark.parametrize("words", [12, 51])
def test_shared_passages(spark, words):
    rng = random.Random(words)
    pool = [f"w{k}é" for k in range(200)]
    passages = [rng.choices(pool, k=n) for n in (words - 1, words, words + 1, 2 * words, 5 * words)]
    texts = []
    for k in range(40):
        t = rng.choices(pool, k=rng.choice([0, 3, 60]))
        for _ in range(rng.randint(0, 2)):
            p, at = rng.choice(passages), rng.randint(0, len(t))
            t[at:at] = p[: rng.choice([len(p), max(1, len(p) - 2)])]
        texts.append(t)
    texts += [texts[0], passages[3] * 2, ["same"] * 300, []]
    docs = [(k, rng.choice([" ", "\n ", "\t"]).join(t)) for k, t in enumerate(texts)] + [(100, None), (None, " ".join(passages[4])), (101, "own " * 200), (101, "own " * 200)]
    rows = [t for t in texts] + [[], passages[4], ["own"] * 200]
    where = {}
    for k, t in enumerate(rows):
        for j in range(len(t) - words + 1):
            where.setdefault(tuple(t[j : j + words]), set()).add(k)
    want = Counter()
    for k, t in enumerate(rows):
        hit = {j + x for j in range(len(t) - words + 1) if len(where[tuple(t[j : j + words])]) > 1 for x in range(words)}
        if hit:
            want[(docs[k][0], len(hit))] += 1
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("check", F.xxhash64("text"))
    assert Counter((r.doc_id, r.n_shared_words) for r in suffixes.shared_passages(df, words).collect()) == want
    assert suffixes.shared_passages(df.where(F.lit(False)), words).count() == 0


def test_longest_previous_factors():
    raw = b"abracadabra abracadabra"
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    lpf, _, _ = suffixes.longest_previous_factors(data, off, np.arange(len(raw)), 64)
    want = [max([0, *[next(k for k in range(len(raw)) if i + k == len(raw) or raw[i + k] != raw[j + k]) for j in range(i)]]) for i in range(len(raw))]
    assert lpf.tolist() == [x // 8 * 8 for x in want]


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    center = rng.normal(size=(6, 24))
    x = np.concatenate([center[rng.integers(0, 6, 150)] + rng.normal(size=(150, 24)) * rng.uniform(0.05, 0.5, (150, 1)), rng.normal(size=(60, 24))])
    x[10] = x[11]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 24, 1), (303, [float("nan")] * 24, 1), (304, [None] * 24, 1), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (None, x[0].tolist(), 1), (307, (x[3] * 1e200).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, tile_rows=40).collect()}
    assert len(got) == len(rows)
    y = np.concatenate([x, x[3:4] * 1e200])
    ids = [*range(len(x)), 307]
    u = y / np.linalg.norm(y / np.abs(y).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(y).max(axis=1, keepdims=True)
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if u[i] @ u[j] >= 0.9] + [(305, 306)]
    label = closure([*ids, 305, 306], near)
    n = Counter(k for e in near for k in e)
    for i in [*ids, 305, 306]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], label[i], label[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (300, 301, 302, 303, 304))
    assert embeddings.near_duplicates(df.where(F.lit(False))).count() == 0


def test_embedding_links_of_repeated_ids(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [1.0, 0.01, 0.0]), (7, [0.0, 1.0, 0.01]), (4, [0.0, 0.0, 1.0]), (8, [0.0, 1.0, 0.0]), (9, [0.0, 0.0, 1.0]), (3, [0.0, 0.01, 1.0])]
    got = Counter(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == Counter([(5, 1, 5, True), (6, 1, 5, False), (5, 2, 5, True), (7, 2, 5, False), (8, 2, 5, False), (4, 2, 3, False), (9, 2, 3, False), (3, 2, 3, True)])


def test_contamination(spark):
    rng = random.Random(6)
    words = [f"Wört{i}" if i % 5 else f"word{i}" for i in range(300)]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.choice([0, 3, 13, 40])))) for k in range(20)] + [("i1", "dup, TWO"), (None, "lone item!"), ("n", None)]
    docs = []
    for k in range(60):
        t = rng.choices(words, k=rng.choice([0, 5, 100]))
        if k % 3 == 0:
            part = items[k % 20][1].split(" ")
            at = rng.randint(0, len(t))
            t[at:at] = part[rng.randint(0, 3) :]
        docs.append((k, "; ".join(t) if k % 2 else " ".join(t).upper().replace("WÖRT", "wört")))
    docs += [(100, None), (101, ""), (102, "x " * 30000 + "dup two"), (103, "dupe two"), (103, "dup\ntwo")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")

    def words_of(t):
        out, cur = [], ""
        for ch in (t or "") + " ":
            ch = ch.lower() if "A" <= ch <= "Z" else ch
            if ch.isdigit() and ord(ch) < 128 or "a" <= ch <= "z" or ord(ch) > 127:
                cur += ch
            else:
                out += [cur] if cur else []
                cur = ""
        return out

    wins = [(i or "", w[k : k + 13]) for i, t in items for w in [words_of(t)] if w for k in range(max(1, len(w) - 12))]
    want = Counter()
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
        want[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert Counter(tuple(r) for r in decontam.report(df, bench).collect()) == want
    parts = decontam.scan(df, bench, max_pattern_bytes=400).select("doc_id", decontam.n_hit().alias("n")).collect()
    assert Counter((r.doc_id, r.n) for r in parts) == Counter((k[0], k[2]) for k in want.elements())
    clean = decontam.drop_contaminated(df.withColumn("hit", F.lit(1)), bench)
    assert clean.columns == ["doc_id", "text", "hit"] and clean.count() == sum(n for k, n in want.items() if not k[5])
    spans = decontam.scan(df.where("doc_id = 103"), bench).where("text LIKE '%\n%'").first().hit.byte_spans
    assert [(s.first, s.end) for s in spans] == [(0, 7)]
    assert decontam.report(df, bench.where(F.lit(False))).where("n_hit > 0").count() == 0


def test_parity_bitmap_never_differs_in_more_bits_than_sets_in_members():
    rng = np.random.default_rng(5)
    for n in (1, 30, 400, 9000):
        a = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        b = np.unique(np.concatenate([a[: n - n // 9], rng.integers(-(1 << 63), 1 << 63, n // 9)]))
        differ = int(np.bitwise_count((simhash.parity_bitmap(a) ^ simhash.parity_bitmap(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))
    assert not simhash.parity_bitmap(np.zeros(0, np.int64)).any()


def test_fine_bitmaps_fold_and_never_differ_in_more_bits_than_sets_in_members():
    rng = np.random.default_rng(6)
    for n in (0, 1, 127, 129, 2100):
        a = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        b = np.unique(np.concatenate([a, rng.integers(-(1 << 63), 1 << 63, n // 5)]))
        x, y = simhash.fine_bitmap(a), simhash.fine_bitmap(b)
        assert len(x) in (len(y), len(y) // 2) and 64 * len(x) >= simhash.FINE_BITS * n
        if len(x) < len(y):
            y = y[: len(x)] ^ y[len(x) :]
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))
        assert (np.bitwise_xor.reduce(x.reshape(-1, simhash.BITMAP_LONGS)) == simhash.parity_bitmap(a)).all()


def test_shingles_of_long_texts_are_read_only_where_they_may_be_similar(spark, monkeypatch):
    rng = random.Random(21)
    texts = []
    for _ in range(6):  # four texts each that share three quarters of their shingles, more than a short bitmap has bits
        common = [f"c{rng.getrandbits(40)}" for _ in range(850)]
        texts += [" ".join(common + [f"o{rng.getrandbits(40)}" for _ in range(250)]) for _ in range(4)]
    words = texts[0].split(" ")
    texts.append(" ".join(words[:-100]))  # nine tenths, with half the bits
    texts.append(" ".join(words[5:]))
    read, written = [], simhash.written

    def counted(df, *args, **kw):
        out = written(df, *args, **kw)
        if "h" in out.columns:
            read.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("check"), "text")
    of = {r.check: r.doc_id for r in df.collect()}
    found = {tuple(sorted((of[r.a], of[r.b]))) for r in simhash.similar_texts(df).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split(" ") for t in texts)]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert found == want == {(0, 24), (0, 25), (24, 25)}
    assert sum(read) == 3
