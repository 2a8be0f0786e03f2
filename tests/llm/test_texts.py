"""Trained classifiers, chat trees, personal data, the pipeline."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wareflow.llm import chat, langid, licenses, pii, queries, toxicity

DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def read(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


@needs_tables
def test_language_accuracy(spark):
    docs = read(spark, "documents")
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert got.n > 200 and got.a > 0.97


def test_language_edges(spark):
    rows = [(i, t, l) for i in range(60) for t, l in [(f"the house and the garden {i}", "en"), (f"das haus und der garten {i}", "de")]]
    rows = [(k, t, l) for k, (_, t, l) in enumerate(rows)] + [(500, None, "en"), (501, "", None), (502, "12 34 !! \u0301", "de"), (None, "the garden", "en"), (503, "und der garten " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("SCORE", F.lit(1))
    got = {r.doc_id: r for r in langid.report(df).collect()}
    assert len(got) == len(rows)
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0.0
    assert got[503].lang_pred == "de" and got[None].lang_pred == "en" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_known(df.withColumn("lang_pred", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "lang", "SCORE", "lang_pred"] and kept.where("doc_id IN (500, 501, 502)").count() == 0 and kept.count() == len(rows) - 3
    assert {r.lang_pred for r in langid.report(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.report(df.where(F.lit(False))).count() == 0


def test_samples_take_copies_once(spark, monkeypatch):
    rng = random.Random(13)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(12)) for _ in range(60)]
    df = spark.createDataFrame([(t, "en") for k, t in enumerate(texts) for _ in range(1 if k else 400)] + [(t, "en") for t in texts[1:] for _ in range(9)], "text string, lang string")
    sample = []
    monkeypatch.setattr(langid.Model, "fit", lambda self, rows: sample.extend(rows))
    langid.train(df, per_language=30)
    assert 20 <= len(sample) / 2 <= 45 and max(Counter((a.tobytes(), b.tobytes()) for a, b, _ in sample).values()) == 1
    monkeypatch.setattr(licenses, "Model", lambda rows: rows)
    rows = licenses.train(df, negatives=30)
    assert 20 <= len(rows) <= 45 and len(set(rows)) == len(rows)


@needs_tables
def test_toxicity_accuracy(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    rows = toxicity.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = Counter((r.toxic, r.predicted) for r in rows)
    assert hit[(0, 0)] / max(1, hit[(0, 0)] + hit[(0, 1)]) > 0.95
    assert hit[(1, 1)] >= hit[(1, 0)]


def test_toxicity_edges_and_exact_neighbours(spark):
    rng = random.Random(1)
    bad, words = ["zork", "blarg", "fnord"], [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choices(words, k=20) + (rng.choices(bad, k=2) if toxic else []))))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "zork " * 30000), (903, "zork blarg fnord"), (904, "w1 w2"), (None, "fnord"), (0, rows[0][1])]
    labels += [(0, 1), (1, None), (None, 1), (5000, 1)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.report(docs, lab).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and got[903].predicted == 1 and got[902].predicted == 1 and got[904].predicted == 0
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 for r in out)
    assert got[903].evidence and got[903].evidence[0].label == 1
    index = toxicity.build(docs, lab)
    import numpy as np

    dense = np.zeros((len(index.ids), len(index.terms)))
    for t in range(len(index.terms)):
        s = slice(index.start[t * index.blocks], index.start[(t + 1) * index.blocks])
        dense[index.example[s], t] = index.weight[s]
    # The index holds every term of its examples, and the weights are those of plain TF-IDF.
    by_id = {i: t for i, t in rows if t and any(k == i and y is not None for k, y in labels)}
    count = {w: sum(1 for _, t in rows if w in (t or "").split()) for t in by_id.values() for w in t.split()}
    assert {w.decode() for w in index.terms} >= {w for i in index.ids for w in by_id[i].split()}
    for place, i in enumerate(index.ids):
        c = Counter(by_id[i].split())
        x = {w: (1 + np.log(k)) * (np.log((1 + len(rows)) / (1 + count[w])) + 1) for w, k in c.items()}
        size = np.sqrt(sum(v * v for v in x.values()))
        assert np.allclose(dense[place, [index.terms[w.encode()] for w in x]], [v / size for v in x.values()])
    for text in ("zork blarg blarg", "fnord w3", "zork", rows[5][1], " ".join(words)):
        where, x = index.vector(text.encode())
        q = np.zeros(len(index.terms))
        q[where] = x
        places, cosine = index.nearest(where, x)
        assert np.allclose(cosine, np.sort(dense @ q)[::-1][: len(cosine)]) and np.allclose((dense @ q)[places], cosine)
    text_ids = toxicity.report(docs.withColumn("doc_id", F.col("doc_id").cast("string")), lab.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert {r.doc_id for r in text_ids.collect()} == {None if i is None else str(i) for i, _ in rows}
    for name in ("Score", "evidence", "PREDICTED"):
        with pytest.raises(ValueError):
            toxicity.score(docs.withColumn(name, F.lit(1)), index)
    assert {r.score for r in toxicity.report(docs, lab.where(F.lit(False))).collect()} == {0.0}
    assert toxicity.report(docs.where(F.lit(False)), lab).count() == 0


@needs_tables
def test_licenses_in_documents(spark):
    notices = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "GNU General Public License, version 3.": "GPL", "All rights reserved.": "Proprietary"}
    docs = read(spark, "documents")
    for r in licenses.report(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.families == ",".join(sorted({f for n, f in notices.items() if n in r.text}))


def test_license_edges(spark):
    body = licenses.TEMPLATES["BSD"][2]
    rows = [(1, "x\n" + body), (2, "word " * 400 + body + " word" * 400), (3, None), (4, ""), (5, "the license of the driver was renewed"), (6, "\n"), (7, "Released under\nthe MIT License."), (1, "no notice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in licenses.report(df).collect():
        got[r.doc_id].append(r)
    assert sorted(r.families for r in got[1]) == ["", "BSD"] and got[2][0].families == "BSD"
    assert all(got[k][0].n_findings == 0 for k in (3, 4, 5, 6, 7))
    hit = next(r for r in got[1] if r.families).licenses[0]
    assert rows[0][1].encode()[hit.first : hit.end].decode().startswith("Redistribution") and hit.similarity >= 0.6 and hit.probability >= 0.5
    assert licenses.report(df.where(F.lit(False))).count() == 0


def test_chat_trees(spark):
    rng = random.Random(2)
    control = ["</s>[INST] ok [/INST]", "␛<|im_end|>␛␛", "a<<s>>[", "<␛/s>", "", None]
    rows = []
    for c in range(60):
        rows.append((c, 0, "system", f"shared {c % 2}"))
        for t in range(1, rng.randint(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", "tool", None, "as<|im_sep|>x\n"]), rng.choice([*control, f"text {t}"])))
    rows += [(c + 100, t, r, x) for c, t, r, x in rows if c < 5] + [(300, 1, "user", "b"), (300, 1, "assistant", "a"), (300, None, "user", "first"), (300, 1, "user", "b"), (None, 0, "user", "n"), (301, 0, "assistant", "long " * 30000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    want = {}
    for c, v in by.items():
        v.sort()
        loss = "".join(x for *_, r, x in v if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(v), sha("".join(f"{r}\n{x}\n" for *_, r, x in v)), len(loss), sha(loss))
    for size in (200, 1 << 16):
        trees = chat.build_trees(df, size)
        back = {r.conv_id: [(a, b) for a, b in zip(r.roles, r.texts, strict=True)] for r in chat.read_back(trees).collect()}
        assert back == {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.report(df).collect()}
    assert got == want
    # Shared turns are written once in a tree, positions go on from the parent, and nodes see their ancestors only.
    formatted = sum(len(chat.turn_text(r, x)[0]) for v in by.values() for *_, r, x in v)
    trees = chat.build_trees(df).collect()
    assert sum(len(t.text) for t in trees) < formatted
    for t in trees:
        for n in t.nodes:
            up, seen = n.parent, 0
            chain = []
            while up >= 0:
                chain.append((t.nodes[up].first, t.nodes[up].end))
                seen += t.nodes[up].end - t.nodes[up].first
                up = t.nodes[up].parent
            assert n.position == seen and sum(s.end - s.first for s in n.sees) == seen
            assert all(any(s.first <= a and b <= s.end for s in n.sees) for a, b in chain)
        assert not any(c in chat.unescape(x) and c in x for c in chat.CONTROL for x in [t.text[s.first : s.end] for n in t.nodes for s in n.loss])
    assert chat.build_trees(df.where(F.lit(False))).count() == 0


def test_surrogates(spark):
    rows = [
        (1, "Mail re.46@mail8.example.com, RE.46@MAIL8.EXAMPLE.COM!! call +1 (743) 555-3824 or (743) 555-3824%%% from 233.233.171.252!! v4.0."),
        (2, 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"### 4785380592391139$$$ 4111 1111 1111 1111; SSN 123-45-6789, DE89 3704 0044 0532 0130 00'),
        (3, "Mrs. Anna Smith met Mr. Smith and госпожа Петрова. Sr Pérez."),
        (4, None), (5, ""), (None, "x@y.zz re.46@mail8.example.com"), (1, "a" * 100000 + " 10.0.0.1 " + "1" * 50000), (6, "Version 2.0, page 12-34, 5.5 kg"), (6, "Version 2.0, page 12-34, 5.5 kg"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("z"))
    out = pii.replace(df, "secret", count="n")
    assert out.columns == ["doc_id", "text", "id", "n"]
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    one = next(r for r in got[1] if r.n > 1).text
    mail = re.search(r"Mail (\S+@\S+\.com),", one)[1]
    assert mail != "re.46@mail8.example.com" and mail.upper() in one and re.fullmatch(r"[a-z]{2}\.\d{2}@[a-z]{4}\d\.[a-z]{7}\.com", mail)
    assert mail in got[None][0].text
    phones = re.findall(r"\((\d{3})\) (\d{3}-\d{4})", one)
    assert phones[0] == phones[1] != ("743", "555-3824") and one.endswith("v4.0.")
    two = got[2][0].text
    assert got[2][0].n == 5 and re.match(r'token = "[0-9a-f]{40}"### \d{16}\$\$\$ \d{4} \d{4} \d{4} \d{4}; SSN \d{3}-\d{2}-\d{4}, DE\d{2} (\d{4} ){4}\d{2}', two)
    card = re.findall(r"\d{4} \d{4} \d{4} \d{4};", two)[0].replace(" ", "")[:-1]
    digits = [int(c) for c in card[::-1]]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    three = got[3][0].text
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) and госпожа ([а-яА-Я]+)\. Sr (\w+)\.", three)
    assert m[1] in pii.GIVEN[("f", "latin")] and m[2] == m[3] != "Smith" and m[4] != "Петрова"
    assert got[4][0].text is None and got[5][0].text == "" and [r.n for r in got[6]] == [0, 0]
    assert "10.0.0.1" not in next(r for r in got[1] if r.n == 1).text
    assert pii.replace(df.where(F.lit(False)), "k").count() == 0
    assert pii.replace(df, "other key").where("doc_id = 2").first().text != two


def test_surrogates_stay_distinct(spark):
    ents = spark.createDataFrame([("ip", f"{i}.1.1.1") for i in range(250)] + [("given:f", f"Name{chr(97 + i)}") for i in range(26)], "kind string, value string")
    got = pii.distinct_surrogates(ents, "k").collect()
    assert len(got) == 276 and len({(r.kind, r.surrogate) for r in got}) == 276
    assert not {(r.kind, r.surrogate) for r in got} & {(r.kind, r.value) for r in got}


def test_surrogates_of_rules_and_used_up_shapes(spark):
    rules = ["Password: ________", "token: ========", "Secret:\n----------", "password: ++++++++", "token=(((((((("]
    rows = list(enumerate(rules)) + [(100 + i, f"token=-------{i}") for i in range(10)] + [(200 + i, f"token=+-------{i}") for i in range(10)]
    out = {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k", count="n").collect()}
    assert all((out[i].text, out[i].n) == (t, 0) for i, t in enumerate(rules))
    real, new = {t for i, t in rows if i >= 100}, {r.text for i, r in out.items() if i >= 100}
    assert len(new) == 20 and not new & real and all(t.startswith(("token=-------", "token=+-------")) for t in new)
    ents = spark.createDataFrame([("phone", f"{i:02}") for i in range(100)] + [("email", f"{c}@1.cc") for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, value string")
    got = pii.distinct_surrogates(ents, "k").collect()
    assert len({(r.kind, r.surrogate) for r in got}) == 126 and not {r.surrogate for r in got} & {r.value for r in got}


def test_surrogates_without_bounds(spark):
    jwt = "eyJhbGciOi" + "J9x4" * 40 + ".eyJzdWIi" + "Ab3d" * 90 + ".Sfl-Kx_w" + "Rj5e" * 50
    long, key, sha = "Zq7+" * 300, "sk-" + "aB3d" * 60, hashlib.sha512(b"x").hexdigest()
    rows = [
        (1, f"token={jwt} end", jwt), (2, f'secret: "{long}" end', long), (3, "password: p@ssw0rd! end", "ssw0rd"), (4, f"key {sha} end", sha), (5, f"{key} end", key),
        (6, "from 2001:db8:85a3:0:0:8a2e:370:7334, 2001:DB8::7, fe80::1ff:fe23:4567:890a: end", "370:7334"), (7, "password='it.s \"x\" p' 'abc\"d.efg9' end", "zzz"), (8, "password: 'abc\"d.efg9' end", "efg9"), (9, "Passwort, password: пароль12 end", "пароль"),
        (10, "Mr. John Smith came. Smith left, Smith's hat too; Smithers and Blacksmith stayed. Mrs. Abcdefghij" + "k" * 40 + " Lee", "kkk"), (11, "Smith is no one here; at 12:34:56 std::dead abc::def aa:bb:cc:dd:ee:ff", "zzz"), (12, "token: don't.worry, joe end", "worry"),
        (13, '{"password": "abc.def#ghi1"}', "ghi1"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(df, "k", count="n").collect()}
    assert all(gone not in got[i].text for i, _, gone in rows)
    assert all(not got[i].text.count(part) for i, part in [(1, "J9x4J9x4"), (1, "Ab3dAb3d"), (1, "Rj5eRj5e"), (2, "Zq7+Zq7+"), (5, "aB3daB3d"), (6, "8a2e"), (6, "DB8::7"), (6, "890a")])
    assert all(got[i].text.endswith(" end") for i in range(1, 10) if i != 7) and [got[i].n for i in (1, 2, 3, 4, 5, 6, 8, 9, 13)] == [1, 1, 1, 1, 1, 3, 1, 1, 1]
    assert got[3].text.startswith("password: ") and re.search(r"[a-z]@[a-z]{3}[0-9][a-z]{2}! end$", got[3].text) and re.search(r"2[0-9]{3}|[0-9]{4}:[a-f]{2}[0-9]:", got[6].text)
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. (\w+) left, (\w+)'s hat too; Smithers and Blacksmith stayed\. Mrs\. ([\w-]+) (\w+)", got[10].text)
    assert m and m[2] == m[3] == m[4] != "Smith" and m[6] != "Lee" and got[10].n == 6
    assert got[11].text == rows[10][1] and got[12].text.endswith(", joe end")


def test_pii_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a@b.cc")], "doc_id long, text string")
    plan = pii.replace(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = read(spark, "documents")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        assert 0.8 * n < out.count() <= n, name
        n = out.count()
        docs = out
    assert docs.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DIR)
    assert empty.count() == 0


def test_registered_names():
    names = list(queries.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
