"""The stored word index, versioned partitions, search documents, and the wide specifications."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wareflow.operators import documents, index, ingest
from wareflow.operators.store import Store

DOCS = [
    ("a", "Máy tính xách tay", "Acer", ["Trang chủ", "Laptop gaming"], 100, 16),
    ("b", "Laptop gaming Acer Nitro", "Acer", ["Laptop"], 200, 32),
    ("c", "Túi đựng laptop", "Acme", ["Phụ kiện"], 50, None),
    ("d", "Bàn phím cơ gaming cho máy tính", None, None, 70, None),
    ("e", "Laptop", "Dell", [], 300, 8),
]
SCHEMA = "id string, name string, brand string, breadcrumbs array<string>, price_vnd long, ram_gb int"
FIELDS = ["name", "brand", "breadcrumbs"]


@pytest.fixture
def built(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    return docs, index.Index.build(docs, str(tmp_path / "index"), FIELDS, buckets=4)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def order(hits, sort="relevance"):
    return [r.id for r in index.ranked(hits, 100, index.relevance(sort)).orderBy("rank").collect()]


def test_rank_order(spark, built):
    docs, idx = built
    find = lambda text: index.search_products(idx, asked(spark, text), docs)
    # The name before the breadcrumbs, a whole field before others.
    assert order(find("laptop")) == ["b", "e", "c", "a"] == order(find("lapotp"))
    assert set(order(find("may tinh"))) == {"a", "d"}
    rows = {r.id: r for r in find("laptop acer").collect()}
    assert rows["b"].words == 2 and rows["b"].proximity == 3 and rows["e"].words == 1 and rows["e"].exactness == 0
    assert rows["a"].words == 2 and rows["a"].proximity == index.FAR
    assert {r.id: r.exactness for r in find("laptop").collect()}["e"] == 1
    assert order(find("laptop gaming"), "price_desc")[0] in ("a", "b")
    assert order(find("gaming xyz")) and all(r.words == 1 for r in find("gaming xyz").collect())
    assert find("xyz laptop").count() == 0
    assert find("").count() == 5 and find("  ").count() == 5


def test_all_named_sorts(spark, built):
    docs, idx = built
    wide = docs.withColumns({c: F.lit(None).cast("int") for c in ("storage_gb", "refresh_rate_hz")}).withColumn("updated_at", F.current_timestamp())
    hits = index.search_products(idx, asked(spark, "gaming"), wide)
    assert order(hits, "ram_desc")[0] in ("b", "a", "d")
    for sort in index.filters.SORTS:
        assert sorted(order(hits, sort)) == ["a", "b", "d"]
    with pytest.raises(ValueError):
        index.relevance("best")


def test_page_and_facets(spark, built):
    docs, idx = built
    hits = index.search_products(idx, asked(spark, "laptop", "gaming"), docs, F.col("price_vnd") >= 70)
    page = index.page_of(hits, index.relevance(), 2, 2).where("query_id = 0").collect()
    assert [(r["rank"], r.total_hits, r.total_pages) for r in page] == [(3, 3, 2)]
    facets = {(r.query_id, r.facet, r.value): r.n for r in index.facets_of(hits, ["brand", "ram_gb"]).collect()}
    assert facets == {(0, "brand", "Acer"): 2, (0, "brand", "Dell"): 1, (0, "ram_gb", "16"): 1, (0, "ram_gb", "32"): 1, (0, "ram_gb", "8"): 1, (1, "brand", "Acer"): 2, (1, "ram_gb", "16"): 1, (1, "ram_gb", "32"): 1}


def test_equal_texts_are_ranked_once(spark, built):
    _, idx = built
    q, seen = spark.createDataFrame([(k, "Laptop ") for k in range(40)] + [(40, None), (41, "gaming"), (42, " ")], "query_id long, text string"), []

    def first_two(texts):
        seen.append(sorted(r.text for r in texts.collect()))
        return index.ranked(index.matches(idx, texts).withColumnRenamed("doc", "id"), 2, index.relevance())

    got = {(r.query_id, r.rank): r.id for r in index.each_text(q, first_two).collect()}
    want = {(r.query_id, r.rank): r.id for r in index.ranked(index.matches(idx, q).withColumnRenamed("doc", "id"), 2, index.relevance()).collect()}
    assert got == want and len(got) > 80 and seen == [["", "gaming", "laptop"]]


def many(spark, tmp_path):
    """60 documents of which many are equal but for id, price and memory; an index of them; queries."""
    rows = [(f"{k:02}", *DOCS[k % 5][1:4], k % 7, (k * 5) % 3 * 8 or None) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([(0, "laptop"), (1, "lapotp gaming"), (2, ""), (3, None), (4, "may tinh xyz"), (5, "zzz"), (6, "Laptop")], "query_id int, text string")
    return docs, index.Index.build(docs, str(tmp_path / "index"), FIELDS, buckets=4), q


def test_kinds_give_the_pages_and_facets_of_all_hits(spark, tmp_path):
    docs, idx, q = many(spark, tmp_path)
    kept = docs.where("price_vnd > 0")
    hits = index.search_products(idx, q, docs, F.col("price_vnd") > 0)
    members, values = index.product_kinds(idx, q, kept, lambda df, name: index.saved(df, str(tmp_path / name)))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for sort in ("relevance", "price_desc", "ram_desc"):
        shown = ["query_id", "rank", "id", "ram_gb", *index.VALUES, "total_hits", "total_pages"]
        own = [c for c in index.relevance(sort)[4:-2]] + [F.col("id")]
        for number, limit in ((1, 3), (2, 5), (5, 7)):
            got = index.page_of_kinds(members, values, index.relevance(sort), own, number, limit).select(*shown)
            assert rows(got) == rows(index.page_of(hits, index.relevance(sort), number, limit).select(*shown)) != []
    assert rows(index.facets_of_kinds(members, values, ["brand", "ram_gb"])) == rows(index.facets_of(hits, ["brand", "ram_gb"])) != []
    # A query has a row for each kind of the five documents, not for each hit.
    assert values.count() <= 7 * 5 < hits.count() / 3


def test_kinds_of_texts_give_the_best_texts_of_parents(spark, tmp_path):
    texts = ["laptop gaming", "laptop laptop cũ", "gaming", "màn hình", "laptop gaming gaming chuột"]
    docs = spark.createDataFrame([(k, f"p{k // 2 % 20:02}", texts[k * k % 5]) for k in range(80)], "doc long, parent string, content string")
    idx = index.Index.build(docs, str(tmp_path / "index"), ["content"], "doc", "parent", buckets=4)
    q = asked(spark, "laptop gaming", "laptop", "", "zzz", "gaming zzz")
    parents = docs.where("parent <> 'p03'").select(F.col("parent").alias("id")).distinct()
    members = index.text_kinds(idx, q, parents, lambda df, name: index.saved(df, str(tmp_path / name)))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "doc", "score").collect()))
    for how, scores in (("all_terms", index.all_terms(idx, q)), ("bm25", index.bm25(idx, q))):
        values = index.text_values(idx, q, members, how)
        got = values.join(members, "held").withColumn("doc", F.element_at("docs", F.col("k").cast("int")))
        want = index.best_by_parent(scores, parents.withColumnRenamed("id", "parent")).withColumnRenamed("parent", "id")
        assert rows(got) == rows(want) != [] and values.count() < got.count()
    with pytest.raises(ValueError):
        index.text_values(idx, q, members, "best")


def test_envelope_of_kinds_is_that_of_all_hits(spark):
    q = asked(spark, "x", "y", "z")
    members = spark.createDataFrame([("a", f"{k:02}", "AB"[k % 2]) for k in range(9)] + [("b", "99", "C"), ("c", "00", None)], "held string, id string, brand string")
    form = lambda rows: lambda left: left.join(spark.createDataFrame(rows, "query_id int, id string, score double"), "query_id").drop("text")
    answers = index.with_fallback(q, {"first": form([(0, "a", 1.0), (0, "b", 2.0)]), "second": form([(0, "c", 9.0), (1, "a", 1.0)])})
    each = answers.withColumnRenamed("id", "held").join(members.select("held", "id"), "held", "left").drop("held")
    got = index.envelope_of_kinds(answers, members, ["brand"], 1, 4)
    want = index.envelope(each, members.where("held <> 'c'").drop("held"), ["brand"], 1, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.query_id: (r.total_hits, r.hits) for r in got.collect()} == {0: (10, ["99", "00", "01", "02"]), 1: (9, ["00", "01", "02", "03"]), 2: (0, [])}


def test_update_equals_rebuild(spark, built, tmp_path):
    docs, idx = built
    new = spark.createDataFrame([("e", "Màn hình Dell", "Dell", None, 1, None), ("f", "Laptop cũ", None, [None, "Laptop"], 1, None)], SCHEMA)
    idx.update(new, removed=spark.createDataFrame([("c",), ("zzz",), ("f",)], "id string"))
    now = docs.where("id NOT IN ('c', 'e')").unionByName(new)
    again = index.Index.build(now, str(tmp_path / "again"), FIELDS, buckets=4)
    q = asked(spark, "laptop gaming", "lapotp", "man hinh", "dell", "tui")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.matches(idx, q)) == rows(index.matches(again, q))
    assert rows(index.bm25(idx, q)) == rows(index.bm25(again, q)) and rows(index.all_terms(idx, q)) == rows(index.all_terms(again, q))
    assert {r.doc for r in index.matches(idx, asked(spark, "laptop")).collect()} == {"a", "b", "f"}


def test_queries_read_their_buckets_only(spark, built):
    _, idx = built
    plan = index.bm25(idx, asked(spark, "nitro"))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in " ".join(x.split("]")[0] for x in plan.split("PartitionFilters:")[1:])


def test_window_equals_plain_search(spark):
    import itertools
    import random

    rng = random.Random(3)
    rows = [(k, sorted((rng.randrange(12), rng.randrange(3)) for _ in range(rng.randrange(1, 9))), 1 + rng.randrange(3)) for k in range(60)]

    def plain(events, n):
        found = [max(p for p, _ in c) - min(p for p, _ in c) + 1 for c in itertools.product(*[[e for e in events if e[1] == w] for w in range(n)]) if c]
        return min(found, default=None)

    df = spark.createDataFrame(rows, "k int, events array<struct<place: int, word: int>>, n int")
    kept = F.filter("events", lambda e: e["word"] < F.col("n"))
    got = {r.k: r.w for r in df.select("k", index._window(kept, F.col("n")).alias("w")).collect()}
    assert got == {k: plain([e for e in events if e[1] < n], n) for k, events, n in rows}


def test_fallback_and_envelope(spark):
    q = asked(spark, "x", "y", "z")
    docs = spark.createDataFrame([("p", "A"), ("q", "A"), ("r", "B")], "id string, brand string")
    form = lambda rows: lambda left: left.join(spark.createDataFrame(rows, "query_id int, id string, score double"), "query_id").drop("text")
    saved = []
    answers = index.with_fallback(q, {"first": form([(0, "p", 1.0), (0, "r", 2.0)]), "second": form([(0, "q", 9.0), (1, "q", 1.0)])}, lambda df, name: saved.append(name) or df)
    out = {r.query_id: r for r in index.envelope(answers, docs, ["brand"], 1, 1).collect()}
    assert saved == ["first", "second"]
    assert (out[0].source, out[0].fallback, out[0].total_hits, out[0].total_pages, out[0].hits) == ("first", False, 2, 2, ["r"])
    assert [tuple(x) for x in out[0].facets] == [("brand", "A", 1), ("brand", "B", 1)]
    assert (out[1].source, out[1].fallback, out[1].hits, out[1].facets) == ("second", True, ["q"], [])
    assert (out[2].source, out[2].total_hits, out[2].hits) == (None, 0, [])


def test_store_publishes_whole_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "source", "source string, id int")
    rows = lambda *r: spark.createDataFrame(list(r), "source string, id int")
    seen = lambda: sorted(tuple(r) for r in store.read().collect())
    assert seen() == []
    assert store.publish(rows(("x", 1), ("x", 2), ("y", 3)), ["x", "y"], {"x": 2}, "t0")
    assert not store.publish(rows(("x", 9)), ["x"], token="t0")
    with pytest.raises(ValueError):
        store.publish(rows(("x", 5)), ["x"], {"x": 2})
    with pytest.raises(ValueError):
        store.publish(rows(("z", 5)), ["x"])
    assert seen() == [("x", 1), ("x", 2), ("y", 3)]
    store.publish(store.read(["x"]).where("id = 2"), ["x"])
    assert seen() == [("x", 2), ("y", 3)]
    store.publish(rows(), ["y"])
    assert seen() == [("x", 2)] and sorted(tuple(r) for r in store.read(["y"]).collect()) == []
    assert store.vacuum() == 4 and seen() == [("x", 2)] and store.vacuum() == 0


PRODUCT = "id string, source string, name string, status string, deleted_at string, price_vnd long"


def catalog(spark, *rows):
    products = spark.createDataFrame(list(rows), PRODUCT)
    specs = spark.createDataFrame([("s:1", 16, "DDR4")], "product_id string, ram_gb int, ram_type string")
    latest = spark.createDataFrame([("s:1", 7, "")], "product_id string, price_vnd long, stock_status string")
    return products, specs, latest


def test_rebuild_drops_stale_documents(spark, tmp_path):
    one = catalog(spark, ("s:1", "s", "Máy", "active", None, 5), ("s:2", "s", "B", "active", None, 6), ("o:1", "o", "C", "active", None, 1))
    docs = documents.search_documents(*one)
    assert len(docs.columns) == 42
    row = docs.where("id = 's_1'").first()
    assert (row.product_id, row.price_vnd, row.stock_status, row.breadcrumbs, row.spec_summary) == ("s:1", 7, None, [], "16GB DDR4")
    assert row.normalized_tokens == ["16gb", "16 gb", "ddr4", "16gb ddr4", "may"]
    store = documents.document_store(spark, str(tmp_path / "docs"), docs)
    assert documents.rebuild(store, *one, "s")["documents"] == 2
    documents.rebuild(store, *one, "o")
    two = catalog(spark, ("s:1", "s", "Máy", "inactive", None, 5), ("s:3", "s", "D", "active", None, 6), ("s:4", "s", "E", "active", "x", 6))
    assert documents.rebuild(store, *two, "s") == {"indexed": 1, "active": 1, "documents": 1}
    assert sorted(r.product_id for r in store.read().collect()) == ["o:1", "s:3"]
    events = spark.createDataFrame([("s", "pending"), ("s", "done")], "source string, status string")
    state = {r.source: r for r in documents.parity(store, two[0].where("status = 'active' AND deleted_at IS NULL"), events).collect()}
    assert (state["s"].n_products, state["s"].n_documents, state["s"].open_events, state["s"].ok) == (1, 1, 1, False)
    assert (state["o"].stale, state["o"].ok, [tuple(x) for x in state["o"].samples]) == (1, False, [("o:1", "C")])
    assert documents.rebuild(store, two[0].where("false"), *two[1:], "s")["documents"] == 0


def test_outbox_stream_repeats_harmlessly(spark, tmp_path):
    from wareflow.streaming import jobs

    tables = catalog(spark, ("s:1", "s", "A", "active", None, 5), ("s:2", "s", "B", "inactive", None, 6), ("s:3", "s", "C", "active", None, 1), ("o:1", "o", "D", "active", None, 1))
    store = documents.document_store(spark, str(tmp_path / "docs"), documents.search_documents(*tables))
    documents.rebuild(store, *tables, "s")
    t = dt.datetime(2024, 1, 1)
    schema = "id int, product_id string, event_type string, created_at timestamp"
    batches = [[(1, "s:1", "upsert", t), (2, "s:2", "upsert", t), (3, "x:9", "upsert", t), (4, "o:1", "upsert", t)], [(5, "s:3", "delete", t), (6, "s:3", "upsert", t), (7, "s:1", "reindex", t)]]
    source = str(tmp_path / "in")
    checkpoint, died = str(tmp_path / "cp"), []
    real = documents.apply_batch

    def dying(*args):
        done = real(*args)
        if not died:
            died.append(1)
            raise RuntimeError("after the publication, before the commit of the batch")
        return done

    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        for attempt in range(2):
            documents.apply_batch = dying if attempt == 0 else real
            try:
                jobs.drain_documents(spark.readStream.schema(schema).parquet(source), store, *tables, checkpoint).awaitTermination(120)
            except Exception as e:
                assert "after the publication" in str(e)
            finally:
                documents.apply_batch = real
    assert died and sorted(r.product_id for r in store.read().collect()) == ["o:1", "s:1"]


def dump_rows(spark, *rows):
    data = [{"source_url": f"u{k}", "category": "c", "name": f"n{k}", "prices": {"list_price": "5"}, "normalized_specs": specs, "crawled_at": "2024-01-01"} for k, specs in rows]
    return spark.createDataFrame(data, ingest.DUMP_SCHEMA).withColumn("row_order", F.monotonically_increasing_id())


def test_wide_upsert_touches_its_buckets_only(spark, tmp_path):
    store = ingest.wide_store(spark, str(tmp_path / "wide"))
    wide = lambda *rows: ingest.wide_specs(ingest.parse(dump_rows(spark, *rows), "shop")[0])
    assert len(wide((1, {"ram_gb": "16"})).drop("row_order").columns) == 45
    first = wide((1, {"ram_gb": "16", "ports": '["A", null]', "weight_kg": "1,5"}), (2, {"ram_gb": "x", "os": " "}), (3, {"socket": "AM5"}))
    assert ingest.upsert_wide(store, first) == 3
    before = store.versions()
    assert ingest.upsert_wide(store, wide((1, {"socket": "AM4", "cpu_cores": "6"}), (1, {"cpu_cores": None, "os": "Windows"}))) == 1
    assert sum(before[b] != v for b, v in store.versions().items()) == 1
    rows = {r.product_id: r for r in store.read().collect()}
    one = next(r for r in rows.values() if r.socket == "AM4")
    assert len(rows) == 3 and (one.ram_gb, one.cpu_cores, one.os, one.ports, one.weight_kg) == (16, 6, "Windows", [], 15.0)
    assert one.specs == '{"cpu_cores":null,"os":"Windows"}'
    assert ingest.upsert_wide(store, first.where("false")) == 0


def test_import_with_wide_specs_and_dry_run(spark):
    dump = dump_rows(spark, (1, {"ram_gb": "16", "socket": "AM5"}), (2, {"ports": '["A", "B"]'}))
    counts = {r.counter: r.n for r in ingest.dry_run(dump, "shop").collect()}
    assert counts == {"parsed": 2, "rejected": 0, "products": 2, "specs": 2, "spec_values": 4, "prices": 2, "prices_from_crawled_at": 2, "chunks": 10, "wide_filled": 2}
    now = F.lit(dt.datetime(2024, 1, 2))
    one = ingest.import_run(dump, ingest.Snapshot(), "shop", now)
    two = ingest.import_run(dump_rows(spark, (1, {"ram_gb": "32"}), (2, {"ports": '["A", "B"]'})), one, "shop", now)
    rows = sorted((r.ram_gb or 0, r.socket, r.ports) for r in two.wide.collect())
    assert rows == [(0, None, ["A", "B"]), (32, "AM5", [])]
    assert two.changed.count() == 1 and one.changed.count() == 2
