"""Operators on inline rows: imports, merges, filters, bundles, graph, search, pages, discovery, logs, streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from wareflow.operators import bundles, filters, graph, ingest, logs, merge, modeloutput, outbox, prices, quality, search, serving
from wareflow.sources import files, links, pages

URL = "https://shop.example/{}.html"


def product(n, name="Máy {}", price="1.000.000", ram="16", status="In_Stock", **more):
    row = {
        "source_url": URL.format(n), "category": "laptop", "name": name and name.format(n), "brand": "ACME", "images": None, "prices": {"list_price": price, "sale_price": None},
        "stock": {"status": status, "quantity": "3"}, "warranty": "24 tháng", "description": f"mô tả '{n}'; --", "raw_specs": {"b": "2", "a": "1"},
        "normalized_specs": {"ram_gb": ram, "ports": '["HDMI", null, "USB-C"]', "confidence": "0.9"}, "crawled_at": "2024-05-01T10:00:00+0700",
    }
    return row | more


def dump(spark, tmp_path, rows):
    path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps(rows, ensure_ascii=False))
    return files.in_order(files.read_dump(spark, str(path), ingest.DUMP_SCHEMA))


def counts(snapshot):
    return {r.counter: r.n for r in ingest.counters(snapshot.counts).collect()}


def test_import_again_and_changed(spark, tmp_path):
    now = F.lit("2024-05-02").cast("timestamp")
    rows = [product(i) for i in range(5)] + [product(9, name=None)]
    first = ingest.import_run(dump(spark, tmp_path, rows), ingest.Snapshot(), "shop", now)
    assert counts(first) == {"parsed": 5, "rejected": 1, "new_products": 5, "merged": 5, "new_payloads": 5, "new_prices": 5, "new_chunks": 25, "spec_values": 15}
    again = ingest.import_run(dump(spark, tmp_path, rows), first, "shop", now)
    c = counts(again)
    assert (c["new_products"], c["new_payloads"], c["new_prices"], c["new_chunks"]) == (0, 0, 0, 0)
    assert again.products.count() == 5 and again.spec_values.count() == 15
    later = F.lit("2024-05-03").cast("timestamp")
    changed = [product(0, price="900.000", ram="32", brand=None, crawled_at="2024-05-03T10:00:00"), product(7)]
    third = ingest.import_run(dump(spark, tmp_path, changed), again, "shop", later)
    c = counts(third)
    assert (c["new_products"], c["new_prices"]) == (1, 2)
    zero = third.products.where(F.col("source_url") == URL.format(0)).first()
    assert zero.price_vnd == 900000 and zero.brand == "ACME" and zero.stock_status == "in_stock" and zero.warranty_months == 24
    values = {r.normalized_key: r.value_text for r in third.spec_values.where(F.col("product_id") == zero.id).collect()}
    assert values == {"ram_gb": "32", "ports[0]": "HDMI", "ports[2]": "USB-C"}
    assert third.prices.where(F.col("product_id") == zero.id).count() == 2


def test_malformed_dump_fails_and_tolerant_read_skips(spark, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('[{"name": "a"}, {"name": ')
    with pytest.raises(Exception):
        files.read_dump(spark, str(bad), ingest.DUMP_SCHEMA).collect()
    log = tmp_path / "log.jsonl"
    log.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    from pyspark.sql import types as T

    good, broken = files.read_tolerant(spark, str(log), T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r._corrupt_record for r in broken.collect()] == ["not json"]
    files.append_log(good, str(tmp_path / "out"))
    files.append_log(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_canonical_hash(spark):
    def row(url, price="5", specs=None, at="2024-01-01T00:00:00+0700", text=None):
        return {"source_url": url, "category": "c", "name": "n", "prices": {"list_price": price}, "normalized_specs": specs or {"a": "1", "b": None}, "crawled_at": at, "description": text}

    dump = [row("u1"), row("u2", specs={"b": None, "a": "1"}, at="2025-01-01T00:00:00+0700"), row("u3", price="6"), row("u4", specs={"a": "1"}), row("u5", text="")]
    df = spark.createDataFrame(dump, ingest.DUMP_SCHEMA).withColumn("row_order", F.monotonically_increasing_id())
    h = {r.source_url: r.h for r in ingest.parse(df, "shop")[0].select("source_url", ingest.canonical_hash().alias("h")).collect()}
    assert h["u1"] == h["u2"] and len(set(h.values())) == 4 and len(ingest.BUSINESS_FIELDS) == 19


def test_run_status(spark):
    df = spark.createDataFrame([(0, 100, 100), (1, 200, 200), (2, 100, 100), (1, 200, 189), (0, 100, 90)], "f long, t long, p long")
    assert [r[0] for r in df.select(ingest.run_status(F.col("f"), F.col("t"), F.col("p"))).collect()] == ["done", "partial", "failed", "failed", "done"]


def test_fold_and_upsert(spark):
    new = spark.createDataFrame([(1, 1, "a", "x", "k1"), (1, 2, "b", None, "k2"), (2, 3, None, None, "k3")], "id int, ord int, o string, c string, k string")
    old = spark.createDataFrame([(1, "z", "y", "k0"), (3, "q", "q", "q")], "id int, o string, c string, k string")
    got = sorted(merge.upsert(old, merge.fold_batch(new, "id", "ord", ["o"], ["c"], ["k"]), "id", ["o"], ["c"], ["k"]).collect())
    assert [tuple(r) for r in got] == [(1, "b", "x", "k0"), (2, None, None, "k3"), (3, "q", "q", "q")]


def test_filters(spark):
    for bad in ({"nope": 1}, {"price_min": True}, {"price_min": float("nan")}, {"ram_min": "abc"}):
        with pytest.raises(ValueError):
            filters.catalog_filter(bad)
    df = spark.createDataFrame([("a", "X", 10, 8), ("b", "Y", 20, 16), ("c", "X", None, 32)], "id string, brand string, price_vnd long, ram_gb int")
    ids = lambda p, **k: sorted(r.id for r in df.where(filters.catalog_filter(p, **k)).collect())
    assert ids({"brand": "X,Y", "price_max": 10}) == ["a"]
    assert ids({"min_price": 15, "nope": 3, "sort": "x"}, on_unknown="drop") == ["b"]
    with pytest.raises(ValueError):
        filters.sort_order("best")
    page = filters.page(df, filters.sort_order("price_asc"), 1, 1000).collect()
    assert [r.id for r in page] == ["a", "b", "c"] and page[0].total_hits == 3 and page[0].total_pages == 1


def item(bundle, id_, **more):
    base = dict.fromkeys("socket cpu_cores cpu_model ram_type ram_gb max_ram_gb form_factor psu_wattage_w recommended_psu_w price_vnd supported_mainboard_form_factors".split())
    return base | {"bundle_id": bundle, "id": id_} | more


ITEM = "bundle_id string, id string, socket string, cpu_cores int, cpu_model string, ram_type string, ram_gb int, max_ram_gb int, form_factor string, psu_wattage_w int, recommended_psu_w int, price_vnd long, supported_mainboard_form_factors array<string>"


def test_compatibility_rules(spark):
    rows = [
        item("ok", "c1", socket="AM5", cpu_cores=6, price_vnd=5), item("ok", "m1", socket="AM5", form_factor="ATX", ram_type="DDR5", max_ram_gb=64),
        item("bad", "c2", socket="AM4", cpu_cores=6, recommended_psu_w=400), item("bad", "m2", socket="AM5", form_factor="ATX", ram_type="DDR5", max_ram_gb=16),
        item("bad", "r2", ram_type="DDR4", ram_gb=32), item("bad", "p2", psu_wattage_w=450), item("bad", "k2", supported_mainboard_form_factors=["Mini-ITX"]),
        item("nopsu", "c3", cpu_cores=4, recommended_psu_w=300), item("nopsu", "x3"), item("single", "c4", cpu_cores=4),
    ]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in ITEM.split(", ")) for r in rows], ITEM)
    got = sorted((r.bundle_id, r.rule, r.severity) for r in bundles.issues(df).collect())
    assert got == sorted([("bad", x, "error") for x in ("socket_mismatch", "ram_type_mismatch", "ram_capacity", "form_factor_mismatch", "psu_underpowered")] + [("nopsu", "psu_underpowered", "warning")])
    state = {r.bundle_id: (r.compatible, r.n_errors, r.n_warnings) for r in bundles.evaluate(df).collect()}
    assert state == {"ok": (True, 0, 0), "bad": (False, 5, 0), "nopsu": (True, 0, 1), "single": (False, 0, 0)}
    chosen = df.where("bundle_id = 'bad'").withColumn("category", F.substring("id", 1, 1))
    second = spark.createDataFrame([tuple(item("bad", "m9", socket="AM4", form_factor="ATX", ram_type="DDR4", max_ram_gb=64)[c.split()[0]] for c in ITEM.split(", "))], ITEM).withColumn("category", F.lit("m"))
    assert sorted(r.id for r in bundles.repair(chosen, second).collect()) == ["c2", "k2", "m9", "p2", "r2"]


def test_shares_sum_to_one(spark):
    for r in bundles.share_table(spark).groupBy("use_case", "priority").agg(F.sum("share").alias("s"), F.count("*").alias("n")).collect():
        assert r.s == pytest.approx(1, abs=1e-5) and r.n == 6


def test_neighbours(spark):
    edges = spark.createDataFrame([("a", "compatible_with", "b"), ("c", "compatible_with", "b"), ("c", "substitute_for", "d"), ("x", "compatible_with", "a")], "src string, relation string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")
    rows = lambda d, r=None: sorted((x.src, x.dst, x.depth) for x in graph.neighbours(edges, seeds, d, r).collect())
    assert rows(1) == [("a", "b", 1)]
    assert rows(2) == [("a", "b", 1), ("c", "b", 2)]
    with pytest.raises(ValueError):
        graph.neighbours(edges, seeds, 4)
    with pytest.raises(ValueError):
        graph.neighbours(edges, seeds, 1, "likes")


def test_band_join_equals_plain_inequality(spark):
    import random

    random.seed(1)
    rows = [(f"p{i:03}", random.choice("ab"), round(random.uniform(0, 300), 2)) for i in range(150)] + [("z1", "a", 100.0), ("z2", "a", 80.0), ("z3", "a", 0.0)]
    got = {(r.src, r.dst) for r in graph.substitute_edges(spark.createDataFrame(rows, "id string, role string, price double")).collect()}
    want = {(a, b) for a, ra, pa in rows for b, rb, pb in rows if a != b and ra == rb and pa > 0 and pb > 0 and abs(pa - pb) <= 0.2 * max(pa, pb)}
    assert got == want and ("z1", "z2") in got


def test_typos(spark):
    words = spark.createDataFrame([("laptop",), ("lapto",), ("laptops",), ("tablet",), ("may",)], "word string")
    terms = spark.createDataFrame([("lapotp",), ("laptop",), ("may",)], "term string")
    got = {(r.term, r.word): r.kind for r in search.typo_matches(words, terms).collect()}
    assert got == {("lapotp", "laptop"): "swap", ("laptop", "laptop"): "exact", ("laptop", "lapto"): "edit", ("laptop", "laptops"): "edit", ("may", "may"): "exact"}


def test_cosine_refuses_long_query_lists(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert search.cosine_top_k(q, v, 2).where("rank = 1 AND query_id = vec_id").count() == 5
    with pytest.raises(ValueError):
        search.cosine_top_k(q, v, 2, max_queries=3)


def test_nearest_by_products_is_exact(spark, tmp_path):
    rng = random.Random(9)
    draw = lambda: [rng.gauss(0, 1) for _ in range(6)]
    common, near = draw(), draw()
    rows = [draw() for _ in range(150)] + [common] * 60 + [[x * (1 + 1e-9 * rng.random()) for x in near] for _ in range(60)]
    rows += [None, [0.0] * 6, [None] + [1.0] * 5, [1.0, 2.0], [float("nan")] * 6, [float("inf")] + [1.0] * 5, [2 * x for x in common]]
    rng.shuffle(rows)
    v = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(7, draw()), (7, common)], "vec_id long, embedding array<double>")
    # Every third row, so that all kinds ask: 60 near copies are more than the spare vectors, and some ids occur twice.
    q = v.where("vec_id % 3 = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plain = lambda df: sorted((r.query_id, r.rank, r.vec_id, str(r.cosine)) for r in df.collect())
    want = plain(search.cosine_top_k(q, v, 5))
    assert plain(search.cosine_nearest(q, v, 5, str(tmp_path), few_pairs=0)) == want
    assert plain(search.cosine_nearest(q, v, 5, str(tmp_path), block=20)) == want
    assert search.cosine_nearest(q, v.where("vec_id < 0"), 5, str(tmp_path), few_pairs=0).count() == 0
    whole = v.where("NOT exists(embedding, x -> isnan(x) OR abs(x) = double('inf')) AND size(embedding) = 6")
    index, model = search.cell_index(whole, 4)
    some = q.join(whole.select(F.col("vec_id").alias("query_id")).distinct(), "query_id")
    assert plain(search.probe_top_k(some, index, model, 5, 2, str(tmp_path), few_pairs=0)) == plain(search.probe_top_k(some, index, model, 5, 2, str(tmp_path)))
    assert plain(search.probe_top_k(some, index, model, 5, 4, str(tmp_path), few_pairs=0)) == plain(search.cosine_top_k(some, whole, 5))


PAGE = """<html><head><title>t</title><script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "PC A", "sku": "S1", "brand": {"name": "ACME"}, "offers": {"price": "1990000.0", "availability": "https://schema.org/InStock"}}]}</script></head>
<body><ol class="breadcrumb"><li>Home</li><li>Laptop</li></ol><h1>Other</h1><table><tr><td>CPU</td><td>i5</td></tr><tr><th>RAM</th><td>16GB</td></tr><tr><td>SSD</td><td>512GB</td></tr></table><img src="a.png"><img src="a.png"></body></html>"""
LISTS = "<html><body><h1>Chuột không dây</h1><p>Giá 450.000 đ. Còn hàng. Bảo hành 12 tháng.</p><dl><dt>DPI</dt><dd>1600</dd></dl><ul><li>Kết nối: Bluetooth</li><li>Màu: đen</li></ul></body></html>"
NEWS = "<html><body><h1>Tin tức</h1><p>Bài viết</p></body></html>"


def test_page_records(spark):
    df = spark.createDataFrame([("u/1", PAGE), ("u/2", LISTS), ("u/3", NEWS), ("u/4", None), ("u/5", "")], "url string, html string")
    got = {r.source_url: r for r in pages.records(pages.extract(df)).collect()}
    assert set(got) == {"u/1", "u/2"}
    a, b = got["u/1"], got["u/2"]
    assert (a.name, a.sku, a.brand, a.price_vnd, a.stock_status, a.category) == ("PC A", "S1", "ACME", 1990000, "in_stock", "laptop")
    assert [(p.key, p.value) for p in a.raw_specs] == [("CPU", "i5"), ("RAM", "16GB"), ("SSD", "512GB")] and a.images == ["a.png"] and a.breadcrumbs == ["Home", "Laptop"]
    assert (b.price_vnd, b.stock_status) == (450000, "in_stock") and "12 tháng" in b.warranty
    assert [p.key for p in b.raw_specs] == ["DPI", "Kết nối", "Màu"]


def test_discovery(spark):
    loc = lambda *u: "<urlset>" + "".join(f"<url><loc> {x} </loc></url>" for x in u) + "</urlset>"
    root = "https://s.vn/sitemap.xml"
    docs = spark.createDataFrame([
        (root, loc("https://s.vn/sitemap_pc1.xml", "https://s.vn/sitemap_cat.xml")),
        ("https://s.vn/sitemap_pc1.xml", loc("https://s.vn/a.html", "https://s.vn/b_dm1.html", "https://other.vn/c.html", "https://s.vn/blog/d.html", root)),
        ("https://s.vn/sitemap_cat.xml", loc("https://s.vn/e.html")),
    ], "url string, xml string")
    found = links.discover(docs, [root], ["s.vn"])
    assert [(r["loc"], r.depth) for r in found.collect()] == [("https://s.vn/a.html", 2)]
    seeds = spark.createDataFrame([("http://s.vn/a.html?utm_source=x",), ("https://s.vn/z.html",), ("https://s.vn/k.html",)], "loc string")
    known = spark.createDataFrame([("https://s.vn/k.html",)], "source_url string")
    assert sorted(map(tuple, links.merge_seeds(found, seeds, known).collect())) == [("https://s.vn/a.html", "sitemap"), ("https://s.vn/z.html", "seed")]


def test_model_output(spark):
    df = spark.createDataFrame([
        ('x ```json\n{"category": "Laptop", "ram_gb": "1,024 GB", "confidence": 7, "ports": ["HDMI", " ", null], "brand": "null"}\n```', "other"),
        ('{"category": "chair"}', "cpu"), ("no json", "cpu"), (None, None), ("{broken", "cpu"),
    ], "reply string, cat string")
    spec = modeloutput.normalise(modeloutput.json_object(F.col("reply")), F.col("cat"))
    got = df.withColumn("spec", F.when(modeloutput.json_object(F.col("reply")).isNotNull(), spec)).withColumn("w", modeloutput.warnings(F.col("spec"), F.lit(1))).collect()
    assert got[0].spec.category == "laptop" and got[0].spec.ram_gb == 1024 and got[0].spec.confidence == 1.0 and got[0].spec.ports == ["HDMI"] and got[0].spec.brand is None
    assert got[0].w == ["missing_cpu_model", "missing_storage_gb", "ram_too_large"]
    assert got[1].spec.category == "cpu" and got[1].w == ["missing_cpu_model", "low_confidence"]
    assert got[2].spec is None and got[3].spec is None and got[4].spec is None


def test_outbox_order(spark):
    t = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    fresh = spark.createDataFrame([("a", 2), ("c", 2)], "id string, v int")
    acts = spark.createDataFrame([(1, "a", t, "delete"), (2, "a", t + dt.timedelta(1), "upsert"), (3, "c", t, "upsert")], "id int, product_id string, created_at timestamp, action string")
    rows = lambda **k: sorted(map(tuple, outbox.apply_events(docs, fresh, acts, **k).collect()))
    assert rows() == [("b", 1), ("c", 2)] and rows(last_wins=True) == [("a", 2), ("b", 1), ("c", 2)]


def test_quality_helpers(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in quality.duplicates(df, ["a", "b"]).collect()] == [(1, None, 2)]
    with pytest.raises(ValueError):
        quality.require_columns(df, ["a", "z"])


def test_recommendation_context(spark):
    hits = spark.createDataFrame([(1, 1, "p1", "A", "a", 1000, "in_stock"), (1, 4, "p2", "B", "b", 1, None)], "query_id int, rank int, id string, name string, slug string, price_vnd long, stock_status string")
    specs = serving.grouped_specs(spark.createDataFrame([("p1", "cpu", "socket", "AM5")], "product_id string, group_name string, spec_key string, value_text string"))
    assert logs.recommendation_context(hits, specs, "https://s/").first().context == "A\n1.000 ₫\nCòn hàng\nsocket: AM5\nhttps://s/a.html"


def captures(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("p", t + dt.timedelta(hours=i), h) for i, h in enumerate("aabbcab")] + [("q", t, "x"), ("q", t + dt.timedelta(hours=1), "x")]
    return spark.createDataFrame([(p, c, ord(h), h) for p, c, h in rows], "product_id string, captured_at timestamp, price_vnd long, price_hash string")


def test_price_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from wareflow.streaming import jobs

    df = captures(spark)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.price_change_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.product_id, r.captured_at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.product_id, r.captured_at) for r in prices.price_changes(df, "price_hash", ["captured_at"]).collect())


def test_usage_stream_equals_batch(spark, tmp_path):
    from wareflow.streaming import jobs

    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(hours=7 * i), 100_000 * (i % 4)) for i in range(30)] + [(t + dt.timedelta(days=30), 1)]
    df = spark.createDataFrame(rows, "ts timestamp, tokens long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.daily_usage_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    done = t + dt.timedelta(days=28)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(tuple(r) for r in logs.daily_usage(df.where(F.col("ts") < done)).collect())


def test_step_and_url_streams(spark, tmp_path):
    from wareflow.streaming import jobs

    t = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([("a", "tool", t), ("b", "llm", t)], "step_id string, step_type string, ts timestamp")
    e = spark.createDataFrame([("a", "ok", t + dt.timedelta(seconds=2))], "step_id string, status string, ts timestamp")
    u = spark.createDataFrame([("x", t), ("x", t), ("y", t), ("k", t)], "source_url string, ts timestamp")
    for name, df in (("s", s), ("e", e), ("u", u)):
        df.write.parquet(str(tmp_path / name))
    read = lambda n, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / n))
    out = {}
    for name, df in (("pairs", jobs.step_pairs(read("s", s), read("e", e))), ("urls", jobs.first_seen(read("u", u), spark.createDataFrame([("k",)], "source_url string")))):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start().awaitTermination(120)
        out[name] = spark.table(name).collect()
    assert [tuple(r) for r in out["pairs"]] == [("a", "tool", "ok", 2000)]
    assert sorted(r.source_url for r in out["urls"]) == ["x", "y"]
    got = []
    jobs.drain(read("u", u), lambda batch, k: got.append(batch.count()), str(tmp_path / "cp_drain")).awaitTermination(120)
    assert sum(got) == 4


def test_cells_find_nearest(spark):
    from wareflow.plans import registry, retrieval  # noqa: F401

    for sf in ("sf0.001", "sf0.01"):
        t = registry.Tables(spark, f"/root/testdata/{sf}")
        got = {(r.query_id, r.vec_id) for r in retrieval.cosine_cells(t).collect()}
        want = {(r.query_id, r.vec_id) for r in search.cosine_top_k(retrieval.every_twentieth(t), t.embeddings, 5).collect()}
        assert len(got & want) >= 0.9 * len(want)


def test_classes_give_what_their_edges_give(spark):
    rng = random.Random(5)
    left = spark.createDataFrame([(f"c{k:03}", rng.choice("xyz")) for k in range(24)] + [("both", "x"), ("two", "x")], "id string, socket string")
    right = spark.createDataFrame([(f"m{k:03}", rng.choice("xyzw")) for k in range(17)] + [("both", "x"), ("two", "x")], "id string, socket string")
    # Items on both sides meet each other twice in the product, and are one edge each way.
    edges = graph.equal_key_edges(left, right, "socket", "socket").distinct()
    classes = graph.key_classes(left, right, "socket", "socket")
    rows = lambda df: sorted(map(tuple, df.collect()))
    seeds = left.select("id")
    for depth, limit in ((1, 5), (2, 4), (2, 30), (3, 200)):
        assert rows(graph.class_paths(classes, seeds, depth, limit)) == rows(graph.neighbours(edges, seeds, depth, limit=limit)), (depth, limit)
    nodes = left.select("id").union(right.select("id")).distinct().where("id NOT IN ('c003', 'm004', 'm011', 'both', 'two')")
    assert rows(graph.class_dangling(classes, nodes, 3)) == rows(graph.dangling(edges, nodes).select("src", "dst", "rule"))
    assert graph.class_coverage(classes.where("side = 0"), nodes).count() == 0
    apart = graph.key_classes(left.where("id LIKE 'c%'"), right.where("id LIKE 'm%'"), "socket", "socket")
    plain = edges.where("src NOT IN ('both', 'two') AND dst NOT IN ('both', 'two')")
    assert rows(graph.class_coverage(apart, nodes)) == rows(graph.statistics(plain, nodes))


def test_large_classes_make_no_pairs(spark):
    many = spark.range(40_000).select(F.concat(F.lit("a"), "id").alias("id"), F.lit("s").alias("socket"))
    classes = graph.key_classes(many, many.withColumn("id", F.concat(F.lit("b"), "id")), "socket", "socket")
    assert graph.class_coverage(classes, classes).first().n_edges == 2 * 40_000**2
    assert graph.class_paths(classes, many.limit(3), 2).count() == 600 and graph.class_neighbours(classes, many.limit(1000), 50).count() == 50_000


def test_substitutes_are_counted_by_price(spark):
    rows = [(k, k % 3 or None, [100.0, 80.0, 79.99, 125.0, 125.01, -4.0, 0.0, None][k % 8]) for k in range(200)]
    items = spark.createDataFrame(rows, "id long, role int, price double")
    want = graph.substitute_edges(items).groupBy("src").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, graph.substitute_counts(items).collect())) == sorted(map(tuple, want.collect()))


def test_substitutes_are_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, 1, 2]), rng.choice([None, -1.0, 0.0, 80.0, 100.0, 125.0, 79.99, round(rng.uniform(1, 300), 2)])) for _ in range(300)]
    items = spark.createDataFrame(rows, "id long, role int, price double")
    near = lambda x, y: x[1] is not None and x[1] == y[1] and (x[2] or 0) > 0 and (y[2] or 0) > 0 and abs(x[2] - y[2]) <= 0.2 * max(x[2], y[2])
    pairs = [(x[0], y[0]) for x in rows for y in rows if x[0] is not None and y[0] is not None and x[0] != y[0] and near(x, y)]
    want = {x: sum(p[0] == x for p in pairs) for x, _ in pairs}
    assert {r.src: r.n for r in graph.substitute_counts(items).collect()} == want
    got = [(r.src, r.dst) for r in graph.substitute_edges(items).collect()]
    assert sorted(got) == sorted(set(pairs))
    plan = graph.substitute_counts(items)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(src") == 1


def test_requests_are_not_shuffled_for_their_picks(spark):
    cols = "category string, variant string, id string, price_vnd long, stock_status string, gpu_vram_gb int, cpu_cores int, ram_gb int"
    cand = spark.createDataFrame([("cpu", "any", f"c{k}", 100 * (k % 7 + 1), "in_stock" if k % 2 else None, None, 4 + k, None) for k in range(20)], cols)
    asked = spark.createDataFrame([(1, "office", "balanced", 2000, None), (2, "gaming", "budget", 50, "any"), (3, "general", "balanced", 350, "any")], "request_id long, use_case string, priority string, budget_vnd long, cpu_preference string")
    got = {r.request_id: (r.id, r.fallback) for r in bundles.picks(asked, cand).collect()}
    # 600 for a processor: the cheapest are the best value, all capped at 1, so availability and price decide; 88 fits nothing, 350 buys the cheapest.
    assert got == {1: ("c7", False), 3: ("c0", True)}
    assert [r.options for r in bundles.ranked(asked, cand, 2).collect()] == [["c7", "c1"]]
    plan = bundles.picks(asked, cand)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_picks_are_of_all_candidates(spark):
    rng = random.Random(11)
    cols = "category string, variant string, id string, price_vnd long, stock_status string, gpu_vram_gb int, cpu_cores int, ram_gb int"
    rows = [(c, "any", f"{c}{k:03}", rng.choice([1, 2, 3, 60, 61, 70]) * 10**rng.randrange(4, 7), rng.choice(["in_stock", "out", None]), rng.choice([None, 0, 4, 8, 12, 24]), rng.choice([None, 4, 12, 16]), rng.choice([None, 8, 16, 64])) for c in ("gpu", "cpu", "ram") for k in range(120)]
    asked = [(k, use, "balanced", rng.randrange(1, 5) * 10**rng.randrange(4, 9)) for k, use in enumerate(list(bundles.SHARES) * 12)]
    requests, cand = spark.createDataFrame(asked, "request_id long, use_case string, priority string, budget_vnd long"), spark.createDataFrame(rows, cols)

    def score(r, use):
        part, whole = {"gaming": (r[5], 12), "video_editing": (r[6], 16), "3d_render": (r[5], 16), "office": (r[7], 32)}.get(use, (None, 1))
        return round(0.6 * (min(1.0, part / whole) if part else 0.5) + 0.3 * min(1.0, 5e6 / r[3]) + 0.1 * (1.0 if r[4] == "in_stock" else 0.5), 6)

    first, best, other, beyond = {}, {}, {}, 0
    for k, use, _, budget in asked:
        for c in ("gpu", "cpu", "ram"):
            own = sorted((r for r in rows if r[0] == c and r[3] <= budget), key=lambda r: (r[3], r[2]))
            fits = sorted((r for r in own if r[3] <= round(budget * bundles.SHARES[use][c])), key=lambda r: (-score(r, use), r[3], r[2]))
            if own:
                top = (fits or own)[0]
                first[k, c] = (top[2], top[3], score(top, use), not fits)
                beyond += top not in own[:20]
            if fits:
                best[k, c] = [r[2] for r in fits[:2]]
            if c != "ram" and len(fits) > 1:
                other[k, c] = fits[1][2]
    picks, options = bundles.picks(requests, cand), bundles.ranked(requests, cand, 2)
    assert {(r.request_id, r.category): (r.id, r.price_vnd, r.score, r.fallback) for r in picks.collect()} == first and beyond > 5
    assert {(r.request_id, r.category): r.options for r in options.collect()} == best
    assert {(r.request_id, r.category): r.id for r in bundles.alternatives(picks, options).collect()} == other


def test_equal_lines_are_read_once(spark):
    from wareflow.plans import registry

    plan = registry.QUERIES["hardware_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [line" in plan


def test_query_words_are_kept_before_the_shuffle(spark):
    docs = spark.createDataFrame([(1, "laptop gaming laptop"), (2, "gaming"), (3, ""), (4, None), (5, "other words here")], "doc_id long, text string")
    q = spark.createDataFrame([("a", "laptop"), ("a", "gaming"), ("b", "none")], "query_id string, term string")
    every = search.tokens(docs, "doc_id", "text")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(search.bm25_of(docs, "doc_id", "text", q, 10)) == rows(search.bm25(every, q, 10)) != []
    assert rows(search.tokens(docs, "doc_id", "text", q)) == rows(every.where("term IN ('laptop', 'gaming')"))


def test_script_counts_equal_the_whole_extraction(spark):
    df = spark.createDataFrame([("u1", "<script>a</script><p>x<script type='application/ld+json'>{}</script>"), ("u2", None), ("u3", "<p>" * 50)], "url string, html string")
    assert sorted(map(tuple, pages.script_counts(df).collect())) == sorted((r.url, r.n_scripts) for r in pages.extract(df).collect()) == [("u1", 2), ("u2", 0), ("u3", 0)]


def test_bundle_items_are_put_together_once(spark):
    from wareflow.plans import registry

    plan = registry.QUERIES["bundle_evaluation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "bundle-items" in plan and "lineitem.parquet" not in plan
