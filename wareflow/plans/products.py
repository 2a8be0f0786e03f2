"""Queries over search documents, the stored word index, and the wide specifications."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareflow.functions import specs
from wareflow.operators import documents, filters, index, ingest, modeloutput, prices

from .catalog import _LATEST, TIE
from .registry import Tables, query


def shelf(t: Tables, name: str, table: str) -> str:
    """Folder of an index over a table: the shared folder of the cluster, by the state of the table's files."""
    spark = t.spark
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    files = getattr(t, table).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.sum("file_size"), F.max("file_modification_time"), F.min("file_path")).first()
    return f"{base.rstrip('/')}/word-index/{name}-{hashlib.sha256(repr(tuple(state)).encode()).hexdigest()[:16]}"


def stored(t: Tables, name: str, table: str, rows, fields: list[str], key: str, parent: str | None = None) -> index.Index:
    """The index called ``name`` over ``rows()``, built on first use for this state of ``table``."""
    path = shelf(t, name, table)
    there = t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ready")
    if there.getFileSystem(t.spark._jsc.hadoopConfiguration()).exists(there):
        return index.Index(t.spark, path, fields)
    # Another folder for an attempt that may have ended midway; the mark comes last.
    # The texts are made once, as a table: words, places and lengths each read them several times.
    texts = index.saved(rows().select(key, *([parent] if parent else []), *fields), f"{path}/texts/{uuid.uuid4().hex}")
    made = index.Index.build(texts, path, fields, key, parent)
    t.spark.range(1).write.mode("overwrite").parquet(f"{path}/ready")
    return made


_DOCS = f"""{_LATEST}, lp AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN price_vnd + 1000 END AS list_now FROM latest),
docs AS (SELECT replace(i.id, ':', '_') AS id, i.id AS product_id, slug, source, source_url, sku, name, brand, category, subcategory, 'Trang chủ|' || lower(p_type) AS breadcrumbs, thumbnail_url,
 COALESCE(l.price_vnd, i.price_vnd) AS price_vnd, COALESCE(list_now, list_price_vnd) AS list_price_vnd, sale_price_vnd, build_pc_price_vnd, CAST(NULL AS BIGINT) AS regional_price_vnd,
 COALESCE(NULLIF(l.stock_status, ''), i.stock_status) AS stock_status, stock_quantity, warranty_months, warranty_text, product_type, model, cpu_model, socket, ram_gb, ram_type, ram_speed_mhz, storage_gb, storage_type, gpu_model,
 gpu_vram_gb, CAST(screen_inches AS DOUBLE) AS screen_inches, resolution_label, refresh_rate_hz, panel_type, form_factor, CAST(NULL AS INT) AS psu_wattage_w, recommended_psu_w, updated_at,
 concat_ws(' / ', cpu_model, CASE WHEN ram_gb > 0 THEN ram_gb || 'GB ' || ram_type END, CASE WHEN storage_gb > 0 THEN COALESCE(storage_type, 'Storage') || ' ' || storage_gb || 'GB' END, gpu_model, CASE WHEN screen_inches > 0 THEN screen_inches || ' inch' || COALESCE(' ' || refresh_rate_hz || 'Hz', '') END) AS spec_summary,
 list_filter([CASE WHEN cpu_model LIKE 'Core%' THEN lower(cpu_model[6:]) END, CASE WHEN cpu_model LIKE 'Core%' THEN replace(lower(cpu_model[6:]), '-', ' ') END, CASE WHEN cpu_model LIKE 'Core%' THEN replace(lower(cpu_model[6:]), '-', '') END,
 CASE WHEN cpu_model LIKE 'Ryzen%' THEN lower(cpu_model) END, CASE WHEN cpu_model LIKE 'Ryzen%' THEN 'r' || lower(cpu_model[7:]) END,
 lower(g), replace(lower(g), ' ', ''), CASE WHEN g LIKE '% Ti' THEN lower(g[5:]) END, ram_gb || 'gb', ram_gb || ' gb', lower(ram_type), ram_gb || 'gb ' || lower(ram_type), storage_gb || 'gb', storage_gb || ' gb', CASE WHEN storage_type IS NOT NULL THEN 'ssd' || storage_gb END,
 CASE WHEN storage_gb % 1024 = 0 THEN (storage_gb // 1024) || 'tb' END, screen_inches || ' inch', screen_inches || 'inch', refresh_rate_hz || 'hz', refresh_rate_hz || ' hz',
 CASE WHEN replace(strip_accents(lower(name)), 'đ', 'd') <> lower(name) THEN replace(strip_accents(lower(name)), 'đ', 'd') END], lambda x: x IS NOT NULL) AS tk
 FROM items i JOIN part USING (p_partkey) LEFT JOIN (SELECT *, CASE WHEN gpu_model LIKE 'GeForce%' THEN gpu_model[9:] WHEN gpu_model LIKE 'Radeon%' THEN gpu_model[8:] END AS g FROM item_specs) s ON s.product_id = i.id LEFT JOIN lp l ON l.product_id = i.id WHERE status = 'active' AND deleted_at IS NULL),
d AS (SELECT * EXCLUDE (tk), array_to_string(list_filter(tk, lambda x, i: list_position(tk, x) = i), '|') AS normalized_tokens FROM docs)"""
_USES = "items item_specs prices"


def product_documents(t: Tables) -> DataFrame:
    """Search documents of all active items of any source."""
    latest = prices.latest_prices(t.prices, TIE).withColumn("list_price_vnd", F.when(F.col("l_linenumber") % 2 == 0, F.col("price_vnd") + 1000))
    return documents.search_documents(t.items.where((F.col("status") == "active") & F.col("deleted_at").isNull()), t.item_specs, latest)


@query(f"WITH {_DOCS} SELECT * FROM d", _USES)
def search_documents_full(t: Tables):
    """All 42 fields of the search documents, lists joined by a bar."""
    return product_documents(t).withColumns({c: F.array_join(c, "|") for c in ("breadcrumbs", "normalized_tokens")})


def product_index(t: Tables) -> index.Index:
    return stored(t, "items", "part", lambda: product_documents(t), documents.SEARCHED, "id")


# Words of each field with their places, the elements of the two list fields GAP places apart.
_PLACES = (
    "fl AS (SELECT id, field, CASE WHEN field IN (5, 10) THEN string_split(v, '|') ELSE [v] END AS e FROM (SELECT id, unnest([name, brand, sku, category, subcategory, breadcrumbs, model, cpu_model, gpu_model, spec_summary, normalized_tokens, warranty_text]) AS v, unnest(range(12)) AS field FROM d) WHERE v IS NOT NULL), "
    "fe AS (SELECT id, field, k, list_filter(string_split_regex(replace(strip_accents(lower(e[k])), 'đ', 'd'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM fl, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS k)), "
    f"fs AS (SELECT *, COALESCE(sum(len(w) + CASE WHEN len(w) > 0 THEN {index.GAP} ELSE 0 END) OVER (PARTITION BY id, field ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, sum(len(w)) OVER (PARTITION BY id, field) AS flen FROM fe), "
    "pw AS (SELECT id, field, flen, unnest(w) AS term, CAST(base AS BIGINT) + unnest(range(len(w))) AS pos FROM fs)"
)
_RANKED = f"""{_DOCS}, {_PLACES},
qw AS (SELECT query_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS place FROM (SELECT query_id, list_filter(string_split_regex(replace(strip_accents(lower(text)), 'đ', 'd'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM questions)),
sp AS (SELECT word, term, CASE WHEN word = term THEN 0 ELSE 1 END AS typos FROM (SELECT DISTINCT word FROM qw), (SELECT DISTINCT term FROM pw) WHERE word = term OR (length(word) >= {index.TYPO_LENGTH} AND abs(length(word) - length(term)) <= 1 AND damerau_levenshtein(word, term) = 1)),
m0 AS (SELECT query_id, n, place, typos, id, field, flen, pos FROM qw JOIN sp USING (word) JOIN pw USING (term)),
ab AS (SELECT query_id, n, id, min(g.p) AS words FROM (SELECT DISTINCT query_id, n, id FROM m0) k, LATERAL (SELECT unnest(range(n + 1)) AS p) g WHERE NOT EXISTS (SELECT 1 FROM m0 WHERE m0.query_id = k.query_id AND m0.id = k.id AND m0.place = g.p) GROUP BY 1, 2, 3),
m AS (SELECT m0.*, words FROM m0 JOIN ab USING (query_id, id) WHERE place < words),
t1 AS (SELECT query_id, id, n, words, CAST(sum(typos) AS INT) AS typo, CAST(sum(field) AS INT) AS attribute FROM (SELECT query_id, id, n, words, place, min(typos) AS typos, min(field) AS field FROM m GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4),
sw AS (SELECT a.query_id, a.id, a.field, a.flen, a.words, a.pos, b.place, min(b.pos) AS nxt FROM (SELECT DISTINCT query_id, id, field, flen, words, pos FROM m) a JOIN m b ON a.query_id = b.query_id AND a.id = b.id AND a.field = b.field AND b.pos >= a.pos GROUP BY 1, 2, 3, 4, 5, 6, 7),
sv AS (SELECT query_id, id, field, flen, max(nxt) - pos + 1 AS span FROM sw GROUP BY query_id, id, field, flen, words, pos HAVING count(*) = words),
sx AS (SELECT query_id, id, min(span) AS proximity, bool_or(span = flen) AS tight, min(CASE WHEN span = flen THEN flen END) AS fl FROM sv GROUP BY 1, 2),
hits AS (SELECT t1.query_id, t1.id, CAST(t1.words AS INT) AS words, typo, CAST(COALESCE(proximity, {index.FAR}) AS INT) AS proximity, attribute,
 CASE WHEN t1.words = t1.n AND EXISTS (SELECT 1 FROM sv WHERE sv.query_id = t1.query_id AND sv.id = t1.id AND span = n AND flen = n) THEN 1 ELSE 0 END AS exactness FROM t1 LEFT JOIN sx USING (query_id, id))"""
_SEARCH = "items item_specs prices questions"


def questions(t: Tables) -> DataFrame:
    return t.questions.select("query_id", "text")


@query(f"WITH {_RANKED} SELECT query_id, rank, id, words, typo, proximity, attribute, exactness FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, typo, proximity, attribute, exactness DESC, id) AS rank FROM hits) WHERE rank <= 10", _SEARCH)
def ranked_search(t: Tables):
    """The ten best products of each query by words, typos, nearness, field and exactness, from the stored index."""
    found = lambda q: index.matches(product_index(t), q).withColumnRenamed("doc", "id")
    return index.each_text(questions(t), lambda q: index.ranked(found(q), 10, index.relevance())).select("query_id", "rank", "id", "words", "typo", "proximity", "attribute", "exactness")


_KEEP = {"price_min": 500, "ram_min": 16, "ram_max": 88}
_KEPT = "source = 'shop' AND price_vnd >= 500 AND ram_gb >= 16 AND ram_gb <= 88"


def saver(t: Tables) -> Callable[[DataFrame, str], DataFrame]:
    """Writes tables of one run under a folder of their own beside the index."""
    folder = f"{shelf(t, 'answers', 'part')}/{uuid.uuid4().hex}"
    return lambda df, name: index.saved(df, f"{folder}/{name}")


def _kinds(t: Tables, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = product_documents(t).where(filters.catalog_filter(_KEEP, source="shop")).select("id", *documents.FACETS)
    return index.product_kinds(product_index(t), asked, kept, saver(t))


@query(f"WITH {_RANKED}, h AS (SELECT hits.*, ram_gb FROM hits JOIN d USING (id) WHERE {_KEPT}), n AS (SELECT query_id, count(*) AS total_hits FROM h GROUP BY 1) SELECT query_id, rank, id, ram_gb, total_hits, CAST(ceil(total_hits / 5.0) AS BIGINT) AS total_pages FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, typo, proximity, attribute, ram_gb DESC NULLS LAST, exactness DESC, id) AS rank FROM h) JOIN n USING (query_id) WHERE rank BETWEEN 6 AND 10", _SEARCH)
def search_page(t: Tables):
    """Second page of filtered hits, the larger memory first among equally relevant ones."""
    own = index.filters.sort_order("ram_desc")
    page = lambda q: index.page_of_kinds(*_kinds(t, q), index.relevance("ram_desc"), own, 2, 5)
    return index.each_text(questions(t), page).select("query_id", "rank", "id", "ram_gb", "total_hits", "total_pages")


@query(f"WITH {_RANKED}, h AS (SELECT query_id, brand, category, ram_gb FROM hits JOIN d USING (id) WHERE {_KEPT}) SELECT query_id, 'brand' AS facet, brand AS value, count(*) AS n FROM h WHERE brand IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT query_id, 'category', category, count(*) FROM h WHERE category IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT query_id, 'ram_gb', CAST(ram_gb AS VARCHAR), count(*) FROM h WHERE ram_gb IS NOT NULL GROUP BY 1, 3", _SEARCH)
def search_facets(t: Tables):
    """Facets of the filtered hits of each query, all in one aggregate."""
    return index.each_text(questions(t), lambda q: index.facets_of_kinds(*_kinds(t, q), documents.FACETS))


_CHUNKS = """ck AS (SELECT p_partkey * 2 AS doc, id AS parent, name || ' | brand=' || brand || ' | category=' || category AS content FROM items UNION ALL SELECT p_partkey * 2 + 1, id, COALESCE(cpu_model, '') || '; ' || COALESCE(gpu_model, '') || '; ' || product_type || ' ' || lower(name) FROM items JOIN item_specs ON id = product_id),
tw AS (SELECT doc, parent, list_filter(string_split_regex(replace(strip_accents(lower(content)), 'đ', 'd'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM ck), tk AS (SELECT doc, parent, len, term, count(*) AS tf FROM (SELECT doc, parent, len(w) AS len, unnest(w) AS term FROM tw) GROUP BY 1, 2, 3, 4),
qt AS (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(replace(strip_accents(lower(text)), 'đ', 'd'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM questions),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tw WHERE len(w) > 0), df AS (SELECT term, count(*) AS df FROM tk GROUP BY 1),
bm AS (SELECT query_id, doc, parent, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM qt JOIN tk USING (term) JOIN df USING (term), st GROUP BY 1, 2, 3),
ft AS (SELECT query_id, doc, parent, CAST(sum(tf) AS BIGINT) AS score FROM qt JOIN tk USING (term) JOIN (SELECT query_id, count(*) AS need FROM qt GROUP BY 1) USING (query_id) GROUP BY 1, 2, 3, need HAVING count(*) = need),
live AS (SELECT i.id, COALESCE(l.price_vnd, i.price_vnd) AS price_vnd, brand, category FROM items i LEFT JOIN latest l ON l.product_id = i.id WHERE source = 'shop' AND status = 'active' AND deleted_at IS NULL AND COALESCE(l.price_vnd, i.price_vnd) > 1 AND brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5'))"""


def item_chunks(t: Tables) -> DataFrame:
    """Two texts for each item, its title and its specifications."""
    i, s = t.items, t.item_specs
    title = i.select((F.col("p_partkey") * 2).alias("doc"), F.col("id").alias("parent"), F.concat("name", F.lit(" | brand="), "brand", F.lit(" | category="), "category").alias("content"))
    both = i.join(s, F.col("id") == F.col("product_id"))
    spec = F.concat(F.coalesce("cpu_model", F.lit("")), F.lit("; "), F.coalesce("gpu_model", F.lit("")), F.lit("; "), "product_type", F.lit(" "), F.lower("name"))
    return title.unionByName(both.select((F.col("p_partkey") * 2 + 1).alias("doc"), F.col("id").alias("parent"), spec.alias("content")))


def chunk_index(t: Tables) -> index.Index:
    return stored(t, "chunks", "part", lambda: item_chunks(t), ["content"], "doc", "parent")


def live_items(t: Tables) -> DataFrame:
    """Active, priced items of five brands with their current price: what a relational search may show."""
    latest = prices.latest_prices(t.prices, TIE).select(F.col("product_id").alias("id"), F.col("price_vnd").alias("now"))
    rows = t.items.where(filters.active("shop") & filters.catalog_filter({"brand": "Brand#1,Brand#2,Brand#3,Brand#4,Brand#5"})).join(latest, "id", "left")
    price = F.coalesce("now", "price_vnd")
    return rows.where(price > 1).select("id", price.alias("price_vnd"), "brand", "category")


def _products(t: Tables, how: str) -> DataFrame:
    live, idx = live_items(t), chunk_index(t)

    def page(q: DataFrame) -> DataFrame:
        members = index.text_kinds(idx, q, live, saver(t))
        best = index.page_of_kinds(members, index.text_values(idx, q, members, how), [F.desc("score"), F.col("id")], [F.col("id")], 1, 10)
        return best.withColumn("doc", F.element_at("docs", F.col("k").cast("int")))

    return index.each_text(questions(t), page).select("query_id", "rank", "id", "doc", "score", "price_vnd", "total_hits", "total_pages")


def _page_sql(scores: str) -> str:
    return f"""b AS (SELECT query_id, parent AS id, arg_min(doc, struct_pack(s := -score, d := doc)) AS doc, max(score) AS score FROM {scores} JOIN live ON parent = live.id GROUP BY 1, 2), n AS (SELECT query_id, count(*) AS total_hits FROM b GROUP BY 1)
SELECT query_id, rank, id, doc, score, price_vnd, total_hits, CAST(ceil(total_hits / 10.0) AS BIGINT) AS total_pages FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) JOIN n USING (query_id) JOIN live USING (id) WHERE rank <= 10"""


@query(f"WITH {_LATEST}, {_CHUNKS}, {_page_sql('bm')}", _SEARCH)
def bm25_products(t: Tables):
    """Products by their best text's BM25 score, active, priced and of the wanted brands, with totals."""
    return _products(t, "bm25")


@query(f"WITH {_LATEST}, {_CHUNKS}, {_page_sql('ft')}", _SEARCH)
def all_terms_products(t: Tables):
    """Products with a text that holds every word of the query."""
    return _products(t, "all_terms")


@query(f"WITH {_LATEST}, {_CHUNKS} SELECT query_id, rank, doc, score, content[:40] AS content FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM ft) JOIN ck USING (doc) WHERE rank <= 20", _SEARCH)
def best_texts(t: Tables):
    """The twenty best texts of each query, cut to ten tokens."""
    return index.each_text(questions(t), lambda q: index.best_chunks(index.all_terms(chunk_index(t), q), item_chunks(t), 20, 10))


@query(
    f"""WITH {_RANKED}, {_CHUNKS.split("live AS (")[0].rstrip().rstrip(",")},
kept AS (SELECT id, product_id, brand, category, ram_gb FROM d WHERE source = 'shop'), pick AS (SELECT query_id, product_id AS id, CAST(words AS DOUBLE) AS score FROM hits JOIN kept USING (id) JOIN (SELECT DISTINCT query_id, n FROM qw) USING (query_id) WHERE words = n AND typo = 0),
b2 AS (SELECT query_id, parent AS id, max(score) AS score FROM ft JOIN kept ON parent = product_id GROUP BY 1, 2), b3 AS (SELECT query_id, parent AS id, max(score) AS score FROM bm JOIN kept ON parent = product_id GROUP BY 1, 2),
r2 AS (SELECT * FROM b2 WHERE query_id NOT IN (SELECT query_id FROM pick)), r3 AS (SELECT * FROM b3 WHERE query_id NOT IN (SELECT query_id FROM pick) AND query_id NOT IN (SELECT query_id FROM r2)),
a AS (SELECT query_id, 'index' AS engine, id, score FROM pick UNION ALL SELECT query_id, 'all_terms', id, CAST(score AS DOUBLE) FROM r2 UNION ALL SELECT query_id, 'bm25', id, score FROM r3),
g AS (SELECT query_id, max(engine) AS source, count(*) AS total_hits, array_to_string(list(id ORDER BY score DESC, id)[1:5], ',') AS hits FROM a GROUP BY 1)
SELECT q.query_id, source, COALESCE(source <> 'index', true) AS fallback, COALESCE(total_hits, 0) AS total_hits, CAST(ceil(COALESCE(total_hits, 0) / 5.0) AS BIGINT) AS total_pages, COALESCE(hits, '') AS hits,
(SELECT count(*) FROM (SELECT DISTINCT brand FROM a JOIN kept ON a.id = product_id WHERE a.query_id = q.query_id AND engine = 'index')) + (SELECT count(*) FROM (SELECT DISTINCT category FROM a JOIN kept ON a.id = product_id WHERE a.query_id = q.query_id AND engine = 'index')) AS n_facets FROM questions q LEFT JOIN g USING (query_id)""",
    _SEARCH,
)
def search_envelopes(t: Tables):
    """One result envelope for each query: exact matches of the index, else texts with all words, else BM25."""
    save = saver(t)
    docs = product_documents(t).where("source = 'shop'").select(F.col("product_id").alias("id"), F.col("id").alias("index_id"), "brand", "category")
    kind = lambda form: F.concat(F.lit(form), F.col("held").cast("string"))

    def answer(q: DataFrame) -> DataFrame:
        members, values = index.product_kinds(product_index(t), q, docs, save, "index_id")
        exact = values.where("n > 0 AND words = n AND typo = 0").select("query_id", kind("index").alias("id"), F.col("words").alias("score"))
        texts = index.text_kinds(chunk_index(t), q, members.drop("index_id", "held"), save)
        by_text = lambda how: lambda left: index.text_values(chunk_index(t), left, texts, how).select("query_id", kind("text").alias("id"), "score")
        forms = {"index": lambda left: exact, "all_terms": by_text("all_terms"), "bm25": by_text("bm25")}
        shown = ["id", "brand", "category"]
        both = members.select(kind("index").alias("held"), *shown).unionByName(texts.select(kind("text").alias("held"), *shown))
        return index.envelope_of_kinds(index.with_fallback(q, forms, save), both, ["brand", "category"], 1, 5)

    out = index.each_text(questions(t), answer)
    return out.select("query_id", "source", "fallback", "total_hits", "total_pages", F.array_join("hits", ",").alias("hits"), F.size("facets").cast("long").alias("n_facets"))


def normalized(t: Tables) -> DataFrame:
    """Items with their specifications as maps of text, as an import has them."""
    s = t.item_specs
    pairs = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in s.columns if c != "product_id"]
    ports = F.when(F.col("screen_inches").isNotNull(), F.struct(F.lit("ports").alias("key"), F.lit('["HDMI", null, "USB-C"]').alias("value")))
    bad = F.when(F.col("ram_gb") > 90, F.struct(F.lit("weight_kg").alias("key"), F.lit("heavy").alias("value")))
    return s.select(F.col("product_id").alias("id"), F.map_from_entries(F.array_compact(F.array(*pairs, ports, bad))).alias("normalized_specs"))


_WIDE = ", ".join(f"w.{c}" for c in "product_id product_type model cpu_model socket ram_gb ram_type ram_speed_mhz storage_gb storage_type gpu_model gpu_vram_gb resolution_label refresh_rate_hz panel_type form_factor recommended_psu_w".split())


@query(f"SELECT {_WIDE}, CAST(screen_inches AS DOUBLE) AS screen_inches, CAST(NULL AS DOUBLE) AS weight_kg, CASE WHEN screen_inches IS NOT NULL THEN 'HDMI,USB-C' ELSE '' END AS ports, 45 AS n_columns FROM item_specs w", "item_specs")
def wide_spec_columns(t: Tables):
    """The typed projection of normalised maps; lists joined by commas, the columns of this data shown."""
    wide = ingest.wide_specs(normalized(t))
    shown = [c.split(".")[1] for c in _WIDE.split(", ")]
    return wide.select(*shown, "screen_inches", "weight_kg", F.array_join("ports", ",").alias("ports"), F.lit(len(wide.columns)).alias("n_columns"))


@query("SELECT product_id, COALESCE(CASE WHEN product_type <> 'small' THEN ram_gb END, CASE WHEN ram_gb > 40 THEN 1 ELSE ram_gb END) AS ram_gb, COALESCE(CASE WHEN product_type <> 'medium' THEN gpu_model END, gpu_model) AS gpu_model, CASE WHEN product_type = 'small' THEN '' WHEN screen_inches IS NOT NULL THEN 'HDMI,USB-C' ELSE '' END AS ports FROM item_specs", "item_specs")
def wide_spec_merge(t: Tables):
    """Wide rows merged into older ones: what isn't null wins, lists are replaced."""
    from wareflow.operators import merge

    rows = ingest.wide_specs(normalized(t))
    old = rows.withColumn("ram_gb", F.when(F.col("ram_gb") > 40, 1).otherwise(F.col("ram_gb")))
    none = F.array().cast("array<string>")
    small = F.col("product_type") == "small"
    new = rows.withColumns({"ports": F.when(small, none).otherwise(F.col("ports")), "ram_gb": F.when(~small, F.col("ram_gb")), "row_order": F.lit(1)})
    new = new.withColumn("gpu_model", F.when(F.col("product_type") != "medium", F.col("gpu_model")))
    out = merge.upsert(old, merge.fold_batch(new, "product_id", "row_order", ingest.WIDE_WHOLE, ingest.WIDE_SCALARS, []), "product_id", ingest.WIDE_WHOLE, ingest.WIDE_SCALARS, [])
    return out.select("product_id", "ram_gb", "gpu_model", F.array_join("ports", ",").alias("ports"))


@query("""WITH l AS (SELECT product_id, CASE WHEN cpu_model LIKE 'Core%' THEN 'Intel ' || cpu_model WHEN cpu_model IS NOT NULL THEN 'AMD ' || cpu_model END AS cpu, upper(CASE WHEN gpu_model LIKE 'GeForce%' THEN gpu_model[9:] ELSE gpu_model[8:] END) AS gpu, gpu_vram_gb, socket, ram_type, ram_gb, recommended_psu_w, screen_inches, refresh_rate_hz FROM item_specs)
SELECT product_id, cpu, gpu, gpu_vram_gb AS vram_gb, CASE WHEN gpu_vram_gb > 0 THEN 'GDDR6X' END AS vram_type, socket, ram_type, CASE WHEN ram_gb > 0 THEN 2 END AS modules, recommended_psu_w AS watt, CASE WHEN recommended_psu_w > 0 THEN '80 Plus Gold' END AS grade,
CAST(screen_inches AS VARCHAR) AS inches, CAST(refresh_rate_hz AS VARCHAR) AS hz, CASE WHEN cpu IS NOT NULL THEN 4.6 END AS ghz, CASE WHEN socket IS NOT NULL THEN 'B660M' END AS chipset FROM l""", "item_specs")
def hardware_lines(t: Tables):
    """Fields read back from product lines that are put together from them."""
    s = t.item_specs
    vendor = F.when(F.col("cpu_model").startswith("Core"), "Intel ").otherwise("AMD ")
    text_of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    c = F.col
    parts = [
        text_of(vendor, c("cpu_model"), " 3,5 GHz up to 4.6GHz"),
        text_of(F.coalesce("gpu_model", F.lit("")), ", VRAM ", F.coalesce("gpu_vram_gb", F.lit(0)), "GB"),
        F.when(c("gpu_vram_gb") > 0, "gddr6x 256bit"),
        text_of("Socket ", c("socket"), " B660M-A"),
        text_of("RAM ", c("ram_gb"), "GB (2 x ", (c("ram_gb") / 2).cast("int"), "GB) ", c("ram_type"), " 3200MHz"),
        text_of(c("recommended_psu_w"), "W 80 Plus Gold"),
        text_of(c("screen_inches"), " inch ", F.coalesce(text_of(c("refresh_rate_hz"), "Hz"), F.lit(""))),
    ]
    line = F.concat_ws(" / ", *parts)
    rows = s.select("product_id", line.alias("line"))
    # Equal lines are read once.
    lines = rows.select("line").distinct()
    read = {
        "cpu": specs.cpu_model, "gpu": specs.gpu_model, "vram_type": specs.vram_type, "socket": specs.socket, "ram_type": specs.ram_type, "modules": specs.module_count,
        "watt": specs.wattage, "grade": specs.efficiency, "ghz": specs.max_ghz, "chipset": specs.chipset,
    }
    measured = {"inches": lambda x: specs.measure(x, "INCH"), "hz": lambda x: specs.measure(x, "HZ"), "vram_gb": lambda x: F.nullif(specs.vram_gb(x), F.lit(0))}
    fields = lines.select("line", *[f(F.col("line")).alias(k) for k, f in {**read, **measured}.items()])
    return rows.join(fields, "line").drop("line")


@query("""SELECT product_id, product_type AS category, CASE WHEN ram_gb > 0 THEN 'ok' ELSE 'partial' END AS status, array_to_string(list_filter([CASE WHEN COALESCE(ram_gb, 0) = 0 THEN 'no_ram' END, CASE WHEN gpu_model IS NULL THEN 'no_gpu' END], lambda x: x IS NOT NULL), ',') AS w FROM item_specs""", "item_specs")
def spec_states(t: Tables):
    """Status and warnings of each item as the histograms count them."""
    return _states(t).select("product_id", "category", F.col("spec_status").alias("status"), F.array_join("parse_warnings", ",").alias("w"))


def _states(t: Tables) -> DataFrame:
    s = t.item_specs
    warn = F.array_compact(F.array(F.when(F.coalesce("ram_gb", F.lit(0)) == 0, "no_ram"), F.when(F.col("gpu_model").isNull(), "no_gpu")))
    kept = ["model", "socket", "ram_gb", "gpu_model"]
    pairs = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))) for k in kept])))
    return s.select("product_id", F.col("product_type").alias("category"), F.when(F.col("ram_gb") > 0, "ok").otherwise("partial").alias("spec_status"), warn.alias("parse_warnings"), pairs.alias("normalized_specs"))


@query("""WITH s AS (SELECT product_type AS category, * FROM item_specs), e AS (SELECT category, 'product' AS kind, 'all' AS name FROM s UNION ALL SELECT category, 'status', CASE WHEN ram_gb > 0 THEN 'ok' ELSE 'partial' END FROM s UNION ALL SELECT category, 'warning', 'no_ram' FROM s WHERE COALESCE(ram_gb, 0) = 0 UNION ALL SELECT category, 'warning', 'no_gpu' FROM s WHERE gpu_model IS NULL
UNION ALL SELECT category, 'field', 'model' FROM s WHERE model IS NOT NULL UNION ALL SELECT category, 'field', 'socket' FROM s WHERE socket IS NOT NULL UNION ALL SELECT category, 'field', 'ram_gb' FROM s WHERE ram_gb IS NOT NULL UNION ALL SELECT category, 'field', 'gpu_model' FROM s WHERE gpu_model IS NOT NULL)
SELECT category, kind, name, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM s WHERE s.category = e.category), 2) AS pct FROM e GROUP BY 1, 2, 3""", "item_specs")
def audit_histograms(t: Tables):
    """Products, statuses, warnings and normalised fields of each category."""
    return modeloutput.histograms(_states(t))
