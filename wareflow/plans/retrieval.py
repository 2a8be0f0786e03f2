"""Queries for text, vectors, graph and bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wareflow.functions import text
from wareflow.operators import bundles, filters, graph, index, quality, search

from .registry import Tables, query

_WORDS = "string_split_regex(replace(strip_accents(lower({c})), 'đ', 'd'), '[^\\p{L}\\p{N}]+')"
_TOK = f"w AS (SELECT doc_id AS doc, list_filter({_WORDS.replace('{c}', 'text')}, lambda x: x <> '') AS w FROM documents), tok AS (SELECT doc, term, len, count(*) AS tf FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM w) GROUP BY 1, 2, 3)"
_Q = f"q AS (SELECT item_id AS query_id, unnest(list_sort(list_distinct(list_filter({_WORDS.replace('{c}', 'text')}, lambda x: length(x) >= 6)))[1:4]) AS term FROM benchmark)"


def query_terms(t: Tables):
    w = F.array_sort(F.array_distinct(F.filter(text.words(F.col("text")), lambda x: F.length(x) >= 6)))
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.slice(w, 1, 4)).alias("term"))


def shared_folder(t: Tables) -> str:
    return t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.conf.get("spark.sql.warehouse.dir")


@query(f"""WITH {_TOK}, {_Q}, s AS (SELECT count(*) AS n, avg(len) AS a FROM (SELECT DISTINCT doc, len FROM tok)), df AS (SELECT term, count(*) AS df FROM tok GROUP BY 1),
r AS (SELECT query_id, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM q JOIN tok USING (term) JOIN df USING (term), s GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM r) WHERE rank <= 10""")
def bm25_top(t: Tables):
    return search.bm25_of(t.documents, "doc_id", "text", query_terms(t), 10)


@query(f"""WITH {_TOK}, {_Q}, n AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1), h AS (SELECT query_id, doc, count(*) AS c, sum(tf) AS score FROM q JOIN tok USING (term) GROUP BY 1, 2)
SELECT query_id, doc, score, rank FROM (SELECT query_id, doc, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM h JOIN n USING (query_id) WHERE c = need) WHERE rank <= 20""")
def all_terms_top(t: Tables):
    return search.all_terms(search.tokens(t.documents, "doc_id", "text"), query_terms(t), 20)


@query(f"""WITH {_TOK}, {_Q}, h AS (SELECT query_id, doc, CAST(sum(tf) AS BIGINT) AS score FROM q JOIN tok USING (term) GROUP BY 1, 2)
SELECT query_id, source, arg_max(doc, score * 1000000000 - doc) AS doc, max(score) AS score FROM h JOIN documents ON doc = doc_id GROUP BY 1, 2""")
def best_chunk_per_parent(t: Tables):
    """Best text of each source for each query."""
    hit = query_terms(t).join(search.tokens(t.documents, "doc_id", "text"), "term").groupBy("query_id", "doc").agg(F.sum("tf").alias("score"))
    return search.best_chunk(hit.join(t.documents.select(F.col("doc_id").alias("doc"), "source"), "doc"), "source")


@query(f"""WITH {_TOK}, v AS (SELECT DISTINCT term AS word FROM tok), {_Q}, k AS (SELECT DISTINCT term FROM q)
SELECT term, word, CASE WHEN term = word THEN 'exact' WHEN levenshtein(a, b) = 1 THEN 'edit' ELSE 'swap' END AS kind FROM (SELECT *, translate(term, 'ßœæøłŋ', 'ABCDEF') AS a, translate(word, 'ßœæøłŋ', 'ABCDEF') AS b FROM k JOIN v ON abs(length(term) - length(word)) <= 1) WHERE levenshtein(a, b) <= 1 OR (length(a) = length(b) AND damerau_levenshtein(a, b) = 1)""")
def typo_matches(t: Tables):
    words = search.tokens(t.documents, "doc_id", "text").select(F.col("term").alias("word")).distinct()
    return search.typo_matches(words, query_terms(t).select("term").distinct())


@query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), u AS (SELECT vec_id, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS v FROM e WHERE list_sum([y * y FOR y IN v]) > 0),
r AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, u.v)]), 6) AS cosine FROM u, (SELECT * FROM u WHERE vec_id % 20 = 0) q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM r) WHERE rank <= 5""")
def cosine_top(t: Tables):
    """The five nearest vectors of every vector whose id is divisible by 20."""
    return search.cosine_nearest(every_twentieth(t), t.embeddings, 5, shared_folder(t))


@query(f"""WITH {_TOK}, {_Q}, h AS (SELECT DISTINCT query_id, doc FROM q JOIN tok USING (term)), n AS (SELECT query_id, count(*) AS n FROM h GROUP BY 1), d AS (SELECT DISTINCT query_id FROM q)
SELECT d.query_id, COALESCE(n.n, 0) AS n_hits, CASE WHEN n.n > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM d LEFT JOIN n USING (query_id)""")
def search_probes(t: Tables):
    """Each probe query must find a document."""
    q = query_terms(t)
    hits = q.join(search.tokens(t.documents, "doc_id", "text", q), "term").select("query_id", "doc").distinct()
    return quality.probes(q, hits)


@query("""WITH h AS (SELECT p.*, s.ram_gb FROM products p JOIN specs s ON s.product_id = p.id WHERE list_contains(string_split(name, ' '), 'red') AND price_vnd <= 99000) SELECT 'brand' AS facet, brand AS value, count(*) AS n FROM h GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM h GROUP BY 2""", "products specs")
def faceted_search(t: Tables):
    """Facets over the hits of a text query with filters."""
    from wareflow.operators import serving

    hits = t.products.where(filters.catalog_filter({"price_max": 99000})).where(F.array_contains(text.words(F.col("name")), "red"))
    return serving.facets(hits, ["brand", "category"])


_P = "products specs"
_EDGES = """c AS (SELECT id, socket FROM products JOIN specs ON id = product_id WHERE cpu_cores IS NOT NULL), m AS (SELECT id, socket, ram_type FROM products JOIN specs ON id = product_id WHERE form_factor IS NOT NULL AND cpu_cores IS NULL),
e0 AS (SELECT c.id AS src, m.id AS dst FROM c JOIN m ON c.socket = m.socket WHERE c.socket <> ''), edges AS (SELECT src, 'compatible_with' AS relation, dst, 'socket' AS rule FROM e0 UNION ALL SELECT dst, 'compatible_with', src, 'socket' FROM e0)"""


def parts(t: Tables, role: str):
    rows = t.products.drop("p_size").join(t.specs.drop("p_size"), F.col("id") == F.col("product_id"))
    return rows.where(F.expr(filters.ROLES[role]))


def classes(t: Tables):
    return socket_classes(t).unionByName(graph.key_classes(parts(t, "ram"), parts(t, "mobo"), "ram_type", "ram_type"))


def socket_classes(t: Tables):
    return graph.key_classes(parts(t, "cpu"), parts(t, "mobo"), "socket", "socket")


@query(f"WITH {_EDGES} SELECT rule, relation, count(*) AS n, count(DISTINCT src) AS sources FROM edges GROUP BY 1, 2 UNION ALL SELECT 'ram_type', 'compatible_with', 2 * count(*), count(DISTINCT a.id) + count(DISTINCT b.id) FROM (SELECT id, ram_type FROM products JOIN specs ON id = product_id WHERE ram_gb IS NOT NULL AND psu_wattage_w IS NULL AND cpu_cores IS NULL) a JOIN m b ON a.ram_type = b.ram_type", _P)
def compatibility_edges(t: Tables):
    return graph.class_statistics(classes(t))


@query("SELECT src, count(*) AS n FROM (SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_acctbal > 0 AND b.s_acctbal > 0 AND abs(a.s_acctbal - b.s_acctbal) <= 0.2 * greatest(a.s_acctbal, b.s_acctbal)) p, (VALUES (0), (1)) k(s), LATERAL (SELECT CASE WHEN s = 0 THEN x ELSE y END AS src) GROUP BY 1")
def substitute_edges(t: Tables):
    """Suppliers of a nation whose balances lie within twenty percent, by the band join."""
    items = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("role"), F.col("s_acctbal").alias("price"))
    return graph.substitute_counts(items)


@query(f"""WITH {_EDGES}, s AS (SELECT id FROM c ORDER BY id LIMIT 5), l1 AS (SELECT id AS seed, src, relation, dst, 1 AS depth FROM s JOIN edges ON src = id),
l2 AS (SELECT DISTINCT l1.seed, e.src, e.relation, e.dst, 2 AS depth FROM l1 JOIN edges e ON e.src = l1.dst OR e.dst = l1.dst),
u AS (SELECT seed, src, relation, dst, min(depth) AS depth FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1, 2, 3, 4)
SELECT seed, src, relation, dst, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, src, dst, relation) AS n FROM u) WHERE n <= 200""", _P)
def graph_neighbours(t: Tables):
    seeds = parts(t, "cpu").select("id").orderBy("id").limit(5)
    return graph.class_paths(socket_classes(t), seeds, 2)


@query(f"WITH {_EDGES}, r AS (SELECT id, ram_type FROM products JOIN specs ON id = product_id WHERE ram_gb IS NOT NULL AND psu_wattage_w IS NULL AND cpu_cores IS NULL), x AS (SELECT src, dst, rule FROM edges UNION ALL SELECT r.id, m.id, 'ram_type' FROM r JOIN m ON r.ram_type = m.ram_type AND r.ram_type <> '' AND r.id <> m.id UNION ALL SELECT m.id, r.id, 'ram_type' FROM r JOIN m ON r.ram_type = m.ram_type AND r.ram_type <> '' AND r.id <> m.id), s AS (SELECT id AS seed FROM products WHERE p_partkey % 20 = 0), g AS (SELECT seed, dst, min(rule) AS rule FROM s JOIN x ON src = seed WHERE seed <> dst GROUP BY 1, 2) SELECT seed, dst, rule FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY dst) AS n FROM g) WHERE n <= 200", _P)
def compatible_items(t: Tables):
    """The first 200 compatible items of every product whose key is divisible by 20, through classes."""
    return graph.class_neighbours(classes(t), t.products.where("p_partkey % 20 = 0").select("id"))


@query(f"WITH {_EDGES} SELECT relation, count(*) AS n_edges, count(*) FILTER (WHERE src = dst) AS self_loops, round(100.0 * count(DISTINCT src) / (SELECT count(*) FROM products), 1) AS coverage_pct FROM edges GROUP BY 1", _P)
def graph_statistics(t: Tables):
    return graph.class_coverage(socket_classes(t), t.products.select("id"))


@query(f"WITH {_EDGES} SELECT src, dst FROM edges WHERE src IN (SELECT id FROM products WHERE status <> 'active') OR dst IN (SELECT id FROM products WHERE status <> 'active')", _P)
def dangling_edges(t: Tables):
    return graph.class_dangling(socket_classes(t), t.products.where("status = 'active'").select("id")).select("src", "dst")


@query("SELECT id, 'product' AS type, name AS label FROM products WHERE status = 'active' AND deleted_at IS NULL", "products")
def graph_nodes(t: Tables):
    return t.products.where(filters.active("shop")).select("id", F.lit("product").alias("type"), F.col("name").alias("label"))


def _shares() -> str:
    rows = []
    for use, shares in bundles.SHARES.items():
        for priority, factors in bundles.FACTORS.items():
            total = sum(s * factors[c] for c, s in shares.items())
            rows += [f"('{use}', '{priority}', '{c}', CAST({round(s * factors[c] / total, 6)} AS DOUBLE))" for c, s in shares.items()]
    return "shares(use_case, priority, category, share) AS (VALUES " + ", ".join(rows) + "), alloc AS (SELECT r.*, category, share, greatest(0, CAST(round_even(budget_vnd * share, 0) AS BIGINT)) AS category_budget FROM requests r JOIN shares USING (use_case, priority))"


@query(f"WITH {_shares()} SELECT request_id, category, category_budget FROM alloc", "requests")
def budget_allocation(t: Tables):
    return bundles.allocate(t.requests).select("request_id", "category", "category_budget")


_CAND = """roles AS (
SELECT 'cpu' AS category, v AS variant, j.* FROM j, (VALUES ('any'), ('intel'), ('amd')) k(v) WHERE cpu_cores IS NOT NULL AND (v = 'any' OR (v = 'intel' AND (brand ILIKE '%intel%' OR socket ILIKE 'LGA%')) OR (v = 'amd' AND (brand ILIKE '%amd%' OR socket ILIKE 'AM%')))
UNION ALL SELECT 'mobo', 'any', j.* FROM j WHERE form_factor IS NOT NULL AND cpu_cores IS NULL
UNION ALL SELECT 'ram', 'any', j.* FROM j WHERE ram_gb IS NOT NULL AND psu_wattage_w IS NULL AND cpu_cores IS NULL
UNION ALL SELECT 'gpu', v, j.* FROM j, (VALUES ('any'), ('nvidia'), ('amd')) k(v) WHERE gpu_model IS NOT NULL AND (v = 'any' OR (v = 'nvidia' AND (brand ILIKE '%nvidia%' OR gpu_model ILIKE '%rtx%' OR gpu_model ILIKE '%gtx%')) OR (v = 'amd' AND (brand ILIKE '%amd%' OR gpu_model ILIKE '%rx%' OR gpu_model ILIKE '%radeon%')))
UNION ALL SELECT 'storage', 'any', j.* FROM j WHERE storage_gb IS NOT NULL AND cpu_cores IS NULL AND gpu_model IS NULL
UNION ALL SELECT 'psu', 'any', j.* FROM j WHERE psu_wattage_w IS NOT NULL),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, variant ORDER BY price_vnd, id) AS price_rank FROM roles WHERE price_vnd > 0) WHERE price_rank <= 20)"""
_J = "j AS (SELECT p.id, p.brand, p.price_vnd, p.stock_status, s.* FROM products p JOIN specs s ON s.product_id = p.id WHERE status = 'active' AND deleted_at IS NULL)"


def specified(t: Tables):
    return t.products.where(filters.active("shop")).drop("p_size").join(t.specs.drop("p_size"), F.col("id") == F.col("product_id"))


@query(f"WITH {_J}, {_CAND} SELECT category, variant, id, price_vnd, price_rank FROM cand", _P)
def bundle_candidates(t: Tables):
    return bundles.candidate_table(specified(t)).select("category", "variant", "id", "price_vnd", "price_rank")


_SCORE = "round(0.6 * CASE WHEN use_case = 'gaming' AND gpu_vram_gb <> 0 THEN least(1.0, gpu_vram_gb / 12.0) WHEN use_case = 'video_editing' AND cpu_cores <> 0 THEN least(1.0, cpu_cores / 16.0) WHEN use_case = '3d_render' AND gpu_vram_gb <> 0 THEN least(1.0, gpu_vram_gb / 16.0) WHEN use_case = 'office' AND ram_gb <> 0 THEN least(1.0, ram_gb / 32.0) ELSE 0.5 END + 0.3 * least(1.0, CAST(5000000 AS DOUBLE) / price_vnd) + 0.1 * CASE WHEN stock_status = 'in_stock' THEN 1.0 ELSE 0.5 END, 6)"
_ALL = _CAND.split("cand AS (")[0] + "cand AS (SELECT * FROM roles WHERE price_vnd > 0)"
_PICKS = f"""a AS (SELECT *, CASE category WHEN 'cpu' THEN cpu_preference WHEN 'gpu' THEN gpu_preference ELSE 'any' END AS variant FROM alloc),
x AS (SELECT request_id, category, id, price_vnd, CAST({_SCORE} AS DOUBLE) AS score, price_vnd <= category_budget AS fits FROM a JOIN cand USING (category, variant) WHERE price_vnd <= budget_vnd),
picks AS (SELECT request_id, category, p.id, p.price_vnd, p.score, p.misses AS fallback FROM (SELECT request_id, category, min({{'misses': NOT fits, 'first': CASE WHEN fits THEN -score ELSE 0 END, 'price_vnd': price_vnd, 'id': id, 'score': score}}) AS p FROM x GROUP BY 1, 2))"""


@query(f"WITH {_shares()}, {_J}, {_ALL}, {_PICKS} SELECT * FROM picks", "requests products specs")
def bundle_picks(t: Tables):
    """The best of all products of a category and preference within each request's share."""
    return bundles.picks(t.requests, bundles.tagged(specified(t)))


def bundle_items(t: Tables):
    own = t.specs.drop("p_size").withColumnRenamed("product_id", "pid").join(t.products.select(F.col("id").alias("pid"), "price_vnd"), "pid")
    empty = F.array().cast("array<string>")
    return t.bundle_lines.join(own, F.col("product_id") == F.col("pid")).withColumn("id", F.col("product_id")).withColumn("supported_mainboard_form_factors", empty)


_ISS = """i AS (SELECT b.bundle_id, b.product_id AS id, s.*, p.price_vnd FROM bundle_lines b JOIN specs s ON s.product_id = b.product_id JOIN products p ON p.id = b.product_id),
c AS (SELECT * FROM i WHERE cpu_cores <> 0 OR cpu_model <> ''), m AS (SELECT * FROM i WHERE form_factor <> '' AND cpu_cores IS NULL), r AS (SELECT * FROM i WHERE ram_gb > 0 AND form_factor IS NULL AND psu_wattage_w IS NULL),
need AS (SELECT bundle_id, sum(COALESCE(recommended_psu_w, 0)) AS need, bool_or(psu_wattage_w > 0) AS psu FROM i GROUP BY 1),
iss AS (SELECT c.bundle_id, c.id AS a, m.id AS b, 'socket_mismatch' AS rule, 'error' AS severity FROM c JOIN m ON c.bundle_id = m.bundle_id AND c.socket <> m.socket
UNION ALL SELECT r.bundle_id, r.id, m.id, 'ram_type_mismatch', 'error' FROM r JOIN m ON r.bundle_id = m.bundle_id AND r.ram_type <> m.ram_type
UNION ALL SELECT r.bundle_id, r.id, m.id, 'ram_capacity', 'error' FROM r JOIN m ON r.bundle_id = m.bundle_id AND r.ram_gb > m.max_ram_gb
UNION ALL SELECT i.bundle_id, '(build)', i.id, 'psu_underpowered', 'error' FROM i JOIN need ON i.bundle_id = need.bundle_id WHERE psu_wattage_w > 0 AND psu_wattage_w < need + 100
UNION ALL SELECT bundle_id, '(build)', '(build)', 'psu_underpowered', 'warning' FROM need WHERE need > 0 AND NOT COALESCE(psu, false))"""


@query(f"WITH {_ISS} SELECT * FROM iss", "bundle_lines specs products")
def bundle_issues(t: Tables):
    """Broken compatibility rules, an order standing for a bundle."""
    return bundles.issues(bundle_items(t))


@query(f"WITH {_ISS}, e AS (SELECT bundle_id, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings FROM iss GROUP BY 1) SELECT i.bundle_id, count(*) AS n_items, CAST(sum(price_vnd) AS BIGINT) AS total_vnd, CAST(sum(COALESCE(recommended_psu_w, 0)) AS BIGINT) AS power_w, COALESCE(max(n_errors), 0) AS n_errors, COALESCE(max(n_warnings), 0) AS n_warnings, count(*) >= 2 AND COALESCE(max(n_errors), 0) = 0 AS compatible FROM i LEFT JOIN e ON e.bundle_id = i.bundle_id GROUP BY 1", "bundle_lines specs products")
def bundle_evaluation(t: Tables):
    """Counts of each bundle. Every rule reads the items, so they are put together once, as a table in the shared folder."""
    return bundles.evaluate(index.saved(bundle_items(t), f"{shared_folder(t).rstrip('/')}/bundle-items/{uuid.uuid4().hex}"))


@query(f"""WITH {_shares()}, {_J}, {_ALL}, {_PICKS}, o AS (SELECT request_id, category, o.id, CAST({_SCORE} AS DOUBLE) AS score, o.price_vnd FROM alloc JOIN cand o USING (category) JOIN (SELECT request_id, category, id AS chosen FROM picks) USING (request_id, category) WHERE variant = 'any' AND o.price_vnd <= category_budget AND category IN ('gpu', 'cpu') AND o.id <> chosen)
SELECT request_id, category, p.id FROM (SELECT request_id, category, min({{'first': -score, 'price_vnd': price_vnd, 'id': id}}) AS p FROM o GROUP BY 1, 2)""", "requests products specs")
def bundle_alternatives(t: Tables):
    """The best other product of all within the share; it is the first or the second of them."""
    every = bundles.tagged(specified(t))
    return bundles.alternatives(bundles.picks(t.requests, every), bundles.ranked(t.requests, every, 2))


_FLOORED = f"""{_shares()}, {_J}, {_CAND}, rq AS (SELECT *, CASE request_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 12 WHEN 2 THEN 40 WHEN 3 THEN 90 WHEN 4 THEN 2000 END AS ram_min_gb FROM requests),
fl AS (SELECT DISTINCT ram_min_gb FROM rq WHERE ram_min_gb > 0), fc AS (SELECT 'ram' AS category, 'ram>=' || ram_min_gb AS variant, * EXCLUDE (n) FROM (SELECT fl.ram_min_gb, j.*, row_number() OVER (PARTITION BY fl.ram_min_gb ORDER BY price_vnd, id) AS n FROM fl, j WHERE ram_gb IS NOT NULL AND psu_wattage_w IS NULL AND cpu_cores IS NULL AND price_vnd > 0 AND ram_gb >= fl.ram_min_gb) WHERE n <= 20),
c2 AS (SELECT category, variant, id, price_vnd, stock_status, gpu_vram_gb, cpu_cores, ram_gb FROM cand UNION ALL SELECT category, variant, id, price_vnd, stock_status, gpu_vram_gb, cpu_cores, ram_gb FROM fc),
a AS (SELECT alloc.*, CASE category WHEN 'cpu' THEN alloc.cpu_preference WHEN 'gpu' THEN alloc.gpu_preference WHEN 'ram' THEN CASE WHEN ram_min_gb > 0 THEN 'ram>=' || ram_min_gb ELSE 'any' END ELSE 'any' END AS variant FROM alloc JOIN rq USING (request_id)),
x AS (SELECT request_id, category, id, price_vnd, CAST({_SCORE} AS DOUBLE) AS score, price_vnd <= category_budget AS fits FROM a JOIN c2 USING (category, variant) WHERE price_vnd <= budget_vnd),
pin AS (SELECT request_id, 'gpu' AS category, p.id, p.price_vnd FROM requests JOIN products p ON p_partkey = request_id JOIN specs s ON s.product_id = p.id WHERE gpu_model IS NOT NULL AND request_id % 2 = 0),
ch AS (SELECT *, 'pinned' AS kind FROM pin UNION ALL SELECT request_id, category, id, price_vnd, CASE WHEN fits THEN 'fits' ELSE 'cheapest' END FROM (SELECT *, row_number() OVER (PARTITION BY request_id, category ORDER BY fits DESC, CASE WHEN fits THEN -score END, price_vnd, id) AS n FROM x) WHERE n = 1 AND (request_id, category) NOT IN (SELECT request_id, category FROM pin)),
wn AS (SELECT request_id, category, category || ': không tìm thấy sản phẩm' AS warning FROM alloc WHERE (request_id, category) NOT IN (SELECT request_id, category FROM ch) UNION ALL SELECT request_id, category, category || ': vượt budget, chọn rẻ nhất (' || printf('%,d', price_vnd) || ' VND)' FROM ch WHERE kind = 'cheapest')"""


def floored(t: Tables):
    """(choices, warnings) of requests with memory floors and some pinned cards."""
    rows = specified(t)
    floors = bundles.memory_floors(rows)
    least = F.element_at(F.array(F.lit(0), F.lit(12), F.lit(40), F.lit(90), F.lit(2000), F.lit(None).cast("int")), (F.col("request_id") % 6 + 1).cast("int"))
    asked = bundles.with_floors(t.requests.withColumn("ram_min_gb", least), floors)
    cards = parts(t, "gpu").select(F.col("p_partkey").alias("request_id"), F.lit("gpu").alias("category"), "id", "price_vnd")
    pinned = cards.join(t.requests.where("request_id % 2 = 0").select("request_id"), "request_id", "left_semi")
    return bundles.build(asked, bundles.candidate_table(rows).unionByName(bundles.floor_candidates(rows, floors)), pinned)


@query(f"WITH {_FLOORED} SELECT request_id, category, id, price_vnd, kind FROM ch", "requests products specs")
def bundle_choices(t: Tables):
    """What each request gets, with the least memory it wants and what it has pinned."""
    return floored(t)[0]


@query(f"WITH {_FLOORED} SELECT request_id, category, warning FROM wn", "requests products specs")
def bundle_warnings(t: Tables):
    return floored(t)[1]


@query(f"WITH {_FLOORED}, t AS (SELECT request_id, count(*) AS n_items, CAST(sum(price_vnd) AS BIGINT) AS total_vnd FROM ch GROUP BY 1), w AS (SELECT request_id, count(*) AS n_warnings, array_to_string(list(warning ORDER BY category, warning)[1:3], '; ') AS first_warnings FROM wn GROUP BY 1) SELECT request_id, COALESCE(n_items, 0) AS n_items, COALESCE(total_vnd, 0) AS total_vnd, COALESCE(n_warnings, 0) AS n_warnings, COALESCE(first_warnings, '') AS first_warnings FROM t FULL JOIN w USING (request_id)", "requests products specs")
def bundle_summaries(t: Tables):
    out = bundles.summaries(*floored(t))
    return out.withColumn("first_warnings", F.array_join("first_warnings", "; "))


def every_twentieth(t: Tables):
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query()
def cosine_cells(t: Tables):
    """Approximate nearest vectors of every row whose id is divisible by 20.

    These vectors hardly cluster, so 9 of 12 cells are probed for a recall of 0.9 (tested against brute force).
    """
    index, model = search.cell_index(t.embeddings, 12)
    return search.probe_top_k(every_twentieth(t), index, model, 5, 9, shared_folder(t))
