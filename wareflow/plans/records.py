"""Queries over pages, texts, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareflow.functions import security, specs, text, urls
from wareflow.operators import logs, modeloutput
from wareflow.sources import files, links, pages

from .registry import Tables, query

_HOST, _PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)", "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_CANON = f"""SELECT page_id, url, 'https://' || lower(h) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS source_url FROM (
SELECT page_id, url, {_HOST} AS h, regexp_replace({_PATH}, '/{{2,}}', '/', 'g') AS p,
list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT list_contains(['srsltid', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid'], string_split(x, '=')[1])) AS q FROM pages)"""


@query(f"SELECT page_id, source_url FROM ({_CANON})")
def canonical_urls(t: Tables):
    return t.pages.select("page_id", urls.canonical(F.col("url")).alias("source_url"))


@query(f"SELECT page_id, ends_with(lower({_PATH}), '.html') AS product, regexp_matches({_PATH}, '(?i)/blog/|/search|/tag/') AS excluded, lower({_HOST}) AS host FROM pages")
def url_classes(t: Tables):
    u = F.col("url")
    return t.pages.select("page_id", urls.is_product_page(u).alias("product"), urls.is_excluded(u).alias("excluded"), urls.host(u).alias("host"))


@query(f"SELECT page_id, substr(sha1(url), 1, 12) || '_' || substr(CASE WHEN n = '' THEN 'index' ELSE n END, 1, 80) AS cache_key FROM (SELECT page_id, url, regexp_replace(regexp_replace({_PATH}, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS n FROM pages)")
def page_keys(t: Tables):
    return t.pages.select("page_id", urls.cache_key(F.col("url")).alias("cache_key"))


@query(f"SELECT DISTINCT source_url FROM ({_CANON}) WHERE source_url NOT IN (SELECT source_url FROM ({_CANON}) WHERE page_id % 3 = 0)")
def pages_selection(t: Tables):
    """Pages still to process, a third of them being done."""
    own = t.pages.select("page_id", F.col("url").alias("source_url"), F.lit("other").alias("category"))
    done = own.where("page_id % 3 = 0").select(urls.canonical(F.col("source_url")).alias("source_url"))
    return links.pages_to_crawl(own, done, ["cpu"]).select("source_url")


@query("SELECT page_id, url, len(regexp_extract_all(html, '<script')) AS n_scripts FROM pages")
def page_scripts(t: Tables):
    """Markup scan of every page: number of script elements."""
    raw = pages.script_counts(t.pages)
    return t.pages.select("page_id", "url").join(raw.dropDuplicates(), "url").select("page_id", "url", F.col("n_scripts").cast("long").alias("n_scripts"))


@query()
def page_records(t: Tables):
    """Product records of the pages (rows only: markup has no SQL form)."""
    return pages.records(pages.extract(t.pages)).select("source_url", "name", "category", "price_vnd", "stock_status")


@query("SELECT doc_id, sha256(replace(strip_accents(lower(trim(regexp_replace(text, '[\\s\\x0b\\x85\\x{a0}]+', ' ', 'g')))), 'đ', 'd')) AS folded FROM documents")
def text_folding(t: Tables):
    return t.documents.select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded"))


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN contains(x, 'hat') THEN 'hat' WHEN contains(x, 'tion') THEN 'tion' ELSE 'other' END AS category FROM (SELECT strip_accents(lower(text)) AS x FROM documents)) GROUP BY 1")
def category_inference(t: Tables):
    """Ordered phrase rules, with two made-up categories that these texts can have."""
    return t.documents.select(text.category(F.col("text"), {"hat": ["hat"], "tion": ["tion"]}).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '-?\\d+(?:[.,]\\d+)?', 0) AS DOUBLE) AS k, CAST(floor(length(props) / 4) AS BIGINT) AS tokens FROM events")
def number_extraction(t: Tables):
    return t.events.select("event_id", text.first_number(F.col("props")).alias("k"), text.tokens_estimate(F.col("props")).alias("tokens"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size WHEN 2 THEN CAST(round_even(p_size / 1024.0, 0) AS INT) END AS gb, CASE WHEN p_size % 2 = 0 THEN 'DDR4' ELSE 'DDR5' END AS ram FROM part")
def spec_parsing(t: Tables):
    """Capacities with units and memory types out of text."""
    unit = F.element_at(F.array(F.lit("TB"), F.lit("GB"), F.lit("MB"), F.lit("pcs")), F.col("p_size") % 4 + 1)
    line = F.concat(F.col("p_size").cast("string"), F.lit(" "), unit, F.lit(" DDR"), (F.col("p_size") % 2 + 4).cast("string"))
    return t.part.select("p_partkey", specs.capacity_gb(line).alias("gb"), specs.ram_type(line).alias("ram"))


@query("SELECT category, key, n, pct FROM (SELECT p_type AS category, 'size' AS key, count(*) AS n, 100.0 AS pct FROM part GROUP BY 1 UNION ALL SELECT p_type, 'big', count(*) FILTER (WHERE p_size > 25), round(100.0 * count(*) FILTER (WHERE p_size > 25) / count(*), 2) FROM part GROUP BY 1)")
def schema_audit(t: Tables):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    raw = F.array_compact(F.array(pair("size", F.col("p_size")), F.when(F.col("p_size") > 25, pair("big", F.col("p_size")))))
    rows = t.part.select(F.col("p_type").alias("category"), F.col("p_partkey").alias("row_order"), raw.alias("raw_specs"))
    return modeloutput.audit(rows).drop("samples")


@query("SELECT event_id, CAST(regexp_extract(props, '\\d+', 0) AS INT) AS ram_gb, CASE WHEN event_type = 'view' THEN 'laptop' ELSE 'other' END AS category, CASE WHEN value > 100 THEN 1.0 ELSE value / 100 END AS confidence, CASE WHEN value / 100 < 0.7 THEN 1 ELSE 0 END + CASE WHEN event_type = 'view' THEN 2 ELSE 0 END + CASE WHEN CAST(regexp_extract(props, '\\d+', 0) AS INT) <= 0 THEN CASE WHEN event_type = 'view' THEN 2 ELSE 1 END ELSE 0 END AS n_warnings FROM events")
def model_output(t: Tables):
    """Noisy responses to typed specifications with their warnings."""
    kind = F.when(F.col("event_type") == "view", "laptop").otherwise("kettle")
    reply = F.concat(F.lit('Here: ```json\n{"category": "'), kind, F.lit('", "ram_gb": "'), F.get_json_object("props", "$.k"), F.lit(' GB", "confidence": '), (F.col("value") / 100).cast("string"), F.lit("}\n``` ok"))
    rows = t.events.select("event_id", modeloutput.normalise(modeloutput.json_object(reply), F.lit("other")).alias("spec"))
    return rows.select("event_id", "spec.ram_gb", "spec.category", "spec.confidence", F.size(modeloutput.warnings(F.col("spec"), F.lit(0))).alias("n_warnings"))


_MASK = "regexp_replace(regexp_replace(regexp_replace({c}, '(?:84|0[3|5|7|8|9])+([0-9]{8})\\b', '[REDACTED]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED]', 'g'), '\\bsk-[A-Za-z0-9-]{16,}\\b', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, sha256({_MASK.replace('{c}', 'text')}) AS masked FROM documents")
def log_masking(t: Tables):
    return t.documents.select("doc_id", F.sha2(security.mask(F.col("text")), 256).alias("masked"))


@query(f"SELECT conv_id, max(turn) AS turn, {_MASK.replace('{c}', 'arg_max(text, turn)')} AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def last_user_message(t: Tables):
    return logs.masked_last_user(t.conversations)


@query("SELECT conv_id, count(*) AS n_turns, string_agg(CASE WHEN role = 'tool' THEN '[tool result: ' || text || ']' ELSE role || ': ' || text END, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def transcripts(t: Tables):
    return logs.transcripts(t.conversations)


@query("SELECT CAST(ts AS DATE) AS day, CAST(sum(tok) AS BIGINT) AS tokens, count(*) AS requests, CAST(floor(sum(tok) * 100 / 2000000) AS BIGINT) AS percent, floor(sum(tok) * 100 / 2000000) >= 80 AS alert, floor(sum(tok) * 100 / 2000000) >= 100 AS killed FROM (SELECT ts, CAST(regexp_extract(props, '\\d+', 0) AS BIGINT) * 200 AS tok FROM events) WHERE tok > 0 GROUP BY 1")
def daily_usage(t: Tables):
    return logs.daily_usage(t.events.select("ts", (F.get_json_object("props", "$.k").cast("long") * 200).alias("tokens")))


@query("SELECT route, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'search' WHEN 'purchase' THEN 'build' ELSE 'answer' END AS route FROM events) GROUP BY 1")
def intent_routes(t: Tables):
    intent = F.when(F.col("event_type") == "view", "product_search").when(F.col("event_type") == "purchase", "build_pc").otherwise(F.col("event_type"))
    return t.events.select(logs.route(intent).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT user_id AS step_id, event_type AS step_type, min(ts) AS t0 FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2), e AS (SELECT user_id AS step_id, min(ts) AS t1 FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT step_id, step_type, 'completed' AS status, CAST(floor((epoch_us(t1) - epoch_us(t0)) / 1000) AS BIGINT) AS duration_ms FROM s JOIN e USING (step_id)")
def step_durations(t: Tables):
    kind = F.when(F.col("event_type").isin("view", "click"), "start").when(F.col("event_type") == "purchase", "end")
    rows = t.events.select(F.col("user_id").alias("step_id"), F.col("event_type").alias("step_type"), kind.alias("event"), F.lit("completed").alias("status"), "ts")
    return logs.step_durations(rows)


@query("SELECT a.event_id AS span_id, a.event_id - 1 AS parent_id, b.event_type AS parent_name, a.event_type AS name FROM events a LEFT JOIN events b ON b.event_id = a.event_id - 1")
def span_tree(t: Tables):
    spans = t.events.select(F.col("event_id").alias("span_id"), (F.col("event_id") - 1).alias("parent_id"), F.col("event_type").alias("name"), F.col("ts").alias("t0"), F.col("ts").alias("t1"))
    return logs.span_tree(spans).drop("duration_ms")


@query("SELECT lang, count(*) AS n, round(avg(0.4 * quality + 0.3 * (1 - toxic) + 0.2 * quality + 0.1 * CASE WHEN n_chars > 500 THEN 1 ELSE 0 END), 6) AS score FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def eval_scores(t: Tables):
    rows = t.labels.join(t.documents, "doc_id").select("lang", F.col("quality").alias("correct"), (1 - F.col("toxic")).alias("citation"), F.col("quality").alias("refusal"), (F.col("n_chars") > 500).cast("int").alias("latency"))
    return logs.eval_scores(rows, "lang")


@query("SELECT user_id, event_type, min(event_id) AS position FROM events GROUP BY 1, 2")
def citation_dedupe(t: Tables):
    rows = t.events.select(F.col("user_id").alias("answer_id"), F.lit("p").alias("product_id"), F.lit("s").alias("slug"), F.col("event_type").alias("claim"), F.col("event_id").alias("position"))
    return logs.dedupe_citations(rows).select(F.col("answer_id").alias("user_id"), F.col("claim").alias("event_type"), "position")


@query("SELECT drop_reason, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'missing_name' WHEN user_id = 0 THEN 'missing_id' WHEN event_id % 10 = 3 THEN 'invalid_args' END AS drop_reason FROM events) GROUP BY 1")
def tool_call_cleaning(t: Tables):
    calls = t.events.select(F.when(F.col("user_id") != 0, F.col("user_id").cast("string")).alias("id"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("name"), F.when(F.col("event_id") % 10 == 3, F.lit("{oops")).otherwise(F.col("props")).alias("args"))
    return logs.clean_tool_calls(calls).groupBy("drop_reason").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, {_MASK.replace('{c}', 'url')} AS target, octet_length(encode(html)) AS response_bytes FROM pages")
def audit_rows(t: Tables):
    return logs.audit_rows(t.pages.select("page_id", F.col("url").alias("target"), F.col("html").alias("response")))


@query()
def user_hashes(t: Tables):
    """Keyed hashes of users (tested against Python's HMAC)."""
    return t.events.select("user_id").distinct().select("user_id", security.user_hash(F.col("user_id"), "salt").alias("user_hash"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_payload(t: Tables):
    """The latest record of each key."""
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents WHERE text <> ''")
def dense_index(t: Tables):
    return files.dense_index(t.documents.where("text <> ''").select("doc_id"), F.col("doc_id"), 16).select("doc_id", "row_index")
