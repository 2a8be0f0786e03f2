"""One registered query per operator: the operator over its whole table, reduced to its result columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, decontam, embeddings, langid, licenses, pii, resample, simhash, suffixes, suffixtree, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.report(_table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.report(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_round_trip, op2_language_id, op3_embedding_near_dedup, op4_chat_formatting, op5_license_scan, op6_suffix_array_dedup, op7_pii_surrogates, op8_toxicity, op9_simhash_near_dedup, op10_decontamination, op11_tokenizer_alignment, op12_lm_scoring, op13_importance_resampling, pipeline)}


_OP3 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS reach FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.reach),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, COALESCE(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id"""


def _op4() -> str:
    def escaped(c: str) -> str:
        out = f"replace({c}, '{chat.ESCAPE}', '{chat.ESCAPE * 2}')"
        for control in chat.CONTROL:
            out = f"replace({out}, '{control}', '{control[0]}{chat.ESCAPE}{control[1:]}')"
        return out

    frame = len(chat.START + chat.MIDDLE + chat.END)
    return f"""WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
 COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
 CAST(sum({frame} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""


_WORDS = "regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP10 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), i AS (SELECT COALESCE(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT item_id, w, least({decontam.WINDOW}, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - {decontam.WINDOW - 1}))) AS k FROM i WHERE len(w) > 0)),
grams AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, p, n, item_id FROM grams JOIN win USING (n, g)),
hw AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS x FROM hit) GROUP BY 1),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)"""


# CRC-32 of each distinct word, byte by byte over a table of 256 remainders.
_OP13 = f"""WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), dw AS (SELECT r, unnest(w) AS x FROM d), bw AS (SELECT unnest({_WORDS}) AS x FROM benchmark),
u AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
b AS (SELECT x, list_transform(range(0, length(h), 2), lambda i: (strpos('0123456789ABCDEF', h[i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 2]) - 1) AS b FROM u),
k AS (SELECT x, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM b, tab),
s AS (SELECT k, count(*) AS n FROM dw JOIN k USING (x) GROUP BY 1), t AS (SELECT k, count(*) AS n FROM bw JOIN k USING (x) GROUP BY 1),
g AS (SELECT k, CAST(floor(1000 * ln((COALESCE(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000) / ((COALESCE(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS gain FROM (SELECT DISTINCT k FROM k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
wt AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN k USING (x) JOIN g USING (k) GROUP BY 1),
sc AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, COALESCE(weight, 0) AS weight, COALESCE(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN wt USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS p, count(*) OVER () * 10 // 100 AS m FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= m THEN p END AS rank FROM sc LEFT JOIN o USING (r)"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are tested against libraries, brute force or held-out accuracy."""
    return {"op3_embedding_near_dedup": _OP3, "op4_chat_formatting": _op4(), "op10_decontamination": _OP10, "op13_importance_resampling": _OP13}
