"""Corpus pipeline: known languages, one of each near copy, no benchmark text, no personal data, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is
written as Parquet and read again before the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm import bpe, common, decontam, langid, pii, simhash

#: Key of the surrogates; a deployment passes its own secret.
SURROGATE_KEY = "surrogates of the corpus pipeline"
TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a likely language go."""
    return langid.keep_known(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark passages go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; ``n_chars`` follows the new text."""
    done = pii.replace(docs, SURROGATE_KEY)
    return done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens, and whether decoding gives the text back."""
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path), path)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("pii_surrogates", pii_surrogates),
    ("bpe_tokens", bpe_tokens),
]

#: Fingerprints, trained models and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
