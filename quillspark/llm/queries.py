"""The queries of the numbered operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, html_text, langid, lexical, lz, mixing, neardup, secrets, spelling, substring, topk, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = substring.dedup_passages(docs, window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return neardup.near_duplicates(docs, k=3, percent=85)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """tokenizer: path of a byte-level BPE file."""
    return bpe.token_report(documents(spark, sf_dir), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.fingerprint_report(documents(spark, sf_dir).select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_report(documents(spark, sf_dir).select("doc_id", "text"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_chat": op2_chat,
    "op3_topk": op3_topk,
    "op4_html": op4_html,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_fingerprints": op7_fingerprints,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
    "op11_spelling": op11_spelling,
    "op12_secrets": op12_secrets,
    "op13_search": op13_search,
}
SQL = {"op1_mixing": mixing.SQL, "op3_topk": topk.SQL, "op8_substring_dedup": substring.SQL, "op10_near_dedup": neardup.SQL, "op11_spelling": spelling.SQL, "op12_secrets": secrets.SQL, "op13_search": lexical.SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
