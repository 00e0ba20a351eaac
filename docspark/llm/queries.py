"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import common, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, packing, pii, source_divergence, token_counts, token_files, toxicity, url_filter, vector_codes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.hosts_with_words(pages))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/docspark/{uuid.uuid4().hex}/token-files"
    token_files.write(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, path)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    judged = toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return judged.select("doc_id", (~toxicity.learnable()).alias("held_out"), "score", "predicted", "evidence")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = language_id.held_out()
    judged = language_id.identify(docs, language_id.train(docs.where(~held_out)))
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_repeated_lines(_read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_read(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_url_filter, op3_best_fit_packing, op4_exact_dedup, op5_token_files, op6_ngram_jaccard,
        op7_toxicity, op8_token_counts, op9_decontamination, op10_language_id,
        op11_line_dedup, op12_vector_codes, op13_source_divergence,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_url_filter": url_filter.ORACLE_SQL, "op4_exact_dedup": exact_dedup.ORACLE_SQL, "op6_ngram_jaccard": jaccard_join.ORACLE_SQL}
ORACLE_SQL |= {"op11_line_dedup": line_dedup.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL, "op13_source_divergence": source_divergence.ORACLE_SQL}
