"""The registered queries of the document operators: whole tables in, the contract's columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.llm.bpe import encode_documents
from groundswell.llm.common import read, text_or_empty
from groundswell.llm.exact_dedup import exact_dedup
from groundswell.llm.license_scan import license_scan
from groundswell.llm.mixing import mix_sources
from groundswell.llm.near_dedup import near_dedup
from groundswell.llm.perplexity import perplexity_filter
from groundswell.llm.quality_rules import quality_rules
from groundswell.llm.sharding import shard_documents
from groundswell.llm.substring_dedup import substring_dedup
from groundswell.llm.toxicity import held_out, toxicity


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha256")).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), keep=("doc_id",), ids=False)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("bucket")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), words=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_dedup(docs, carry={"text_sha256": F.unhex(F.sha2(text_or_empty(), 256))})
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_sha256")).alias("text_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexity_filter(docs, read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}
