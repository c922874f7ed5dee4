"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import quality_gam, toxicity
from folioforge.llm.bpe_codec import bpe_digests
from folioforge.llm.common import read_table
from folioforge.llm.exact_dedup import exact_dedup
from folioforge.llm.mixing import mix_counts
from folioforge.llm.quality_rules import quality_rules
from folioforge.llm.secret_scan import secret_scan
from folioforge.llm.simhash import simhash_components
from folioforge.llm.substring_dedup import substring_dedup
from folioforge.llm.token_file import token_digests

_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, read_table(spark, sf_dir, "labels")))


def op5_token_file(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Ids of every document, written as coded blocks and read back."""
    return token_digests(read_table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents; the largest id stays."""
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def op10_bpe_codec(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Ids and round trip of every document with the byte-level tokenizer."""
    return bpe_digests(read_table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 35 words that occur more than once, removed from all documents."""
    return substring_dedup(read_table(spark, sf_dir, "documents"), window=35)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; the source stands for the owner, source and language for the repository."""
    return secret_scan(read_table(spark, sf_dir, "documents"), repository=["source", "lang"], owner="source")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_counts(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdict for every document; documents labelled good are the trusted target."""
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    judged = quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return judged.select("doc_id", "_quality.*")


QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op5_token_file": op5_token_file,
    "op6_toxicity": op6_toxicity,
    "op10_bpe_codec": op10_bpe_codec,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_mix_sources": op4_mix_sources,
    "op7_quality_rules": op7_quality_rules,
    "op2_exact_dedup": op2_exact_dedup,
}

ORACLE_SQL = {
    "op2_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {_A_Z}) AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}
