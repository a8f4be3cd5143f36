"""The corpus operators as queries over whole tables, with SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graincart.llm import oracle
from graincart.llm.common import table
from graincart.llm.decontamination import contamination_digests
from graincart.llm.html import extract
from graincart.llm.langid import language_digests
from graincart.llm.licenses import license_digests
from graincart.llm.media import media_digests
from graincart.llm.minhash import near_duplicates
from graincart.llm.mixing import mix
from graincart.llm.pii import personal_data_digests
from graincart.llm.quality import quality_digests
from graincart.llm.secrets import secret_digests
from graincart.llm.toxicity import toxicity_digests
from graincart.llm.trie import prefix_trie
from graincart.llm.whitening import whiten


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_digests(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return secret_digests(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that stand in a benchmark item."""
    return contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that every document names."""
    return license_digests(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    return quality_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that the mix takes."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document."""
    return personal_data_digests(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a progressive JPEG file and read back."""
    return media_digests(table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near copies of every document, at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, and its nearest labelled examples."""
    return toxicity_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secrets": op2_secrets,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_media": op8_media,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_toxicity": op12_toxicity,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op2_secrets": oracle.secrets_sql(),
    "op3_decontamination": oracle.CONTAMINATION,
    "op6_mixing": oracle.MIX,
    "op9_minhash_dedup": oracle.NEAR,
    "op11_prefix_trie": oracle.TRIE,
}
