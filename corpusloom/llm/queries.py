"""The thin opN_<name> queries: each applies one operator to its whole table."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, license_scan, ngram_join, oracles, packing, pii, quality, ranked_search, secret_scan, token_counts, toxicity, url_filter, vector_codes


def tokenizer_file(name: str) -> str:
    """A public vocabulary file; ``CORPUSLOOM_TOKENIZERS`` names another folder."""
    if folder := os.environ.get("CORPUSLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(table(spark, sf_dir, "documents"))
    return rows.withColumn("failed_fences", F.array_join("failed_fences", ","))


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op8_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = token_counts.with_sample_edits(table(spark, sf_dir, "documents"))
    return token_counts.count_with_edits(documents, tokenizer_file("byte_bpe_50k.json"))


@cache
def own_key() -> str:
    """A key that lasts as long as this process."""
    return secrets.token_hex(32)


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``CORPUSLOOM_PII_KEY`` has the key; without one, values are linked
    within what this process writes."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), os.environ.get("CORPUSLOOM_PII_KEY") or own_key())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.license_scan(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


OPERATORS = (
    op1_pack_documents, op2_quality_rules, op3_bpe_encode_decode, op4_exact_dedup, op5_secret_scan, op6_url_filter, op7_ngram_jaccard_join,
    op8_edit_token_counts, op9_pii_pseudonyms, op10_toxicity, op11_ranked_search, op12_license_scan, op13_vector_codes,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = oracles.ORACLES
