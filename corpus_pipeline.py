"""A training corpus from ``documents``: quality rules, near duplicates, personal data, source weights, tokens.

Every stage takes and returns a DataFrame that is written as Parquet to the shared folder and read again in between.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphkiln.llm import bpe, jaccard, mixing, pii, quality
from graphkiln.llm.common import materialize
from graphkiln.llm.queries import pii_key

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose text is far from every reference language go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by five-word shingles at a Jaccard similarity of 0.8, the smallest id stays."""
    return jaccard.keep_one(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the text."""
    changed = pii.pseudonymise(docs, pii_key(spark))
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned out towards the weights 5, 2, 1, at most three epochs each."""
    return mixing.mix(docs, cycle=[5, 2, 1], max_epochs=3)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with their digest and that of their decoding."""
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids="ids")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_weights", source_weights),
    ("tokens", tokens),
]
#: SQL has no byte-pair encoding and no Feistel network; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
