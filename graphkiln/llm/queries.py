"""The queries of this subpackage: each applies one operator to its whole table; oracles in DuckDB's SQL."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphkiln.llm import bpe, chat, forest, html_text, jaccard, mixing, oracles, pii, quality, sharding, url_filter

#: The shards of the sharding query.
SHARDS = [f"shard-{k:02d}" for k in range(16)]
#: The explicit rules of the URL filter's query: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The session's setting that holds the key of the pseudonyms, and the public key that stands in, with a warning, where it is unset.
PII_KEY, DEMONSTRATION_KEY = "spark.graphkiln.pii.key", "demonstration only"


def pii_key(spark: SparkSession) -> str:
    key = spark.conf.get(PII_KEY, None)
    if not key:
        warnings.warn(f"{PII_KEY} is unset: pseudonyms are made with a public key and can be undone by anyone", stacklevel=2)
    return key or DEMONSTRATION_KEY


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "n_blocks")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark), report="replaced")
    return changed.select("doc_id", "text", F.size("replaced").alias("n_replaced"), F.transform("replaced", lambda x: F.concat_ws(":", x["kind"], x["value"])).alias("replaced"))


def op5_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source", [5, 2, 1])
    return taken.select("_row.doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number its path ends in; that document's labels are the page's."""
    page = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})[^/0-9]*/?$", 1).try_cast("long")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_page"), good.alias("good"))
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), labels, RULES, page=page)
    return judged.select("page_id", "host", "path", "template", "rule", "verdict")


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=85)


_ALL = (op1_html_text, op2_quality_rules, op3_byte_bpe, op4_pii_pseudonyms, op5_embedding_forest, op6_sharding, op7_source_mixing, op8_url_filter, op9_quote_linking, op10_ngram_jaccard)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {
    "op2_quality_rules": oracles.quality_rules(),
    "op5_embedding_forest": oracles.embedding_groups(),
    "op6_sharding": oracles.sharding(SHARDS),
    "op7_source_mixing": oracles.source_mixing(),
    "op10_ngram_jaccard": oracles.jaccard_groups(),
}
