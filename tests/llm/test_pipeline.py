from __future__ import annotations

import base64
from array import array
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from graphkiln.llm import mixing, pii, quality, queries
from tests_support import brute_groups

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against its own operator or brute force, on what the stage before kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_weights", "tokens"]
    kept = corpus_pipeline.quality_rules(spark, docs, SMALL).collect()
    judged = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert sorted(r.doc_id for r in kept) == sorted(k for k, ok in judged.items() if ok)

    docs = spark.createDataFrame(kept, docs.schema)
    one = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    groups = brute_groups([(r.doc_id, r.text) for r in kept], 5, 80)
    assert sorted(r.doc_id for r in one) == sorted(i for i, g in groups.items() if i == g)

    docs = spark.createDataFrame(one, docs.schema)
    clean = corpus_pipeline.personal_data(spark, docs, SMALL)
    assert clean.columns == given.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts == {r.doc_id: r.text for r in pii.pseudonymise(docs, queries.pii_key(spark)).collect()}

    mixed = corpus_pipeline.source_weights(spark, clean, SMALL).collect()
    copies = {r.doc_id: r._copies for r in mixing.copies(clean, "doc_id", "text", "source", [5, 2, 1]).select("_row.doc_id", "_copies").collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({k: n for k, n in copies.items() if n})

    out = corpus_pipeline.tokens(spark, spark.createDataFrame(mixed, docs.schema), SMALL).collect()
    assert len(out) == len(mixed)
    for r in out:
        assert array("I", bytes(r.ids)).tolist() == LIBRARY.encode_ordinary(texts[r.doc_id])

    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in out)


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs, SMALL).schema)
        assert docs.count() == 0


def test_all_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
