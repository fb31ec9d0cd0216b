"""Documents: Markdown from pages, chunks, corpus preparation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.functions import markdown
from graphkiln.functions import text as t
from graphkiln.functions.ship import ship


def to_markdown(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, markdown)"""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "title": pdf["html"].map(markdown.html_title), "markdown": pdf["html"].map(markdown.html_to_markdown)})

    kind = dict(pages.dtypes)[key]
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return rows.mapInPandas(run, f"key {kind}, title string, markdown string").withColumnRenamed("key", key)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", strategy: str = "section", most: int = 100, overlap: int = 20, least: int = 15) -> DataFrame:
    """(key, chunk_id, chunk_index, section, text), one row a chunk."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, f"{k}_{i}", i, path, part) for k, x in zip(pdf["key"], pdf["text"], strict=True) for i, path, part in markdown.chunk(x, strategy, most, overlap, least)]
            yield pd.DataFrame(rows, columns=["key", "chunk_id", "chunk_index", "section", "text"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, chunk_id string, chunk_index int, section string, text string").withColumnRenamed("key", key)


def parts(docs: DataFrame, split: Callable[[str], list[tuple[str, str]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, path, body): what a function makes of each whole text, numbered from 0; null texts have no parts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, path, body) for k, x in zip(pdf["key"], pdf["text"], strict=True) for i, (path, body) in enumerate(split(x) if x else [])]
            yield pd.DataFrame(rows, columns=["key", "part", "path", "body"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, part int, path string, body string").withColumnRenamed("key", key)


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, path, body): Markdown sections by their headings' path."""
    return parts(docs, markdown.sections, key, text)


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, body): Markdown blocks."""
    return parts(docs, lambda x: [("", b) for b in markdown.blocks(x)], key, text).drop("path")


def split_content(docs: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, body): parts of at most ``most`` characters."""
    return parts(docs, lambda x: [("", b) for b in markdown.split_by_chars(x, most)], key, text).drop("path")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, body)"""
    return parts(docs, lambda x: [("", b) for b in markdown.sentences(x)], key, text).drop("path")


def token_windows(docs: DataFrame, key: str, text: str, most: int, overlap: int) -> DataFrame:
    """(key, start, tokens): windows of tokens in the JVM."""
    rows = docs.select(key, t.tokens(F.col(text)).alias("all")).filter("size(all) > 0")
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(most - overlap))
    return rows.select(key, "all", F.explode(starts).alias("start")).select(key, "start", F.slice("all", F.col("start") + 1, most).alias("tokens"))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), ""))


def label_hits(text: Column, rules: dict[str, list[str]]) -> Column:
    """The labels with a keyword in the (space-padded) text."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    tests = []
    for label, keywords in rules.items():
        found = F.lit(False)
        for k in keywords:
            found = found | padded.contains(k)
        tests.append(F.when(found, label))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def keyword_counts(text: Column, rules: dict[str, list[str]], points: int = 5) -> Column:
    """map group -> points for every keyword found."""
    pairs = []
    for group, keywords in rules.items():
        n = F.lit(0)
        for k in keywords:
            n = n + text.contains(k).cast("int")
        pairs += [F.lit(group), n * points]
    return F.create_map(*pairs)


def doc_score(n_labels: Column, best_group: Column, n_related: Column, n_structure: Column, n_words: Column, has_table: Column, has_contact: Column, has_title: Column, noise: Column) -> Column:
    flag = lambda x: F.when(x, 5).otherwise(0)
    return 8.0 * n_labels + best_group + 3 * F.least(n_related, F.lit(10)) + 3 * F.least(n_structure, F.lit(8)) + F.least(n_words / 20.0, F.lit(20.0)) + flag(has_table) + flag(has_contact) + flag(has_title) - noise


#: Traces of a removed metadata block.
LEAKS = ("**URL**:", "**Source**:", "**Date**:", "**Author**:")


def metadata_leak(text: Column) -> Column:
    found = F.coalesce(text, F.lit("")).rlike(r"(?im)^##\s+metadata\s*$")
    for mark in LEAKS:
        found = found | F.coalesce(text, F.lit("")).contains(mark)
    return found


def strip_metadata(text: Column) -> Column:
    """Without the section '## Metadata' and its list."""
    return F.trim(F.regexp_replace(text, r"(?ms)^##\s+Metadata\s*\n(?:\s*\n|\s*- \*\*[^\n]*\n?)*", ""))


def parse_metadata(text: Column) -> Column:
    """map of the block's '- **Key**: value' lines."""
    line = r"(?m)^- \*\*([^*]+)\*\*: *(.*)$"
    keys, values = F.regexp_extract_all(text, F.lit(line), F.lit(1)), F.regexp_extract_all(text, F.lit(line), F.lit(2))
    return F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: x["k"].isNotNull()))


def reject_reason(n_words: Column, leak: Column, n_labels: Column, least: int = 80) -> Column:
    return F.when(n_words == 0, "empty").when(n_words < least, "too_short").when(leak, "metadata_leftover").when(n_labels == 0, "no_ontology_match")


def quota_select(candidates: DataFrame, quotas: dict[str, int], target: int) -> DataFrame:
    """The accepted documents: per group its best up to the quota, then the best of all up to ``target``; equal fingerprints count once.

    candidates: id, grp, score, words, fingerprint. Equal fingerprints are reduced to their best document first, so windows
    give the acceptance and nothing is collected.
    """
    best = ["score", "words"]
    order = [*(F.desc(c) for c in best), F.col("id")]
    one = candidates.withColumn("_d", F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order))).filter("_d = 1")
    quota = F.lit(0)
    for grp, n in quotas.items():
        quota = F.when(F.col("grp") == grp, n).otherwise(quota)
    one = one.withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).withColumn("by_quota", F.col("_r") <= quota)
    chosen = one.filter("by_quota").select("id", "grp", F.lit("quota").alias("reason"), *best)
    left = one.filter("NOT by_quota").orderBy(*order).limit(target).select("id", "grp", F.lit("fill").alias("reason"), *best)
    every = chosen.unionByName(left)
    rank = Window.orderBy((F.col("reason") == "fill").cast("int"), *order)
    return every.orderBy((F.col("reason") == "fill").cast("int"), *order).limit(target).withColumn("place", F.row_number().over(rank))


def cluster_by_name(names: DataFrame, least: float = 0.3) -> DataFrame:
    """(name, cluster): in name order, a name joins the cluster whose growing token set is most similar, if similar enough.

    Sequential by definition: each step depends on the sets so far; the input is a list of file names.
    """
    ship(names.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import re

        sets: list[set[str]] = []
        out = []
        for name in sorted(pdf["name"]):
            words = {w for w in re.split(r"[^a-z]+", name.rsplit(".", 1)[0].lower()) if w}
            share = [(len(words & s) / len(words | s) if words or s else 1.0) for s in sets]
            best = max(range(len(sets)), key=lambda k: (share[k], -k), default=None)
            if best is None or share[best] < least:
                best = len(sets)
                sets.append(set())
            sets[best] |= words
            out.append((name, best))
        return pd.DataFrame(out, columns=["name", "cluster"])

    return names.select("name").groupBy(F.lit(1).alias("_all")).applyInPandas(lambda pdf: run(pdf[["name"]]), "name string, cluster int")
