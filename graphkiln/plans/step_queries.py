"""Queries of steps around models, pages and files; files are written from the tables and read back."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphkiln.functions.cut import shared_folder
from graphkiln.operators import steps
from graphkiln.sources import files, star
from graphkiln.sources.star import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: The similarity of two names NATION_x and NATION_y, x and y of one or two digits: their longest common subsequence in DuckDB's SQL.
DIGITS = "CASE WHEN x = y THEN length(x) WHEN contains(x, y) OR contains(y, x) THEN 1 WHEN list_has_any(string_split(x, ''), string_split(y, '')) THEN 1 ELSE 0 END"
NAMES = f"p AS (SELECT a.n_regionkey AS cluster, a.n_nationkey AS a, b.n_nationkey AS b, substr(a.n_name, 8) AS x, substr(b.n_name, 8) AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey), s AS (SELECT cluster, a, b, round(100.0 * 2 * (7 + {DIGITS}) / (14 + length(x) + length(y))) / 100 AS sim FROM p)"


def _nations(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array().cast("array<string>").alias("aliases"))


@query(f"WITH {NAMES} SELECT cluster, a, b, sim AS name_sim FROM s")
def name_similarity(spark, d) -> DataFrame:
    return steps.similar_names(_nations(spark, d), 0.0).select("cluster", "a", "b", "name_sim")


@query(f"WITH {NAMES} SELECT cluster, a, b, sim AS name_sim FROM s WHERE sim >= 0.9")
def name_pairs(spark, d) -> DataFrame:
    return steps.similar_names(_nations(spark, d), 0.9).select("cluster", "a", "b", "name_sim")


@query("SELECT s_nationkey AS cluster, s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_nationkey, floor(s_acctbal / 1000)) AS part FROM supplier")
def split_person(spark, d) -> DataFrame:
    """Persons of a nation who share their only alias are one; names here are too unlike to count."""
    name = F.left(F.sha2(F.col("s_suppkey").cast("string"), 256), F.lit(32))
    alias = F.floor(F.col("s_acctbal") / 1000).cast("string")
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("cluster"), F.col("s_suppkey").alias("id"), name.alias("name"), F.array(alias).alias("aliases"))
    return steps.split_persons(rows)


@query(f"WITH {NAMES} SELECT n_regionkey AS cluster, coalesce(bool_and(sim >= 0.9), true) AS unit_ok FROM nation LEFT JOIN s ON cluster = n_regionkey GROUP BY n_regionkey")
def validate_org_unit(spark, d) -> DataFrame:
    return steps.units_hold(_nations(spark, d))


@query(f"WITH {NAMES}, ok AS (SELECT n_regionkey AS cluster, coalesce(bool_and(sim >= 0.9), true) AS ok, min(n_nationkey) AS f FROM nation LEFT JOIN s ON cluster = n_regionkey GROUP BY n_regionkey) SELECT n_regionkey AS cluster, n_nationkey AS id, CASE WHEN ok THEN f ELSE n_nationkey END AS part FROM nation JOIN ok ON cluster = n_regionkey")
def split_org(spark, d) -> DataFrame:
    return steps.split_units(_nations(spark, d))


TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
SHORT = "CASE WHEN length(" + TRIM + ") <= {n} THEN " + TRIM + r" ELSE regexp_replace(left(" + TRIM + r", {n} - 1), '\s+$', '') || '…' END"


def short(x: str, n: int) -> str:
    return SHORT.replace("{x}", x).replace("{n}", str(n))


@query(f"WITH l AS (SELECT source, list(text ORDER BY doc_id) AS l FROM documents WHERE text IS NOT NULL GROUP BY source), j AS (SELECT source, array_to_string(list_concat(list_transform(list_filter(l[1:8], lambda x: regexp_replace(x, '\\s+', '', 'g') <> ''), lambda x: {short('x', 600)}), CASE WHEN len(l) > 8 THEN ['... (' || (len(l) - 8) || ' more items omitted)'] ELSE [] END), ', ') AS t FROM l) SELECT source, {short('t', 4000)} AS evidence FROM j")
def stringify_evidence(spark, d) -> DataFrame:
    """The texts of each source as one evidence text: the first ones and how many there are, without gathering the others."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("source", "doc_id", "text")
    ends = docs.groupBy("source").agg(F.count("*").alias("n"))
    first = docs.select("source", "doc_id").groupBy("source", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("doc_id")), 1, steps.ITEMS).alias("ids"))
    first = first.groupBy("source").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, steps.ITEMS).alias("ids")).select("source", F.explode("ids").alias("doc_id"))
    shown = docs.join(first, ["source", "doc_id"]).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    rows = shown.join(ends, "source")
    return rows.select("source", steps.evidence_list(F.transform("x", lambda x: x["text"]), F.col("n")).alias("evidence"))


@query("SELECT o_orderkey, concat_ws(chr(10), '- **ID**: ' || o_orderkey, '- **Type**: order', '- **Status**: ' || o_orderstatus, CASE WHEN o_custkey % 3 = 0 THEN '- **Author**: c' || o_custkey ELSE '- **Author ID**: ' || o_custkey END, CASE WHEN o_orderkey % 4 <> 0 THEN '- **Parent ID**: ' || (o_orderkey % 4) END, CASE WHEN o_orderstatus <> 'F' THEN '- **Tags**: ' || o_orderstatus END) AS section FROM orders")
def metadata_section(spark, d) -> DataFrame:
    named = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    fields = {"id": F.col("o_orderkey"), "type": F.lit("order"), "status": F.col("o_orderstatus"), "author_name": named, "author": F.col("o_custkey"), "parent": F.col("o_orderkey") % 4, "tags": F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))}
    return table(spark, d, "orders").select("o_orderkey", steps.metadata_section(fields).alias("section"))


@query("SELECT page_id, CASE WHEN contains(html, '</article>') THEN regexp_extract(html, '(?s)(<article>.*?)</article>', 1) ELSE regexp_extract(html, '(?s)(<article>.*)', 1) END AS content FROM pages")
def select_main_content(spark, d) -> DataFrame:
    return steps.select_main_content(table(spark, d, "pages"))


def capitals(prompt: str) -> str:
    """The default provider: capitalised words are entities, and each is related to the next."""
    words = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+", prompt.split("\n", 1)[1])))
    return "```json\n" + json.dumps({"nodes": [{"id": w} for w in words], "relationships": [{"source": a, "type": "NEXT", "target": b} for a, b in zip(words, words[1:], strict=False)]}) + "\n```"


@query(r"WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+')) AS w FROM benchmark) SELECT item_id, list_sort(w) AS nodes, greatest(len(w) - 1, 0)::INTEGER AS n_relationships, 1::INTEGER AS tries FROM w")
def extract_kg(spark, d) -> DataFrame:
    """Graphs of the passages by the default provider, through prompt, answer, check and retry."""
    found = steps.extract_graph(table(spark, d, "benchmark"), "item_id", "text", capitals)
    return found.select("item_id", F.array_sort("nodes").alias("nodes"), F.size("relationships").alias("n_relationships"), "tries")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, CASE WHEN a.s_suppkey % 3 = b.s_suppkey % 3 THEN 'merge' ELSE 'do_not_merge' END AS decision, CASE WHEN a.s_suppkey % 3 = b.s_suppkey % 3 THEN 1.0::DOUBLE ELSE 0.5 END AS confidence, CASE WHEN a.s_suppkey % 3 = b.s_suppkey % 3 THEN b.s_suppkey ELSE a.s_suppkey END::VARCHAR AS canonical_id FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def compare_entities(spark, d) -> DataFrame:
    """A provider's comparisons of the suppliers of a nation, checked: too high confidences, unknown decisions and ids are put right."""
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").cast("string").alias("a"), F.col("s_suppkey").alias("ka"))
    pairs = s.join(s.select("s_nationkey", F.col("a").alias("b"), F.col("ka").alias("kb")), "s_nationkey").filter("ka < kb")
    same = F.concat(F.lit('{"decision": "merge", "confidence": 7, "canonical_entity_id": "'), "b", F.lit('"}'))
    answer = F.when(F.col("ka") % 3 == F.col("kb") % 3, same).otherwise('So: {"decision": "perhaps", "canonical_entity_id": "none"}')
    return pairs.withColumn("x", steps.comparison(answer, F.col("a"), F.col("b"))).select(F.col("ka").alias("a"), F.col("kb").alias("b"), "x.decision", "x.confidence", "x.canonical_id")


def by_segment(records: list[dict]) -> list[list]:
    """A decision: records of one segment are one entity."""
    found: dict = {}
    for r in records:
        found.setdefault(r["segment"], []).append(r["id"])
    return [*found.values(), [-1]]


@query("SELECT c_nationkey AS cluster, c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS part FROM customer")
def two_pass_resolve(spark, d) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("hint"), F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")).alias("record"))
    return steps.two_pass(rows, by_segment, 400)


def _graph_files(spark, d) -> DataFrame:
    """The graph as JSON files by a hash of the ids, read back."""
    file = lambda c: F.concat(F.lit("part"), F.pmod(F.xxhash64(c), F.lit(64)).cast("string"), F.lit(".json"))
    nodes = star.nodes(spark, d).select(file("id").alias("source_file"), "id", "labels", F.struct("name", F.array("name", F.upper("name")).alias("aliases")).alias("properties"))
    edges = star.edges(spark, d).select(file("id").alias("source_file"), "id", "type", F.col("source").alias("start_id"), F.col("target").alias("end"))
    path = _folder(spark, "graph")
    files.write_kg(nodes, edges, path)
    return files.read_kg(spark, f"{path}/*/*.json")


@query(f"WITH {star.NODES_SQL} SELECT id, labels, name, [name, upper(name)] AS aliases FROM nodes")
def scan_kg_json(spark, d) -> DataFrame:
    return files.nodes(_graph_files(spark, d)).select("id", "labels", "name", "aliases")


@query(f"WITH {star.EDGES_SQL} SELECT id, type, source, target FROM edges")
def sink_kg_json(spark, d) -> DataFrame:
    return files.relationships(_graph_files(spark, d)).select("id", "type", "source", "target")


@query("SELECT doc_id, lang, source, text FROM documents")
def scan_csv(spark, d) -> DataFrame:
    path = _folder(spark, "rows") + ".csv"
    files.write_rows(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), path)
    return files.read_rows(spark, path, "doc_id bigint, lang string, source string, text string")


@query("SELECT event_id, user_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def sink_rows(spark, d) -> DataFrame:
    """Rows with a JSON cell, written as CSV and read back with the cell parsed."""
    path = _folder(spark, "cells") + ".csv"
    rows = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), F.from_json("props", "k bigint").alias("props"))
    files.write_rows(rows, path)
    return files.read_rows(spark, path, "event_id bigint, user_id bigint, kind string, props string", {"props": "k bigint"}).select("event_id", "user_id", "kind", "props.k")


@query("SELECT event_id, event_type, props FROM events")
def scan_jsonl(spark, d) -> DataFrame:
    path = _folder(spark, "lines")
    table(spark, d, "events").select("event_id", "event_type", "props").write.json(path)
    return files.read_rows(spark, path, "event_id bigint, event_type string, props string")
