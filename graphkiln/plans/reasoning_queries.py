"""Queries of questions answered hop by hop, of blocks that a model chooses, and of names whose vectors are made anew."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphkiln.functions.ship import ship
from graphkiln.operators import documents, rag, reasoning, vectors
from graphkiln.plans.vector_queries import ORACLES as VECTOR_SQL
from graphkiln.sources import star
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


def two_hops(prompt: str) -> str:
    """The default provider for questions "Which region is X in?": X's place, then that place's place."""
    task, *lines = prompt.split("\n")
    text = "\n".join(lines)
    ends = re.findall(r'"type":"IN_\w+","target":"(\w+)"', text)
    answers = re.findall(r"(?m)^Answer: (\w+)$", text)
    if task == "decompose":
        name = re.search(r"region is (\S+) in", text)
        return json.dumps({"Sub-query 1": f"Where is {name[1]} in?", "Sub-query 2": "Where is Entity#1 in?"}) if name else ""
    if task == "ground":
        return lines[0].replace("Entity#1", answers[-1]) if answers else ""
    if task == "summary":
        return " ".join(f'"type":"IN_PLACE","target":"{e}"' for e in ends)
    if task == "answer":
        return ends[-1] if ends else ""
    if task == "verify":
        return "Yes." if answers else "No, nothing was found."
    if task == "expand":
        return json.dumps([f"place of {lines[0].split()[3]}"])
    return answers[-1] if answers else ""


@query("SELECT c_custkey, 'region_' || n_regionkey AS answer, ['Where is customer_' || c_custkey || ' in?', 'Where is nation_' || n_nationkey || ' in?'] AS hops, 'Yes.' AS graph_holds, 'No, nothing was found.' AS texts_hold, ['initial', 'subquery', 'subquery', 'expansion'] AS text_stages, ['initial', 'subquery', 'subquery'] AS graph_stages, ['place of customer_' || c_custkey] AS wider FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_search(spark, d) -> DataFrame:
    """Every customer's region in two hops of the graph; texts, of which there are none, fail the check and are widened."""
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("Which region is customer_"), F.col("c_custkey").cast("string"), F.lit(" in?")).alias("question"))
    found = reasoning.graph_search(asked, reasoning.by_names(star.nodes(spark, d), star.edges(spark, d)), two_hops)
    return found.select(
        F.col("key").alias("c_custkey"), "answer", F.col("relational.history.query").alias("hops"), F.col("relational.verification").alias("graph_holds"), F.col("semantic.verification").alias("texts_hold"),
        F.col("semantic.evidence.stage").alias("text_stages"), F.col("relational.evidence.stage").alias("graph_stages"), F.col("semantic.expanded").alias("wider"),
    )


def places_apart(prompt: str) -> str:
    """The default provider: nations and regions are places; brands and segments aren't listed, so other labels decide."""
    types = set(re.split(r", |\n", prompt))
    wanted = {"places": ["Nation", "Region"], "firms": ["Organization", "Customer"]}
    return "```json\n" + json.dumps({"blocks": [{"block_id": k, "types": [x for x in v if x in types]} for k, v in wanted.items()]}) + "\n```"


@query(f"WITH {star.NODES_SQL} SELECT id, CASE WHEN labels[1] IN ('Nation', 'Region') THEN 'places' WHEN labels[1] IN ('Supplier', 'Customer') THEN 'firms' ELSE 'unknown' END AS block FROM nodes")
def llm_blocking(spark, d) -> DataFrame:
    return reasoning.model_blocks(star.nodes(spark, d), places_apart)


@query(f"WITH {star.NODES_SQL} SELECT id, CASE WHEN len(labels) > 1 THEN list_aggregate(list_sort(labels), 'string_agg', '+') ELSE labels[1] END AS block FROM nodes")
def llm_blocking_fallback(spark, d) -> DataFrame:
    """An answer that can't be parsed leaves each set of labels a block."""
    return reasoning.model_blocks(star.nodes(spark, d), lambda _: "Sorry, no.")


@query(VECTOR_SQL["hash_embedding"].replace("p_name", "CASE WHEN p_size > 25 THEN p_name || ' ' || p_brand ELSE p_name END"))
def update_embedding(spark, d) -> DataFrame:
    """The vectors of all parts after the large ones were renamed; only these are embedded again."""
    parts = table(spark, d, "part")
    store = vectors.hash_embedding(parts, "p_partkey", "p_name", 32)
    renamed = parts.filter("p_size > 25").select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("name"))
    made = reasoning.embed_renamed(store, renamed, "p_partkey", lambda df: vectors.hash_embedding(df, "p_partkey", "name", 32))
    return made.select("p_partkey", F.posexplode("vector").alias("i", "x")).filter("abs(x) > 1e-9").withColumn("x", F.round("x", 6))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, event_type <> 'error' AS fine FROM events")
def json_repair(spark, d) -> DataFrame:
    """Every event's properties in the wrappings that models put around JSON: thoughts, fences, text, trailing commas, Python literals."""
    ship(spark)
    fine = F.col("event_type") != "error"
    plain = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "kind": "'), "event_type", F.lit('", "fine": '), fine.cast("string"))
    python = F.concat(F.lit("{'k': "), F.get_json_object("props", "$.k"), F.lit(", 'kind': '"), "event_type", F.lit("', 'fine': "), F.initcap(fine.cast("string")), F.lit(", 'more': None}"))
    turn = F.pmod("event_id", F.lit(4))
    answer = F.when(turn == 0, F.concat(F.lit("<think>{\"k\": 0}</think>\n```json\n"), plain, F.lit("}\n```")))
    answer = answer.when(turn == 1, F.concat(F.lit("Here it is: "), plain, F.lit(",} and {more}"))).when(turn == 2, python).otherwise(F.concat(plain, F.lit("}")))
    rows = table(spark, d, "events").select("event_id", reasoning.repaired(answer, "k bigint, kind string, fine boolean").alias("x"))
    return rows.select("event_id", "x.k", "x.kind", "x.fine")


def _markdown(spark, d) -> DataFrame:
    """Parts as Markdown: two headings, a list, a table and a fence."""
    lines = ["# ", "p_brand", "\n\n", "p_name", "\n\n## ", "p_type", "\n\n- ", "p_name", "\n- last\n| a | b |\n| 1 | 2 |\n```\n# code\n\n```\n# End\n\n"]
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(*[F.col(x) if x.startswith("p_") else F.lit(x) for x in lines]).alias("text"))


MARKED = "E'- ' || p_name || E'\\n- last', E'| a | b |\\n| 1 | 2 |', E'```\\n# code\\n\\n```'"


@query(f"SELECT p_partkey AS doc_id, 0::INTEGER AS part, p_brand AS path, p_name AS body FROM part UNION ALL SELECT p_partkey, 1, p_brand || ' > ' || p_type, concat_ws(E'\n', {MARKED}) FROM part".replace("\\n", "\n"))
def md_sections(spark, d) -> DataFrame:
    return documents.sections(_markdown(spark, d))


@query(f"SELECT p_partkey AS doc_id, unnest(range(7))::INTEGER AS part, unnest(['# ' || p_brand, p_name, '## ' || p_type, {MARKED}, '# End']) AS body FROM part".replace("\\n", "\n"))
def md_blocks(spark, d) -> DataFrame:
    return documents.blocks(_markdown(spark, d))


@query("SELECT doc_id, length(text)::BIGINT AS n_chars, true AS whole, true AS fits FROM documents WHERE length(text) > 0 AND regexp_matches(text, '\\S')")
def split_content(spark, d) -> DataFrame:
    """Every whole text in parts of at most 300 characters; that none is longer, and that no character but separators is lost."""
    docs = table(spark, d, "documents")
    found = documents.split_content(docs, 300).groupBy("doc_id").agg(F.max(F.length("body")).alias("longest"), F.sum(F.length(F.regexp_replace("body", r"[ \n]", ""))).alias("n"))
    rows = docs.join(found, "doc_id")
    whole = F.length(F.regexp_replace("text", r"[ \n]", "")) == F.col("n")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), whole.alias("whole"), (F.col("longest") <= 300).alias("fits"))


@query("SELECT s_suppkey, '[\"e' || s_suppkey || '\"]' || chr(10) || '[\"r\"]' AS graph, '[\"c' || s_suppkey || '\"]' || chr(10) || '[\"s\"]' AS texts FROM supplier")
def context_filter(spark, d) -> DataFrame:
    """The sections of a context that each way of a question reads."""
    key = F.col("s_suppkey").cast("string")
    context = rag.context_text(F.array(F.concat(F.lit("e"), key)), F.array(F.lit("r")), F.array(F.concat(F.lit("c"), key)), F.array(F.lit("s")))
    kept = lambda way: reasoning.kept(context, F.lit(way))
    return table(spark, d, "supplier").select("s_suppkey", kept("relational").alias("graph"), kept("semantic").alias("texts"))


@query("SELECT p_partkey, ['https://shop.example/p' || p_partkey, 'Nation ' || p_partkey] AS phrases, list_distinct(string_split(p_name, ' ')).list_sort() AS words, ['shop.example'] AS more FROM part")
def fallback_keywords(spark, d) -> DataFrame:
    """Keywords without a model; stop words, short words and repeats go."""
    key = F.col("p_partkey").cast("string")
    asked = F.concat(F.lit("Cho tôi: https://shop.example/p"), key, F.lit("/ của Nation "), key, F.lit(" và "), "p_name", F.lit(", NATION "), key, F.lit(" x là "), "p_name")
    rows = table(spark, d, "part").select("p_partkey", rag.fallback_keywords(asked).alias("x"))
    return rows.select("p_partkey", "x.phrases", F.array_sort("x.words").alias("words"), "x.more")
