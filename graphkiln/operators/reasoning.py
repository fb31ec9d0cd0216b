"""Questions answered hop by hop on texts and on the graph, and blocks that a model chooses.

A question is two rows, one for each way it is answered (from texts; from the graph), so a hop of all questions on both ways
is one retrieval and one pass of the provider. A provider is ``prompt -> text``; the first line of a prompt names the task.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphkiln.functions import text as t
from graphkiln.functions.cut import cut
from graphkiln.functions.ship import ship
from graphkiln.operators import rag

#: How many queries a question is decomposed into, and widened by, at most.
SUB_QUERIES, WIDER_QUERIES = 3, 1
#: The sections of a context that a way reads.
WAYS = {"semantic": ("Chunks", "Sources"), "relational": ("Entities", "Relationships")}
#: Retrieval: (key, way, query) to (key, way, context), at most one row each.
Retrieve = Callable[[DataFrame], DataFrame]


def model(provider: rag.Provider, tries: int = 3, wait: float = 1.0) -> Callable[[Column], Column]:
    """A provider as a function of columns: "" after ``tries`` failures, null prompts aren't sent."""

    def once(prompt: str) -> str:
        for k in range(1, tries + 1):
            try:
                return provider(prompt) or ""
            except Exception:  # noqa: BLE001  a failed call counts as a try
                if k < tries:
                    time.sleep(wait * 2**k)
        return ""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else once(p) for p in prompts], dtype=object)

    # Not deterministic, so that Catalyst neither repeats nor moves the calls.
    return run.asNondeterministic()


def listed(answer: str | None, most: int) -> list[str]:
    """The distinct queries of an answer, at most ``most``: the values of JSON (triples joined by spaces), else lines "Sub-query n: …"."""
    found = rag.parse_json(answer) if "{" in (answer or "") else rag.parse_json(answer, "[")
    if isinstance(found, dict):
        found = [v for value in found.values() for v in (value if isinstance(value, list) else [value])]
    if not isinstance(found, list):
        found = re.findall(r"(?im)^\W*sub-?query\s*\d+\W*:\s*(.+)$", answer or "")
    plain = (" ".join(map(str, x)) if isinstance(x, list) else str(x) for x in found if x is not None)
    return list(dict.fromkeys(x.strip() for x in plain if x.strip()))[:most]


def _listed(answer: Column, most: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(answers: pd.Series) -> pd.Series:
        return pd.Series([listed(a, most) for a in answers], dtype=object)

    return run(answer)


def repaired(answer: Column, schema: str) -> Column:
    """What a model meant as a JSON object, by ``rag.parse_json``, as a struct; null if nothing parses."""

    @F.pandas_udf("string")
    def run(answers: pd.Series) -> pd.Series:
        found = [rag.parse_json(a) for a in answers]
        return pd.Series([None if f is None else json.dumps(f) for f in found], dtype=object)

    return F.from_json(run(answer), schema)


def kept(context: Column, way: Column) -> Column:
    """The sections of a context that a way reads; "" if the context has none."""
    parts = lambda names: F.concat_ws("\n", *[F.nullif(rag.context_section(context, n), F.lit("")) for n in names])
    return F.when(way == "semantic", parts(WAYS["semantic"])).otherwise(parts(WAYS["relational"]))


def told(history: Column) -> Column:
    """A history as text."""
    return F.array_join(F.transform(history, lambda h: F.concat(F.lit("Query: "), h["query"], F.lit("\nSummary: "), h["summary"], F.lit("\nAnswer: "), h["answer"])), "\n\n")


def prompt(task: str, *parts: Column) -> Column:
    return F.concat_ws("\n", F.lit(task), *[F.coalesce(p, F.lit("")) for p in parts])


def _looked_up(state: DataFrame, retrieve: Retrieve, query: str, stage: str) -> DataFrame:
    """``state``, cut, with the ``context`` of a query column (null without a query) and a new row of ``evidence``."""
    state = cut(state)
    found = retrieve(state.filter(F.col(query).isNotNull()).select("key", "way", F.col(query).alias("query")))
    # Contexts are as many as queries, whatever Catalyst takes them for: never broadcast.
    state = state.join(found.select("key", "way", "context").hint("merge"), ["key", "way"], "left")
    state = state.withColumn("context", F.when(F.col(query).isNotNull(), F.coalesce("context", F.lit(""))))
    row = F.struct(F.lit(stage).alias("stage"), F.col(query).alias("query"), F.col("context").alias("context"))
    return state.withColumn("evidence", F.when(F.col(query).isNotNull(), F.array_append("evidence", row)).otherwise(F.col("evidence")))


def graph_search(questions: DataFrame, retrieve: Retrieve, provider: rag.Provider, sub_queries: int = SUB_QUERIES, wider: int = WIDER_QUERIES, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, answer, semantic, relational): an answer and, for each way, struct(history, evidence, verification, expanded).

    questions: key (unique), question. A way is decomposed; each sub-query is grounded by the answers before it where it refers to
    them, looked up, summarised and answered; a draft of all is verified, and if the verification is negative a few wider queries
    are looked up as well. The answer is drawn from both histories. Null questions count as empty ones; what a provider can't
    answer is empty; a way without sub-queries has an empty history.
    """
    ship(questions.sparkSession)
    ask = model(provider, tries, wait)
    way = F.col("way")
    none = F.array().cast("array<struct<query:string,summary:string,answer:string>>")
    state = questions.select("key", F.coalesce("question", F.lit("")).alias("question"), F.explode(F.array(*map(F.lit, WAYS))).alias("way"))
    state = state.withColumns({"history": none, "evidence": F.array().cast("array<struct<stage:string,query:string,context:string>>")})
    state = _looked_up(state, retrieve, "question", "initial")
    state = state.withColumn("background", ask(prompt("summary", F.col("question"), kept(F.col("context"), way))))
    state = state.drop("context").withColumn("plan", ask(prompt("decompose", way, F.col("question"))))
    state = state.withColumn("subs", _listed(F.col("plan"), sub_queries))
    for k in range(sub_queries):
        sub = F.get("subs", F.lit(k))
        refers = F.when(way == "semantic", sub.contains("#")).otherwise(F.lit(k > 0))
        grounded = ask(F.when(sub.isNotNull() & refers, prompt("ground", sub, F.col("plan"), told(F.col("history")))))
        state = state.withColumn("sub", sub).withColumn("grounded", grounded)
        state = state.withColumn("sub", F.coalesce(F.nullif(F.trim("grounded"), F.lit("")), "sub")).drop("grounded")
        state = state.withColumn("look", F.nullif(F.when(way == "semantic", F.col("sub")).otherwise(t.relational_text(F.col("sub"))), F.lit("")))
        state = _looked_up(state, retrieve, "look", "subquery")
        asked = F.col("look").isNotNull()
        state = state.withColumn("summary", ask(F.when(asked, prompt("summary", F.col("sub"), kept(F.col("context"), way)))))
        state = state.withColumn("found", ask(F.when(asked, prompt("answer", F.col("sub"), told(F.col("history")), F.col("summary")))))
        row = F.struct(F.col("sub").alias("query"), F.col("summary").alias("summary"), F.col("found").alias("answer"))
        state = state.withColumn("history", F.when(asked, F.array_append("history", row)).otherwise(F.col("history")))
        state = state.drop("sub", "look", "context", "summary", "found")
    state = state.withColumn("draft", ask(prompt("draft", F.col("question"), told(F.col("history")))))
    state = state.withColumn("verification", ask(prompt("verify", F.col("question"), told(F.col("history")), F.col("draft"))))
    widen = F.when(t.looks_negative(F.col("verification")), prompt("expand", F.col("question"), told(F.col("history")), F.col("draft"), F.col("verification")))
    state = state.withColumn("wider", ask(widen)).withColumn("expanded", _listed(F.col("wider"), wider))
    for k in range(wider):
        state = _looked_up(state.withColumn("look", F.get("expanded", F.lit(k))), retrieve, "look", "expansion")
        asked = F.col("look").isNotNull()
        state = state.withColumn("summary", ask(F.when(asked, prompt("summary", F.col("look"), kept(F.col("context"), way)))))
        row = F.struct(F.col("look").alias("query"), F.col("summary").alias("summary"), F.lit("").alias("answer"))
        state = state.withColumn("history", F.when(asked, F.array_append("history", row)).otherwise(F.col("history"))).drop("look", "context", "summary")
    state = cut(state)
    of = lambda name: F.max(F.when(way == name, F.struct("history", "evidence", "verification", "expanded", "background"))).alias(name)
    rows = state.groupBy("key").agg(F.first("question").alias("question"), *map(of, WAYS))
    parts = [F.col(f"{name}.background") for name in WAYS] + [told(F.col(f"{name}.history")) for name in WAYS]
    return rows.select("key", ask(prompt("final", F.col("question"), *parts)).alias("answer"), *[F.col(name).dropFields("background").alias(name) for name in WAYS])


def by_names(nodes: DataFrame, edges: DataFrame, most: int = 10) -> Retrieve:
    """Retrieval of the nodes that a query names as a word, with their first ``most`` edges by type and end. nodes: id; edges: source, type, target.

    The nodes' lists are made at the first lookup and kept. Catalyst takes the words, of which a query has many, for a small table, so
    all joins say that they sort: none is broadcast.
    """
    kept = []

    def lists() -> DataFrame:
        # Catalyst cuts each task's edges of a node to its first ones before they are dealt out; a rank holds all copies of an edge.
        first = F.dense_rank().over(Window.partitionBy("source").orderBy("type", "target"))
        ends = edges.select("source", "type", "target", first.alias("rank")).filter(F.col("rank") <= most)
        listed = ends.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_set(F.struct("type", "target"))).alias("e"))
        return nodes.select("id").distinct().join(listed.hint("merge"), "id", "left")

    def retrieve(queries: DataFrame) -> DataFrame:
        if not kept:
            kept.append(cut(lists()))
        words = queries.select("key", "way", F.explode(F.array_distinct(F.split("query", r"[\s?!,.;:]+"))).alias("id"))
        found = words.join(kept[0].hint("merge"), "id")
        entities = F.array_sort(F.collect_set("id"))
        flat = F.transform(F.coalesce("e", F.array().cast("array<struct<type:string,target:string>>")), lambda e: F.struct(F.col("id").alias("source"), e["type"].alias("type"), e["target"].alias("target")))
        relations = F.array_sort(F.flatten(F.collect_list(flat)))
        empty = F.array().cast("array<string>")
        return found.groupBy("key", "way").agg(rag.context_text(entities, relations, empty, empty).alias("context"))

    return retrieve


def model_blocks(items: DataFrame, provider: rag.Provider, most: int = 10_000) -> DataFrame:
    """(id, block): items blocked by types as one call of a provider groups them; the first label with a block decides, else "unknown".

    items: id, labels. The provider sees the distinct sorted sets of labels, which are few for any number of items; more than
    ``most`` sets aren't sent. Then, and if the answer holds no blocks, each set is a block of its own. A type listed in several
    blocks is in the last. Null labels are none.
    """
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    rows = items.select("id", labels.alias("labels"), F.array_sort(labels).alias("types"))
    sets = rows.select("types").distinct().orderBy("types").limit(most + 1).collect()
    blocks = None
    if len(sets) <= most:
        found = rag.parse_json(provider("blocks\n" + "\n".join(", ".join(x or "" for x in s["types"]) for s in sets)))
        blocks = found.get("blocks") if isinstance(found, dict) else None
    if not isinstance(blocks, list):
        return rows.select("id", F.when(F.size("types") > 0, F.array_join("types", "+")).otherwise("unknown").alias("block"))
    mapping = {str(x): str(b["block_id"]) for b in blocks if isinstance(b, dict) and "block_id" in b for x in b.get("types") or []}
    pairs = [x for pair in mapping.items() for x in map(F.lit, pair)]
    lookup = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    chosen = F.filter(F.transform("labels", lambda x: F.try_element_at(lookup, x)), lambda x: x.isNotNull())
    return rows.select("id", F.coalesce(F.get(chosen, F.lit(0)), F.lit("unknown")).alias("block"))


def embed_renamed(store: DataFrame, renamed: DataFrame, key: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, vector): ``store`` with new vectors for the renamed keys it holds; unknown keys are left out, of several names the last counts. ``embed``: (key, name) to (key, vector)."""
    known = renamed.join(store.select(key), key, "left_semi").groupBy(key).agg(F.max("name").alias("name"))
    fresh = embed(known).select(key, F.col("vector").alias("_new"))
    return store.join(fresh, key, "left").select(key, F.coalesce("_new", "vector").alias("vector"))
