from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from graphkiln.functions import text as t
from graphkiln.operators import rag, reasoning


def test_listed():
    assert reasoning.listed('```json\n{"Sub-query 1": "a", "Sub-query 2": ["b", ["c", "in", "d"]]}\n```', 9) == ["a", "b", "c in d"]
    assert reasoning.listed("Sub-query 1: a\n- Subquery 2: b\nSub-query 3: a", 2) == ["a", "b"]
    assert reasoning.listed('["x", " ", null, "y"]', 1) == ["x"]
    assert reasoning.listed(None, 3) == reasoning.listed("nothing", 3) == []


def _search(spark, rows, provider, **options):
    asked = spark.createDataFrame(rows, "key long, question string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "IN", f"t{k:02d}") for k in range(30)], "source string, type string, target string")
    found = reasoning.graph_search(asked, reasoning.by_names(nodes, edges, 3), provider, tries=1, **options)
    return {r.key: r for r in found.collect()}


def test_failing_provider(spark):
    def fail(prompt):
        raise ValueError(prompt)

    rows = _search(spark, [(1, "where is a"), (2, None), (3, "")], fail)
    assert sorted(rows) == [1, 2, 3]
    for r in rows.values():
        assert (r.answer, r.semantic.history, r.relational.history, r.semantic.expanded) == ("", [], [], [])


def test_hops_see_answers_before(spark):
    def provider(prompt):
        task, *rest = prompt.split("\n")
        if task == "decompose":
            return '["find a", "find #1", "find b", "one too many"]'
        if task == "ground":
            return ""
        if task == "verify":
            return "no"
        if task == "expand":
            return '["more a", "and more"]'
        return f"{task} {len(rest)} {prompt.count('target')}"

    (row,) = _search(spark, [(1, "where is a")], provider).values()
    # An empty grounding leaves the query; "find #1" names nothing, so its context is empty on both ways.
    assert [h.query for h in row.semantic.history] == ["find a", "find #1", "find b", "more a"]
    assert [h.query for h in row.relational.history] == ["find a", "find #1", "find b", "more a"]
    assert row.relational.history[0].summary.endswith(" 3") and row.semantic.history[0].summary.endswith(" 0")
    assert [(e.stage, e.query) for e in row.relational.evidence] == [("initial", "where is a"), ("subquery", "find a"), ("subquery", "find"), ("subquery", "find b"), ("expansion", "more a")]
    assert row.semantic.history[3].answer == "" and row.answer.startswith("final")


def test_no_questions(spark):
    assert _search(spark, [], lambda _: "") == {}


def test_model_blocks(spark):
    items = spark.createDataFrame([(1, ["P", "L"]), (2, ["L", "P"]), (3, ["O"]), (4, []), (5, None), (6, ["X", "O"])], "id long, labels array<string>")
    seen = []

    def provider(prompt):
        seen.append(prompt)
        return '{"blocks": [{"block_id": "one", "types": ["P", "O"]}, {"block_id": "two", "types": ["L", "O"]}, {"types": ["X"]}]}'

    blocks = {r.id: r.block for r in reasoning.model_blocks(items, provider).collect()}
    assert blocks == {1: "one", 2: "two", 3: "two", 4: "unknown", 5: "unknown", 6: "two"}
    assert len(seen) == 1 and seen[0].count("L, P") == 1
    own = {1: "L+P", 2: "L+P", 3: "O", 4: "unknown", 5: "unknown", 6: "O+X"}
    assert {r.id: r.block for r in reasoning.model_blocks(items, lambda _: "?").collect()} == own
    assert {r.id: r.block for r in reasoning.model_blocks(items, provider, most=2).collect()} == own
    assert len(seen) == 1


def test_embed_renamed(spark):
    store = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vector array<double>")
    renamed = spark.createDataFrame([(2, "bb"), (2, "aaa"), (9, "c")], "id long, name string")
    made = reasoning.embed_renamed(store, renamed, "id", lambda df: df.select("id", F.array(F.length("name").cast("double")).alias("vector")))
    assert {r.id: r.vector for r in made.collect()} == {1: [1.0], 2: [2.0]}


def test_uuid5(spark):
    names = ["", "vec_1", "Đại học", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", t.uuid5(F.col("n")).alias("id")).collect()
    assert {r.n: r.id for r in rows} == {n: None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names}


def test_fallback_keywords(spark):
    asked = ["Hồ Chí Minh ở đâu", "là gì", "của", None, "", "b2 ab Ab cde CDE", "Cho Mai Lan", 'hỏi "http://a.b/c?x=1," và http://a.b']
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(asked)], "k int, q string")
    found = {r.k: (r.x.phrases, r.x.words, r.x.more) for r in rows.select("k", rag.fallback_keywords(F.col("q")).alias("x")).collect()}
    # The pattern's range of capitals holds accented small letters as well.
    assert found[0] == (["Hồ Chí Minh ở đâu"], [], [])
    assert found[1] == ([], ["gì"], [])
    assert found[2] == found[3] == found[4] == ([], [], [])
    assert found[5] == ([], ["b2", "cde"], [])
    assert found[6] == (["Mai Lan"], [], [])
    assert found[7][0][0].startswith("http://a.b/c?x=1") and found[7][2] == ["a.b"]


def test_fallback_keywords_of_a_long_question(spark):
    """Each step is computed once a question: in a second or two, not for each pair of words again."""
    words = [f"w{k}x" for k in range(400)]
    rows = spark.createDataFrame([(" ".join([*words, *(w.upper() for w in words)]),)], "q string")
    started = time.monotonic()
    (found,) = rows.select(rag.fallback_keywords(F.col("q")).alias("x")).collect()
    assert (found.x.phrases, found.x.more) == ([" ".join(w.upper() for w in words)], []) and found.x.words == words
    assert time.monotonic() - started < 30


def test_distinct_by(spark):
    rows = spark.createDataFrame([(["b", "A", None, "a", "B", "c", None],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in rows.select(t.distinct_by(F.col("x"))).collect()] == [["b", "A", "c"], [], None]


def test_words_of_queries_are_not_broadcast(spark):
    """Catalyst takes the many words of queries for a small table; the joins say that they sort, and lists hold the first distinct edges."""
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "IN", "t2"), ("a", "IN", "t1"), ("a", "IN", "t1"), ("a", "IN", "t3"), ("c", "IN", "t1")], "source string, type string, target string")
    queries = spark.createDataFrame([(1, "semantic", "is a in b?"), (2, "semantic", "c")], "key long, way string, query string")
    found = reasoning.by_names(nodes, edges, 2)(queries)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    (row,) = found.collect()
    assert row.key == 1 and [x in row.context for x in ('"t1"', '"t2"', '"t3"', '["a","b"]')] == [True, True, False, True] and row.context.count("t1") == 1
